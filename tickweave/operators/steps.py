"""Row-at-a-time state machines, free of Spark. Batch and streaming wrappers run the same objects.

Each takes one bar (or return) at a time in time order and uses nothing later; what is compared with a window is compared before
it is added to it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from dataclasses import dataclass, field

import numpy as np

INF = float("inf")
DETECTORS = ("robust_z", "ewma_vol", "cusum", "bocpd", "volume_spike", "order_book_imbalance")
OPTIONAL = {"order_book_imbalance"}


class Window:
    """The last ``size`` finite values, also in sorted order."""

    def __init__(self, size: int):
        self.size, self.order, self.ranked = size, deque(), []

    def __len__(self) -> int:
        return len(self.order)

    def push(self, x: float) -> None:
        if not math.isfinite(x):
            return
        if len(self.order) == self.size:
            del self.ranked[bisect_left(self.ranked, self.order.popleft())]
        self.order.append(x)
        insort(self.ranked, x)

    def quantile(self, q: float) -> float:
        at = min(max(q, 0.0), 1.0) * (len(self.ranked) - 1)
        low = math.floor(at)
        high = min(low + 1, len(self.ranked) - 1)
        return self.ranked[low] + (self.ranked[high] - self.ranked[low]) * (at - low)

    def mid_rank(self, x: float) -> float:
        low, high = bisect_left(self.ranked, x), bisect_right(self.ranked, x)
        return (low + 0.5 * (high - low)) / (len(self.ranked) + 1)

    def mad(self) -> tuple[float, float]:
        m, n = self.quantile(0.5), len(self.ranked)
        gaps = np.sort(np.abs(np.asarray(self.ranked) - m))
        return m, 1.4826 * float(gaps[(n - 1) // 2] + gaps[n // 2]) / 2


@dataclass
class Ewma:
    """Zero-mean variance: the first non-zero square starts it, later ones are winsorised at ``clip`` deviations."""

    decay: float
    v: float = 0.0

    def update(self, x: float, clip: float | None = None) -> float:
        if self.v <= 0:
            self.v = x * x
        else:
            if clip is not None:
                edge = clip * math.sqrt(self.v)
                x = max(-edge, min(edge, x))
            self.v = self.decay * self.v + (1 - self.decay) * x * x
        return math.sqrt(self.v)

    @property
    def sigma(self) -> float:
        return math.sqrt(self.v) if self.v > 0 else 0.0


class RobustZ:
    """Distance from the window's median in robust deviations, of the return or of a bar's field."""

    def __init__(self, field: str | None = None, size: int = 240, least: int = 60):
        self.field, self.window, self.least = field, Window(size), least

    def update(self, bar: dict, ret: float) -> float | None:
        x, out = (ret if self.field is None else bar.get(self.field)), None
        if x is None or not math.isfinite(x):
            return None
        if len(self.window) >= self.least:
            m, scale = self.window.mad()
            out = abs(x - m) / max(scale, 1e-6)
        self.window.push(x)
        return out


class VolatilityRatio:
    def __init__(self, least: int = 100):
        self.fast, self.slow, self.n, self.least = Ewma(0.94), Ewma(0.995), 0, least

    def update(self, bar: dict, ret: float) -> float | None:
        self.n += 1
        fast, slow = self.fast.update(ret), self.slow.update(ret)
        return fast / max(slow, 1e-9) if self.n >= self.least else None


class Cusum:
    """The larger of two one-sided sums; told before a sum over ``limit`` starts anew."""

    def __init__(self, slack: float = 0.5, limit: float = 10.0, least: int = 100):
        self.slack, self.limit, self.least = slack, limit, least
        self.sigma, self.n, self.up, self.down = Ewma(0.99), 0, 0.0, 0.0

    def update(self, bar: dict, ret: float) -> float | None:
        self.n += 1
        before = self.sigma.sigma
        self.sigma.update(ret, 5.0)
        if self.n < self.least:
            return None
        z = ret / max(before, 1e-9)
        self.up, self.down = max(0.0, self.up + z - self.slack), max(0.0, self.down - z - self.slack)
        out = max(self.up, self.down)
        if out > self.limit:
            self.up = self.down = 0.0
        return out


class _LogGamma:
    """lgamma(a + 1/2) - lgamma(a) for a = 1 + k / 2, from a table that grows as needed."""

    def __init__(self) -> None:
        self.table = np.zeros(0)

    def __call__(self, k: np.ndarray) -> np.ndarray:
        top = int(k.max()) + 1
        if top > len(self.table):
            new = range(len(self.table), max(top, 2 * len(self.table), 256))
            self.table = np.append(self.table, [math.lgamma(1.5 + j / 2) - math.lgamma(1 + j / 2) for j in new])
        return self.table[k]


_log_gamma = _LogGamma()


class Bocpd:
    """Online change points: the posterior mass of the shortest run lengths under a normal-gamma model, begun at bar ``least``."""

    def __init__(self, hazard: float = 1 / 200, longest: int = 150, short: int = 5, least: int = 100):
        self.stay, self.change, self.longest, self.short, self.least = math.log1p(-hazard), math.log(hazard), longest, short, least
        self.sigma, self.n = Ewma(0.99), 0
        self.log = np.zeros(1)
        # alpha is 1 + steps / 2
        self.mu, self.kappa, self.steps, self.beta = np.zeros(1), np.ones(1), np.zeros(1, np.int64), np.ones(1)

    def update(self, bar: dict, ret: float) -> float | None:
        self.n += 1
        before = self.sigma.sigma
        self.sigma.update(ret, 6.0)
        if self.n < self.least:
            return None
        x = max(-15.0, min(15.0, ret / max(before, 1e-9)))
        alpha = 1 + self.steps / 2
        freedom, scale = 2 * alpha, self.beta * (self.kappa + 1) / (alpha * self.kappa)
        density = _log_gamma(self.steps) - 0.5 * np.log(freedom * math.pi * scale) - (freedom + 1) / 2 * np.log1p((x - self.mu) ** 2 / (freedom * scale))
        joint = self.log + density
        grown = joint + self.stay
        log = np.concatenate(([np.logaddexp.reduce(joint) + self.change], grown))
        mu = np.concatenate(([0.0], (self.kappa * self.mu + x) / (self.kappa + 1)))
        beta = np.concatenate(([1.0], self.beta + self.kappa * (x - self.mu) ** 2 / (2 * (self.kappa + 1))))
        kappa, steps = np.concatenate(([1.0], self.kappa + 1)), np.concatenate(([0], self.steps + 1))
        if len(log) > self.longest + 1:
            tail = np.logaddexp(log[-2], log[-1])
            log = np.append(log[:-2], tail)
            for a in (mu, kappa, steps, beta):  # the longer run keeps its parameters
                a[-2] = a[-1]
            mu, kappa, steps, beta = mu[:-1], kappa[:-1], steps[:-1], beta[:-1]
        self.log = log - np.logaddexp.reduce(log)
        self.mu, self.kappa, self.steps, self.beta = mu, kappa, steps, beta
        return float(np.exp(self.log[: self.short]).sum())


class VolumeSpike:
    def __init__(self, size: int = 240, least: int = 60):
        self.window, self.least = Window(size), least

    def update(self, bar: dict, ret: float) -> float | None:
        v, out = bar["volume"], None
        if len(self.window) >= self.least:
            out = v / max(self.window.quantile(0.5), 1e-9)
        self.window.push(v)
        return out


def detector(name: str):
    made = {
        "robust_z": RobustZ, "ewma_vol": VolatilityRatio, "cusum": Cusum, "bocpd": Bocpd, "volume_spike": VolumeSpike,
        "order_book_imbalance": lambda: RobustZ("obi"),
    }
    return made[name]()


class Ensemble:
    """Logistic score of features; learns only with a positive rate, pulled to its prior, weights never negative."""

    def __init__(self, n: int, rate: float = 0.0, pull: float = 0.01):
        self.prior, self.prior_bias, self.rate, self.pull = 1.5 / n, -4.5, rate, pull
        self.w, self.b = [self.prior] * n, self.prior_bias

    def predict(self, x: list[float]) -> tuple[float, list[float]]:
        parts = [w * v for w, v in zip(self.w, x)]
        return 1 / (1 + math.exp(-(self.b + sum(parts)))), parts

    def learn(self, x: list[float], y: float) -> None:
        if self.rate <= 0:
            return
        error = self.predict(x)[0] - y
        limit = lambda g: max(-5.0, min(5.0, g))
        self.w = [max(0.0, w - self.rate * limit(error * v + self.pull * (w - self.prior))) for w, v in zip(self.w, x)]
        self.b -= self.rate * limit(error + self.pull * (self.b - self.prior_bias))


class Policy:
    """Alert if a score exceeds the window's quantile for the budget, unless an alert is recent and this one is not far worse."""

    def __init__(self, per_day: float, bar_seconds: float, cooldown: int = 15, size: int = 1440, least: int = 300, escalate: float = 10.0, floor: float = 0.0):
        self.rate = per_day * bar_seconds / 86400
        self.cooldown, self.least, self.escalate, self.floor = cooldown, least, escalate, floor
        self.window, self.since, self.last = Window(size), cooldown, -INF

    def update(self, v: float) -> tuple[bool, float]:
        limit = extreme = INF
        if len(self.window) >= self.least:
            limit = max(self.floor, self.window.quantile(1 - self.rate))
            extreme = self.window.quantile(1 - self.rate / self.escalate)
        self.since += 1
        resting = self.since < self.cooldown
        alert = v > limit and (not resting or (v > extreme and v > self.last))
        if alert:
            self.since, self.last = 0, v
        self.window.push(v)
        return alert, limit


class Policies:
    """One Policy for each of several budgets; all look into the same window, which is sorted once."""

    def __init__(self, per_day: list[float], bar_seconds: float, cooldown: int = 15, size: int = 1440, least: int = 300, escalate: float = 10.0, floor: float = 0.0):
        self.runs = [Policy(x, bar_seconds, cooldown, size, least, escalate, floor) for x in per_day]
        self.window = Window(size)
        for run in self.runs:
            run.window = _Shared(self.window)

    def update(self, v: float) -> list[tuple[bool, float]]:
        out = [run.update(v) for run in self.runs]
        self.window.push(v)
        return out


class _Shared:
    """A window that its readers do not add to."""

    def __init__(self, window: Window):
        self.window = window

    def __len__(self) -> int:
        return len(self.window)

    def quantile(self, q: float) -> float:
        return self.window.quantile(q)

    def push(self, x: float) -> None:
        pass


class Alignment:
    """Gathers what symbols tell for a time; a time is complete when all have, and is forgotten once one is ``most`` bars ahead of it."""

    def __init__(self, symbols: list[str], width: int, most: int = 5, every: int = 5):
        self.symbols, self.horizon, self.every = set(symbols), most * width, every
        self.pending: dict[int, dict] = {}
        self.complete = 0

    def push(self, symbol: str, t: int, value) -> tuple[dict, bool] | None:
        """The values of a time that this one completes, and whether it is one to report; None else."""
        if symbol not in self.symbols:
            return None
        row, out = self.pending.setdefault(t, {}), None
        row[symbol] = value
        if len(row) == len(self.symbols):
            del self.pending[t]
            self.complete += 1
            out = row, self.complete % self.every == 0
        for old in [x for x in self.pending if x < t - self.horizon]:
            del self.pending[old]
        return out


@dataclass
class EngineParams:
    """The engine's settings; ``detectors`` may leave some out (ablation) or name one (solo)."""

    bar_seconds: float = 60.0
    per_day: float = 6.0
    cooldown: int = 15
    ecdf: int = 2000
    ecdf_least: int = 200
    window: int = 1440
    least: int = 300
    learn: bool = False
    rate: float = 0.002
    horizon: int = 30
    multiple: float = 4.0
    detectors: tuple[str, ...] = DETECTORS
    optional: frozenset = field(default_factory=lambda: frozenset(OPTIONAL))
    #: Detectors of the caller's own by name: what makes one, an object whose update(bar, ret) gives a number or None.
    custom: dict = field(default_factory=dict)


class Engine:
    """Bars in, scores and alerts out: detectors, rolling mid-ranks, ensemble, adaptive threshold."""

    def __init__(self, params: EngineParams | None = None):
        p = self.params = params or EngineParams()
        self.parts = [(n, p.custom[n]() if n in p.custom else detector(n), Window(p.ecdf)) for n in p.detectors]
        self.ensemble = Ensemble(len(self.parts), p.rate if p.learn else 0.0)
        self.policy = Policy(p.per_day, p.bar_seconds, p.cooldown, p.window, p.least)
        self.last, self.sigma, self.n = None, Ewma(0.99), 0
        self.sizes: deque = deque(maxlen=p.horizon)
        self.pending: deque = deque()

    def weights(self) -> dict:
        """Names of the detectors, their weights and the bias."""
        return {"names": [n for n, _, _ in self.parts], "w": list(self.ensemble.w), "b": self.ensemble.b}

    @staticmethod
    def idle(bar: dict) -> dict:
        return {"t": bar["t"], "ready": False, "p": 0.0, "score": 0.0, "threshold": 1.0, "alert": False, "detectors": []}

    def update(self, bar: dict) -> dict:
        p, before, close = self.params, self.last, bar["close"]
        self.last = close
        if before is None or not before > 0 or not close > 0 or not math.isfinite(close):
            return self.idle(bar)
        ret = math.log(close / before)
        self.n += 1
        sigma = self.sigma.update(ret, 6.0)
        self.sizes.append(abs(ret))
        while self.pending and self.pending[0][0] + p.horizon <= self.n:
            _, x, then = self.pending.popleft()
            self.ensemble.learn(x, 1.0 if then > 0 and max(self.sizes) >= p.multiple * then else 0.0)
        readings = []
        for name, part, ranks in self.parts:
            raw, feature = part.update(bar, ret), None
            if raw is not None and math.isfinite(raw):
                if len(ranks) >= p.ecdf_least:
                    feature = -math.log(1 - ranks.mid_rank(raw))
                ranks.push(raw)
            else:
                raw = None
            readings.append((name, raw, feature))
        if any(f is None and n not in p.optional for n, _, f in readings):
            return self.idle(bar)
        known = [f for _, _, f in readings if f is not None]
        mean = sum(known) / len(known) if known else 0.0
        x = [mean if f is None else f for _, _, f in readings]
        chance, parts = self.ensemble.predict(x)
        alert, limit = self.policy.update(chance)
        if p.learn:
            self.pending.append((self.n, x, sigma))
        told = [{"name": n, "raw": raw, "feature": v, "contribution": c, "imputed": f is None} for (n, raw, f), v, c in zip(readings, x, parts)]
        return {"t": bar["t"], "ready": True, "p": chance, "score": math.floor(1000 * chance + 0.5) / 10, "threshold": min(limit, 1.0), "alert": alert, "detectors": told}


class Baseline:
    """Plain z-scores, alerting over three deviations with a pause, or by the same policy as the engine."""

    def __init__(self, matched: bool = True, per_day: float = 6.0, bar_seconds: float = 60.0, size: int = 100, ready: int = 310, cooldown: int = 15, **policy):
        self.values, self.matched, self.n, self.ready, self.cooldown = deque(maxlen=size), matched, 0, ready, cooldown
        self.policy, self.since, self.last = Policy(per_day, bar_seconds, cooldown, **policy), cooldown, None

    def update(self, bar: dict) -> dict:
        before, close = self.last, bar["close"]
        self.last = close
        if before is None or not before > 0 or not close > 0:
            return {"t": bar["t"], "ready": False, "score": 0.0, "alert": False}
        ret, z = math.log(close / before), 0.0
        self.n += 1
        if len(self.values) == self.values.maxlen:
            a = np.asarray(self.values)
            sd = float(a.std(ddof=1))
            z = abs(ret - float(a.mean())) / sd if sd > 0 else 0.0
        self.values.append(ret)
        if self.matched:
            alert = self.policy.update(z)[0]
        else:
            self.since += 1
            alert = z > 3 and self.since >= self.cooldown
            if alert:
                self.since = 0
        ready = self.n >= self.ready
        return {"t": bar["t"], "ready": ready, "score": z, "alert": ready and alert}


def methods(**settings) -> dict:
    """Factories of the engines that studies compare: fixed and learned weights, two baselines, one without each required detector, one of each alone."""
    make = lambda **k: lambda: Engine(EngineParams(**{**settings, **k}))
    out = {"engine_fixed": make(), "engine_learned": make(learn=True), "zscore_fixed": lambda: Baseline(False), "zscore_matched": lambda: Baseline(True)}
    required = [d for d in DETECTORS if d not in OPTIONAL]
    out |= {f"without_{d}": make(detectors=tuple(x for x in DETECTORS if x != d)) for d in required}
    out |= {f"only_{d}": make(detectors=(d,)) for d in required}
    return out
