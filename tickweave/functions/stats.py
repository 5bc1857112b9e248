"""Driver-side statistics over small results: quantiles, cluster bootstrap, chance baseline, interpolation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from .rng import Uniform32

NAN = float("nan")


def percentile(values: Sequence[float], q: float) -> float:
    """Linear interpolation at q(n - 1) of the sorted values; NaN without values."""
    if not values:
        return NAN
    s = sorted(values)
    at = q * (len(s) - 1)
    low = math.floor(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


def median(values: Sequence[float]) -> float:
    return percentile(values, 0.5)


def cluster_bootstrap(clusters: Sequence, stat: Callable[[list[int]], float], reps: int, seed: int) -> dict:
    """Estimate with a 95 % percentile interval, clusters resampled whole; NaN resamples are passed over, under 20 give no bounds."""
    groups: dict = {}
    for i, c in enumerate(clusters):
        groups.setdefault(c, []).append(i)
    members, draw, found = list(groups.values()), Uniform32(seed), []
    for _ in range(reps if members else 0):
        value = stat([i for _ in members for i in members[math.floor(draw() * len(members))]])
        if not math.isnan(value):
            found.append(value)
    low, high = (percentile(found, 0.025), percentile(found, 0.975)) if len(found) >= 20 else (NAN, NAN)
    return {"est": stat(list(range(len(clusters)))), "lo": low, "hi": high, "n": len(members)}


def chance_recall(windows: Sequence[tuple[int, int, int]], per_day: float, cooldown: int, reps: int, seed: int, ready: int = 310) -> dict:
    """Mean and 95 % range of the recall of a random alerter: waiting times of a renewal process at the given rate.

    windows: (number of bars, first bar and last bar of detection) for each event.
    """
    if per_day <= 0 or not windows:
        return {"mean": 0.0 if windows else NAN, "lo": 0.0, "hi": 0.0}
    draw, gap, out = Uniform32(seed), 1440 / per_day, []
    for _ in range(reps):
        hits = 0
        for bars, first, last in windows:
            at = ready + math.floor(draw() * gap)
            while at < bars and at <= last:
                if at >= first:
                    hits += 1
                    break
                at += cooldown + math.ceil(-math.log(1 - draw()) * max(1.0, gap - cooldown))
        out.append(hits / len(windows))
    return {"mean": sum(out) / len(out), "lo": percentile(out, 0.025), "hi": percentile(out, 0.975)}


def student_t_log_pdf(x: float, mu: float, kappa: float, alpha: float, beta: float) -> float:
    """Log density of the posterior predictive of a normal-gamma model."""
    freedom, scale = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
    return math.lgamma(alpha + 0.5) - math.lgamma(alpha) - 0.5 * math.log(freedom * math.pi * scale) - (alpha + 0.5) * math.log1p((x - mu) ** 2 / (freedom * scale))


def recall_at(points: Sequence[tuple[float, float]], rate: float) -> float:
    """Recall at a rate by linear interpolation between the points around it; NaN outside them or for under two points."""
    known = sorted(p for p in points if not (math.isnan(p[0]) or math.isnan(p[1])))
    if len(known) < 2 or rate < known[0][0] or rate > known[-1][0]:
        return NAN
    for (x0, y0), (x1, y1) in zip(known, known[1:]):
        if x0 <= rate <= x1:
            return y1 if x1 == x0 else y0 + (y1 - y0) * (rate - x0) / (x1 - x0)
    return NAN


def verdict(low: float | None, high: float | None) -> str:
    if low is None or high is None or math.isnan(low) or math.isnan(high):
        return "n/a"
    return "higher" if low > 0 else "lower" if high < 0 else "no clear difference"
