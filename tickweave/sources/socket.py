"""A socket source that reconnects: policy, and a Python streaming data source around any line transport."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class Reconnect:
    """When to connect again: exponential waits with jitter, begun anew only by a message; silence counts as a loss."""

    def __init__(self, base: float = 500, most: float = 30_000, stale: float = 30_000, rand: Callable[[], float] = random.random):
        self.base, self.most, self.stale, self.rand = base, most, stale, rand
        self.attempt, self.heard, self.generation, self.stopped = 0, None, 0, False

    def opened(self, now: float) -> int:
        """A new connection's token; messages under older tokens are not for us. The caller subscribes again."""
        self.heard = now
        self.generation += 1
        return self.generation

    def message(self, token: int, now: float) -> bool:
        if self.stopped or token != self.generation:
            return False
        self.attempt, self.heard = 0, now
        return True

    def wait(self) -> float:
        out = min(self.most, self.base * 2**self.attempt) * (0.5 + self.rand() / 2)
        self.attempt += 1
        return out

    def is_stale(self, now: float) -> bool:
        return self.heard is not None and now - self.heard > self.stale

    def stop(self) -> None:
        self.stopped = True
        self.generation += 1


class LineReader(SimpleDataSourceStreamReader):
    """Reads lines from a TCP endpoint, at most ``max`` a batch; offsets are counts of lines, kept for replay until committed."""

    def __init__(self, options: dict):
        self.options, self.kept, self.first = options, [], 0
        self.connection, self.policy, self.idle_until = None, Reconnect(), 0.0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _lines(self, most: int) -> list[str]:
        import socket
        import time

        out: list[str] = []
        try:
            if self.connection is None:
                if time.monotonic() < self.idle_until:
                    return out
                s = socket.create_connection((self.options["host"], int(self.options["port"])), timeout=1.0)
                if self.options.get("subscribe"):
                    s.sendall(self.options["subscribe"].encode() + b"\n")
                self.connection, self.token = s.makefile("r", encoding="utf-8", errors="replace"), self.policy.opened(time.monotonic() * 1000)
            while len(out) < most:
                line = self.connection.readline()
                if not line:
                    raise OSError("closed")
                self.policy.message(self.token, time.monotonic() * 1000)
                out.append(line.rstrip("\n"))
        except TimeoutError:
            if self.policy.is_stale(time.monotonic() * 1000):
                self.connection = None
        except OSError:
            self.connection = None
            self.idle_until = time.monotonic() + self.policy.wait() / 1000
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = self._lines(int(self.options.get("max", "20000")))
        self.kept += new
        return iter([(x,) for x in new]), {"n": start["n"] + len(new)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for x in self.kept[start["n"] - self.first : end["n"] - self.first]])

    def commit(self, end: dict) -> None:
        self.kept, self.first = self.kept[end["n"] - self.first :], end["n"]


class LineSource(DataSource):
    """spark.dataSource.register(LineSource); spark.readStream.format("lines").options(host=..., port=..., subscribe=...)."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> LineReader:
        return LineReader(self.options)
