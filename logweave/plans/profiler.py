"""Timers of named sections on the driver."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from contextlib import contextmanager


class NullProfiler:
    @contextmanager
    def section(self, name: str):
        yield

    def report(self, every: float = 30) -> None:
        return None


class Profiler:
    """Counts and seconds of sections, and of the current batch of ``reset_after`` samples."""

    def __init__(self, reset_after: int = 0, whole: str = "total", printer: Callable[[str], None] = print) -> None:
        self.reset_after, self.whole, self.printer = reset_after, whole, printer
        self.count: dict[str, int] = defaultdict(int)
        self.seconds: dict[str, float] = defaultdict(float)
        self.batch: dict[str, tuple[int, float]] = defaultdict(lambda: (0, 0.0))
        self.said = time.monotonic()

    @contextmanager
    def section(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self.count[name] += 1
            self.seconds[name] += took
            n, s = self.batch[name]
            self.batch[name] = (1, took) if self.reset_after and n >= self.reset_after else (n + 1, s + took)

    def lines(self) -> list[str]:
        base = self.seconds.get(self.whole, 0.0)
        out = []
        for name in sorted(self.seconds, key=lambda x: -self.seconds[x]):
            n, s = self.count[name], self.seconds[name]
            share = f", {100 * s / base:.2f}%" if base else ""
            m, t = self.batch[name]
            rate = f", {t / m * 1e6:.0f} us in the last batch" if self.reset_after and m else ""
            out.append(f"{name}: {n} samples, {s:.2f} s{share}, {s / n * 1e6:.0f} us each{rate}")
        return out

    def report(self, every: float = 30) -> None:
        if time.monotonic() - self.said >= every:
            self.said = time.monotonic()
            for line in self.lines():
                self.printer(line)
