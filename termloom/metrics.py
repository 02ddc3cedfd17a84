"""Timers and counters of an index and its searches, and what reports them.

Counts of rows come from the jobs themselves, by ``Observation``: nothing is counted in a pass of its own. Everything is
kept in a ``Metrics`` of the driver; a reporter is any function of a snapshot.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

Reporter = Callable[[dict], None]


class Metrics:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._timers: dict[str, list[float]] = {}  # calls, seconds in all, longest
        self._counts: dict[str, int] = {}
        self._since = time.monotonic()

    def count(self, name: str, n: int = 1) -> None:
        with self._lock:
            self._counts[name] = self._counts.get(name, 0) + n

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            with self._lock:
                n, total, most = self._timers.get(name, [0, 0.0, 0.0])
                self._timers[name] = [n + 1, total + took, max(most, took)]

    def snapshot(self, per_second: bool = True) -> dict:
        """Counts; calls, mean, longest and rate of each timer, by second or by minute."""
        with self._lock:
            unit = max(1e-9, time.monotonic() - self._since) / (1 if per_second else 60)
            timers = {k: {"calls": n, "mean_s": total / n, "max_s": most, "rate": n / unit} for k, (n, total, most) in self._timers.items()}
            return {"counts": dict(self._counts), "timers": timers}


def log(snapshot: dict) -> None:
    logging.getLogger("termloom").info("%s", json.dumps(snapshot, sort_keys=True))


def table(spark: SparkSession, path: str) -> Reporter:
    """Appends a row (name, calls, value, max_s, rate) for each timer (mean seconds) and counter to a table of JSON lines that any tool can watch."""

    def report(snapshot: dict) -> None:
        rows = [(k, None, float(v), None, None) for k, v in snapshot["counts"].items()]
        rows += [(k, t["calls"], t["mean_s"], t["max_s"], t["rate"]) for k, t in snapshot["timers"].items()]
        spark.createDataFrame(rows, "name string, calls bigint, value double, max_s double, rate double").coalesce(1).write.mode("append").json(path)

    return report


class Reporting:
    """Calls reporters each ``interval`` seconds until it is stopped; an error of one is logged."""

    def __init__(self, metrics: Metrics, reporters: list[Reporter], interval: float = 60, per_second: bool = True):
        self._stop = threading.Event()

        def run() -> None:
            while not self._stop.wait(interval):
                self.report()

        self.report = lambda: [self._call(r, metrics.snapshot(per_second)) for r in reporters]
        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    @staticmethod
    def _call(reporter: Reporter, snapshot: dict) -> None:
        try:
            reporter(snapshot)
        except Exception:  # noqa: BLE001 - reporting must not stop what it reports
            logging.getLogger("termloom").exception("a reporter failed")

    def stop(self) -> None:
        """With a last report."""
        self._stop.set()
        self._thread.join()
        self.report()
