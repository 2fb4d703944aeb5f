"""Latency of plans: warm-up, timed iterations, percentiles, and the share of each stage."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def run(df: DataFrame) -> None:
    """Execute a plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def percentiles(values: list[float]) -> dict[str, float]:
    """avg, p50, p95, p99, min and max; the value at index floor(p (n - 1)) of the sorted list; 0 for no values."""
    v = sorted(values)
    at = lambda p: v[math.floor(p * (len(v) - 1))] if v else 0.0
    return {"avg": sum(v) / len(v) if v else 0.0, "p50": at(0.50), "p95": at(0.95), "p99": at(0.99), "min": at(0.0), "max": at(1.0)}


def measure(made: Callable[[], DataFrame], requests: int, warm_up: int = 3, iterations: int = 10) -> dict[str, float]:
    """Milliseconds of one run of a plan over ``requests`` texts, and requests a second."""
    for _ in range(warm_up):
        run(made())
    times = []
    for _ in range(iterations):
        began = time.perf_counter()
        run(made())
        times.append((time.perf_counter() - began) * 1000)
    out = percentiles(times)
    return {k: round(x, 3) for k, x in out.items()} | {"requests_per_s": round(1000 * requests / out["avg"], 1) if out["avg"] else 0.0}


def by_stage(stages: dict[str, Callable[[], DataFrame]], warm_up: int = 1, iterations: int = 5) -> list[tuple[str, float]]:
    """(stage, milliseconds) samples of plans that each hold the one before: what a stage adds, and ``total``."""
    for made in stages.values():
        for _ in range(warm_up):
            run(made())
    out = []
    for _ in range(iterations):
        before = 0.0
        for name, made in stages.items():
            began = time.perf_counter()
            run(made())
            took = (time.perf_counter() - began) * 1000
            out.append((name, max(0.0, took - before)))
            before = took
        out.append(("total", before))
    return out
