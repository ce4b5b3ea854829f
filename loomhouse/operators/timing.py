"""Timing of queries: every row is computed and dropped, so neither a count nor a limit shortens the work."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame


def timed(df: DataFrame, runs: int = 5, discard: int = 1) -> dict[str, float]:
    """Mean, median and standard deviation of the seconds of ``runs`` runs, the first ``discard`` left out."""
    seconds = []
    for _ in range(runs):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    kept = seconds[discard:]
    return {"mean": statistics.mean(kept), "median": statistics.median(kept), "stdev": statistics.stdev(kept) if len(kept) > 1 else 0.0}


def ratio(wide: float, narrow: float, tie: float = 0.02) -> dict[str, float | str]:
    """How many times as long the narrow query takes, and which is faster; closer than ``tie`` is neither."""
    times = narrow / wide
    return {"narrow_over_wide": round(times, 3), "winner": "tie" if abs(times - 1) <= tie else "wide" if times > 1 else "narrow"}
