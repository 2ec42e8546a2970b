"""Cofactors of a stream: the sums are ordinary streaming aggregates.

``maintained`` keeps sums a window and group in update mode; late rows beyond the watermark
are dropped by the engine. Rows may be retractions: with ``sign`` (1 or -1) they are taken off
again, which the ring's subtraction allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyring.plans.aggregate import Spec


def maintained(stream: DataFrame, spec: Spec, time: str, window: str, watermark: str, by: Sequence[str] = (), sign: str | None = None) -> DataFrame:
    """window_start, (group columns,) count, s<i> and q<i>_<j> of every window."""
    w = F.col(sign).cast("long") if sign else F.lit(1).cast("long")
    sums = [F.sum(w * spec.value(c)).cast("double").alias(f"s{i}") for i, c in enumerate(spec.cont)]
    sums += [F.sum(w * spec.value(a) * spec.value(spec.cont[j])).cast("double").alias(f"q{i}_{j}") for i, a in enumerate(spec.cont) for j in range(i, len(spec.cont))]
    grouped = stream.withWatermark(time, watermark).groupBy(F.window(time, window).alias("w"), *by).agg(F.sum(w).alias("count"), *sums)
    return grouped.select(F.col("w.start").alias("window_start"), *by, "count", *[f"s{i}" for i in range(len(spec.cont))], *[f"q{i}_{j}" for i in range(len(spec.cont)) for j in range(i, len(spec.cont))])
