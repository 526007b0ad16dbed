"""Histograms as a mergeable state: cumulative bucket counts, and quantiles interpolated inside a bucket.

``buckets[i]`` counts the values at or below ``bounds[i]``; the last entry, one
more than there are bounds, counts all values. Its size does not depend on the
rows, partial counts are added before the shuffle, and histograms of short
windows or of shards add up to those of long windows or of the whole, which
exact quantiles do not.

Null values are not observed; NaN counts in the last bucket only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources import versions

#: Seconds, from five milliseconds to ten seconds; other units take other bounds.
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
QUANTILES = (0.5, 0.9, 0.95, 0.99)


def _checked(bounds: tuple[float, ...]) -> list[float]:
    out = [float(b) for b in bounds]
    if not out or any(not math.isfinite(b) for b in out) or any(a >= b for a, b in zip(out, out[1:])):
        raise ValueError("bounds must be finite and ascend")
    return out


def observe(rows: DataFrame, bounds: tuple[float, ...], *by: str | Column, value: str = "value") -> DataFrame:
    """The histogram of a column for each group: ``buckets``, and the ``sum`` of the values."""
    x = F.col(value).cast("double")
    counts = [F.count_if(x <= b) for b in _checked(bounds)] + [F.count(x)]
    return rows.groupBy(*by).agg(F.array(*counts).alias("buckets"), F.sum(x).alias("sum"))


def windowed(events: DataFrame, bounds: tuple[float, ...], length: str, slide: str | None, *labels: str, late: str | None = None) -> DataFrame:
    """Histograms in tumbling or sliding windows of ``ts``; with ``late`` a watermark for streams."""
    x = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return observe(x, bounds, w.alias("window"), *labels).select(F.col("window.start").alias("start"), *labels, "buckets", "sum")


def merge(histograms: DataFrame, bounds: tuple[float, ...], *by: str | Column) -> DataFrame:
    """Adds up histograms of the same bounds."""
    n = len(_checked(bounds)) + 1
    return histograms.groupBy(*by).agg(F.array(*[F.sum(F.col("buckets")[i]) for i in range(n)]).alias("buckets"), F.sum("sum").alias("sum"))


def quantile(buckets: Column, bounds: tuple[float, ...], q: float) -> Column:
    """The value below which a share ``q`` lies, values spread evenly within their bucket.

    The first bucket reaches down to zero, or is its bound where that is not
    positive; beyond the last bound that bound is the answer; null without values.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    edges, total = _checked(bounds), F.element_at(buckets, -1)
    rank, out = total * F.lit(float(q)), F.when(F.coalesce(total, F.lit(0)) == 0, None)
    for i, upper in enumerate(edges):
        lower, below = (edges[i - 1], buckets[i - 1]) if i else (min(0.0, upper), F.lit(0))
        share = F.try_divide(rank - below, buckets[i] - below)
        # an empty first bucket holds rank 0 in no sense: the next that holds anything does
        out = out.when((buckets[i] >= rank) & (buckets[i] > 0), F.lit(lower) + F.lit(upper - lower) * share)
    return out.otherwise(F.lit(edges[-1]))


def quantiles(histograms: DataFrame, bounds: tuple[float, ...], qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Adds columns p50, p90 and so on, and the count of values."""
    return histograms.select("*", F.element_at("buckets", -1).alias("n"), *[quantile(F.col("buckets"), bounds, q).alias(f"p{q * 100:g}") for q in qs])


def follow(histograms: DataFrame, path: str, *key: str):
    """A query that keeps the newest state of each histogram of a stream in a table kept by version.

    In update mode a window's histogram is sent whenever it changed, so the
    table also has the windows that are still open; a batch that is repeated
    after a failure changes nothing. Start it with ``.start()``.
    """

    def keep(batch: DataFrame, number: int) -> None:
        versions.upsert(batch, path, list(key), ("histograms", number))

    return histograms.writeStream.outputMode("update").foreachBatch(keep)
