"""Counters, sliding rates, quantiles, ratios and alerts over event tables; each works on a batch and on a stream alike where noted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Token buckets: requests a minute of each tier (fixed values).
TIERS = {"free": 20, "pro": 50, "default": 100}


def counters(events: DataFrame, *labels: str) -> DataFrame:
    """Monotone counters by label."""
    return events.groupBy(*labels).agg(F.count("*").alias("total"))


def rates(events: DataFrame, length: str, slide: str | None, *labels: str, late: str | None = None) -> DataFrame:
    """Events a second in sliding windows; with ``late`` a watermark for streams."""
    x = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    return x.groupBy(w.alias("window"), *labels).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *labels, "n", "total", (F.col("n") / seconds).alias("rate"))


def top_labels(rate: DataFrame, k: int, label: str) -> DataFrame:
    own = Window.partitionBy("start").orderBy(F.desc("n"), label)
    return rate.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def quantiles(events: DataFrame, length: str, label: str, ps: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles of values in tumbling windows."""
    g = events.groupBy(F.window("ts", length).alias("window"), label)
    return g.agg(*[F.percentile("value", p).alias(f"p{int(p * 100)}") for p in ps]).select(F.col("window.start").alias("start"), label, *[f"p{int(p * 100)}" for p in ps])


def ratio(events: DataFrame, length: str, kind: str, bad: str) -> DataFrame:
    """Share of one kind, and health = 100 - 10 times its rate a minute, at least 0."""
    n = events.groupBy(F.window("ts", length).alias("window")).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == bad).alias("bad"))
    minutes = (F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))) / 60
    return n.select(F.col("window.start").alias("start"), "n", "bad", (F.col("bad") / F.col("n")).alias("share"), F.greatest(F.lit(0.0), 100 - 10 * F.col("bad") / minutes).alias("health"))


def spikes(events: DataFrame, factor: float = 5.0, label: str = "event_type") -> DataFrame:
    """Five-minute windows whose rate exceeds ``factor`` times the hourly rate one hour before."""
    short = rates(events, "5 minutes", None, label).select("start", label, F.col("rate").alias("now"))
    long = rates(events, "1 hour", None, label).select((F.col("start") + F.expr("interval 1 hour")).alias("hour"), label, F.col("rate").alias("base"))
    return short.withColumn("hour", F.date_trunc("hour", "start")).join(long, ["hour", label]).filter(F.col("now") > factor * F.col("base")).select("start", label, "now", "base")


def threshold(events: DataFrame, length: str, label: str, above: int) -> DataFrame:
    n = events.groupBy(F.window("ts", length).alias("window"), label).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > above).select(F.col("window.start").alias("start"), label, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    x = events.withWatermark("ts", late) if late else events
    return x.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


LIMITED = "client string, event_id long, allowed boolean"


def limit_rows(capacity: int, idle_ms: int | None):
    """The token bucket of one client as a fold over its requests in event time: refill capacity / 60 a second, a request needs one token."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        # a client's rows of one trigger may come in several chunks: only their times are held, to draw tokens in event order
        held = sorted((ts, event) for pdf in pdfs for ts, event in zip(pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6, pdf["event_id"]))
        for lo in range(0, len(held), 10000):
            out = []
            for ts, event in held[lo : lo + 10000]:
                tokens = min(capacity, tokens + (0 if last is None else max(0.0, ts - last)) * capacity / 60)
                last = ts if last is None else max(last, ts)
                ok = tokens >= 1
                tokens -= ok
                out.append((key[0], event, ok))
            yield pd.DataFrame(out, columns=["client", "event_id", "allowed"])
        state.update((tokens, last))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    def handle(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from run(key, pdfs, state)

    return handle


def rate_limited(stream: DataFrame, capacity: int = TIERS["default"], idle_ms: int | None = 3_600_000) -> DataFrame:
    """A stream of (client, ts, event_id) with the verdict of each client's bucket; buckets idle for ``idle_ms`` are dropped (None: kept, for streams that end)."""
    return stream.groupBy("client").applyInPandasWithState(limit_rows(capacity, idle_ms), LIMITED, "tokens double, last double", "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")
