"""Histograms, alerts that must hold and the expiring cache over events, in batch and as streams, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.event_queries import _drain, _start, _stream, ev
from weftline.session import scratch
from weftline.sources import versions
from weftline.streaming import alerts, cache
from weftline.streaming import histograms as h

BOUNDS = (0.0, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0)
RULE = alerts.Rule(short=1800, long=21600, offset=21600, factor=3.0, hold=600)
LATE = 600
DAY = 86400
OPS = {"purchase": "set", "signup": "set", "error": "delete"}


def _shown(df, *labels):
    return df.select(*labels, "n", F.array_join("buckets", ",").alias("buckets"), F.round("sum", 3).alias("total"), *[F.round(f"p{q * 100:g}", 6).alias(f"p{q * 100:g}") for q in h.QUANTILES])


def histogram_query(spark, sf):
    return _shown(h.quantiles(_start(h.windowed(ev(spark, sf), BOUNDS, "6 hours", "2 hours", "event_type")), BOUNDS), "start", "event_type")


def merged_histogram_query(spark, sf):
    """Histograms of five minutes, added up to days."""
    short = h.windowed(ev(spark, sf), BOUNDS, "5 minutes", None, "event_type")
    return _shown(h.quantiles(h.merge(short, BOUNDS, F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type"), BOUNDS), "day", "event_type")


def stream_histograms(spark, sf):
    own = h.windowed(_stream(spark, sf), BOUNDS, "6 hours", None, "event_type", late="10 minutes")
    at = scratch(spark, "histograms")
    h.follow(own, at, "start", "event_type").option("checkpointLocation", at + "-state").trigger(availableNow=True).start().awaitTermination()
    return _shown(h.quantiles(_start(versions.read(spark, at, own.schema)), BOUNDS), "start", "event_type")


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sustained_query(spark, sf):
    return alerts.sustained(ev(spark, sf), RULE).select("event_type", _time("pending"), _time("firing"), _time("resolved"), "now", "base")


def stream_alerts(spark, sf):
    """Transitions up to the watermark that the last event left."""
    return _drain(spark, alerts.watch(_stream(spark, sf), RULE, late=f"{LATE} seconds"), "alerts", "append").select("event_type", _time("at"), "state")


def requests(events):
    """Users' events as requests to a cache: purchases and sign-ups set, errors delete, all else gets; a sign-up lives for six hours."""
    op = F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv])[F.col("event_type")]
    return events.select(
        cache.key("user", F.col("user_id").cast("string")).alias("key"),
        F.coalesce(op, F.lit("get")).alias("op"),
        "ts",
        F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("value"),
        F.when(F.col("event_type") == "signup", F.lit(DAY // 4)).alias("ttl"),
    )


def _answers(df):
    return df.select(F.col("seq").alias("event_id"), "key", "hit", "value")


def cache_query(spark, sf):
    return _answers(cache.lookups(requests(ev(spark, sf)), DAY, seconds=DAY))


def cache_stats_query(spark, sf):
    answers = cache.lookups(requests(ev(spark, sf)), DAY, seconds=DAY)
    return cache.stats(answers.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")


def stream_cache(spark, sf):
    at = scratch(spark, "cache")
    cache.serve(requests(_stream(spark, sf)), at, at + "-entries", DAY).option("checkpointLocation", at + "-state").trigger(availableNow=True).start().awaitTermination()
    return _answers(versions.read(spark, at, "key string, ts timestamp, seq long, hit boolean, value string"))


def _histogram_sql(rows: str, labels: str) -> str:
    """Quantiles by a scan over (bucket, count) rows, unlike the columns' nested choice."""
    edges = ", ".join(map(str, BOUNDS))
    qs = ", ".join(f"""round(CASE WHEN n = 0 THEN NULL ELSE coalesce(min_by(lo + (up - lo) * ({q} * n - before) / (c - before), i) FILTER (c >= {q} * n AND c > 0 AND before < {q} * n), {BOUNDS[-1]}::DOUBLE) END, 6)::DOUBLE AS p{q * 100:g}""" for q in h.QUANTILES)
    return f"""WITH e AS ({rows}), k AS (SELECT unnest(range(1, {len(BOUNDS) + 1})) AS i, unnest([{edges}]::DOUBLE[]) AS up),
     s AS (SELECT {labels}, count(value) AS n, sum(value) AS total FROM e GROUP BY ALL),
     b AS (SELECT {labels}, i, up, coalesce(lag(up) OVER (PARTITION BY {labels} ORDER BY i), least(0.0, up)) AS lo, c, coalesce(lag(c) OVER (PARTITION BY {labels} ORDER BY i), 0) AS before FROM (SELECT {labels}, i, up, count(*) FILTER (value <= up) AS c FROM e, k GROUP BY ALL))
     SELECT {labels}, n, string_agg(c::VARCHAR, ',' ORDER BY i) || ',' || n AS buckets, round(any_value(total), 3) AS total, {qs} FROM b JOIN s USING ({labels}) GROUP BY {labels}, n"""


M = "'%Y-%m-%d %H:%M:%S'"
SIX = f"strftime(time_bucket(INTERVAL 6 HOURS, ts), {M})"
#: Every minute of every label evaluated, where the operator goes from change to change.
SPANS = f"""c AS (SELECT event_type, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS t, count(*) AS n FROM events GROUP BY ALL),
 g AS (SELECT event_type, unnest(generate_series((SELECT min(t) FROM c), (SELECT max(t) FROM c) + INTERVAL 31 MINUTES, INTERVAL 1 MINUTE)) AS t FROM (SELECT DISTINCT event_type FROM events)),
 d AS (SELECT event_type, t, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, t)),
 w AS (SELECT event_type, t, sum(n) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN {RULE.short // 60 - 1} PRECEDING AND CURRENT ROW)::BIGINT AS now,
  coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN {(RULE.offset + RULE.long) // 60 - 1} PRECEDING AND {RULE.offset // 60} PRECEDING), 0)::BIGINT AS base,
  coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND {RULE.offset // 60} PRECEDING), 0) AS seen FROM d),
 o AS (SELECT *, now > 0 AND seen > 0 AND now / {RULE.short}::DOUBLE > {RULE.factor} * base / {RULE.long}::DOUBLE + 1e-12 AS met FROM w),
 i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) - row_number() OVER (PARTITION BY event_type, met ORDER BY t) AS k FROM o),
 a AS (SELECT event_type, min(t) AS pending, CASE WHEN max(t) >= min(t) + INTERVAL {RULE.hold} SECONDS THEN min(t) + INTERVAL {RULE.hold} SECONDS END AS firing, max(t) + INTERVAL 1 MINUTE AS resolved, min_by(now, t) AS now, min_by(base, t) AS base FROM i WHERE met GROUP BY event_type, k)"""
ANSWERS = f"""r AS (SELECT event_id, ts, 'user:' || md5(user_id::VARCHAR) AS key, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPS.items())} ELSE 'get' END AS op, event_type || ' ' || event_id AS v, CASE event_type WHEN 'signup' THEN {DAY // 4} ELSE {DAY} END AS ttl FROM events),
 l AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN struct_pack(op := op, ts := ts, v := v, ttl := ttl) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM r),
 x AS (SELECT event_id, ts, key, coalesce(w.op = 'set' AND ts < w.ts + to_seconds(w.ttl), false) AS hit, w.v AS v FROM l WHERE op = 'get')"""
GETS = f"WITH {ANSWERS} SELECT event_id, key, hit, CASE WHEN hit THEN v END AS value FROM x"

QUERIES = {
    "hist_windows": histogram_query,
    "hist_merged": merged_histogram_query,
    "stream_histograms": stream_histograms,
    "alert_sustained": sustained_query,
    "stream_alerts": stream_alerts,
    "cache_lookups": cache_query,
    "cache_stats": cache_stats_query,
    "stream_cache": stream_cache,
}
SQL = {
    "hist_windows": _histogram_sql(f"SELECT strftime(s, {M}) AS start, event_type, value FROM (SELECT *, unnest([time_bucket(INTERVAL 2 HOURS, ts) - to_hours(2 * i) FOR i IN range(3)]) AS s FROM events)", "start, event_type"),
    "hist_merged": _histogram_sql("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, value FROM events", "day, event_type"),
    "stream_histograms": _histogram_sql(f"SELECT {SIX} AS start, event_type, value FROM events", "start, event_type"),
    "alert_sustained": f"WITH {SPANS} SELECT event_type, strftime(pending, {M}) AS pending, strftime(firing, {M}) AS firing, strftime(resolved, {M}) AS resolved, now, base FROM a",
    "stream_alerts": f"""WITH {SPANS}, m AS (SELECT event_type, pending AS "at", 'pending' AS state FROM a UNION ALL SELECT event_type, firing, 'firing' FROM a WHERE firing IS NOT NULL UNION ALL SELECT event_type, resolved, CASE WHEN firing IS NULL THEN 'cancelled' ELSE 'resolved' END FROM a)
     SELECT event_type, strftime("at", {M}) AS "at", state FROM m WHERE epoch_ms("at") <= (SELECT epoch_ms(max(ts)) - {LATE * 1000} FROM events)""",
    "cache_lookups": GETS,
    "cache_stats": f"WITH {ANSWERS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(100 * count(*) FILTER (hit) / count(*)::DOUBLE, 2) AS hit_rate FROM x GROUP BY 1",
    "stream_cache": GETS,
}
