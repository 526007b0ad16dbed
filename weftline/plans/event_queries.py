"""Windows over events, insights over conversations, evaluation over embeddings, and streams, with DuckDB twins."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from weftline.operators import evaluation as v
from weftline.operators import insights as ins
from weftline.session import scratch, table
from weftline.streaming import metrics as m


def ev(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _start(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def rate_query(spark, sf):
    return _start(m.rates(ev(spark, sf), "6 hours", "2 hours", "event_type")).select("start", "event_type", "n", F.round("total", 4).alias("total"), F.round("rate", 9).alias("rate"))


def spike_query(spark, sf):
    return _start(m.spikes(ev(spark, sf), 1.5)).select("start", "event_type", F.round("now", 9).alias("now"), F.round("base", 9).alias("base"))


def session_query(spark, sf):
    x = m.sessions(ev(spark, sf), "30 minutes", "user_id")
    return x.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n", F.round("total", 4).alias("total"))


def notes(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.format_string("TK-%03d", (F.col("conv_id") * 100 + F.col("turn")).cast("int")).alias("id"), F.col("role").alias("title"), F.col("text").alias("content"))


def pages_as_entities(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("title"), F.lit("item").alias("category"))


def link_query(spark, sf):
    return ins.detect_links(notes(spark, sf), pages_as_entities(spark, sf)).select("insight_id", "entity_id", F.round("score", 6).alias("score"), "link_type")


TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(concat_ws(' ', title, content)), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda t: t <> ''))"
LINKS = f"""WITH i AS (SELECT 'TK-' || lpad((conv_id * 100 + turn)::VARCHAR, greatest(3, length((conv_id * 100 + turn)::VARCHAR))::INT, '0') AS insight_id, role AS title, text AS content FROM conversations),
 t AS (SELECT insight_id, {TOKENS} AS terms FROM i), k AS (SELECT *, list_filter(terms, lambda x: strlen(x) >= 3 AND x NOT IN ({", ".join(repr(w) for w in ins.STOP)})) AS words FROM t),
 p AS (SELECT insight_id, item_id::VARCHAR AS entity_id, len(list_filter(terms, lambda x: contains(lower(text || ' item'), x))) AS total, len(terms) AS n FROM k, benchmark WHERE len(list_filter(words, lambda x: contains(lower(text || ' item'), x))) > 0)
 SELECT insight_id, entity_id, round(least(1.0, total / n::DOUBLE), 6)::DOUBLE AS score, CASE WHEN total / n::DOUBLE >= 0.5 THEN 'auto' ELSE 'suggested' END AS link_type FROM p QUALIFY row_number() OVER (PARTITION BY insight_id ORDER BY total DESC, entity_id) <= 5"""


def user_links(spark, sf):
    """Users note the event types and round values they saw."""
    e = ev(spark, sf)
    return e.select(F.col("user_id").alias("src"), F.lit("derives_from").alias("rel"), F.concat("event_type", F.lit(":"), F.floor(F.col("value")).cast("string")).alias("dst"))


def correlation_query(spark, sf):
    return ins.correlations(user_links(spark, sf)).select("a", "b", F.round("shared", 6).alias("shared"), F.round("combined", 6).alias("combined"))


def confirm_query(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit(0.5).alias("confidence"))
    accepted = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("insight_id"), F.col("o_orderkey").cast("string").alias("entity_id"))
    return ins.confirm(spark.createDataFrame([], "src string, rel string, dst string"), base, accepted)[1].select("id", F.round("confidence", 6).alias("confidence"))


def add_query(spark, sf):
    old = table(spark, sf, "supplier").select(F.format_string("TK-%03d", F.col("s_suppkey").cast("int")).alias("id"), F.col("s_name").alias("title"), F.lit("c").alias("content"), F.lit("user").alias("author"), F.array().cast("array<string>").alias("tags"), F.lit(0.5).alias("confidence"))
    new = table(spark, sf, "nation").select(F.col("n_name").alias("title"), F.lit("n").alias("content"), F.lit("user").alias("author"), F.array(F.lit("t")).alias("tags"))
    return ins.add(old, new, "w").select("id", "title", F.array_join("tags", ",").alias("tags"))


def results(spark, sf):
    """Ranked lists over embeddings: query = vec_id modulo 25, relevance by label."""
    e = table(spark, sf, "embeddings")
    from pyspark.sql import Window

    own = Window.partitionBy("query_id").orderBy("vec_id")
    x = e.select((F.col("vec_id") % 25).alias("query_id"), F.col("vec_id").alias("id"), "label", "vec_id")
    return x.withColumn("rank", F.row_number().over(own)).select("query_id", "id", "label", "rank")


def eval_query(spark, sf):
    r = results(spark, sf)
    return v.summary(v.per_query(r, r.filter("label = 3"), 5)).select("queries", *[F.round(c, 6).alias(c) for c in ("hit_at_k", "mrr", "ndcg_at_k")])


def fp_query(spark, sf):
    r = results(spark, sf)
    return v.false_positives(r, r.filter("label = 7"), 5).select("queries", F.round("fp_rate", 6).alias("fp_rate"), F.round("specificity", 6).alias("specificity"))


def delta_query(spark, sf):
    r = ev(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("ts")).agg(F.round(F.avg("value") / 100, 9).alias("composite"), F.round(F.avg(F.col("user_id") / 100), 9).alias("recall"))
    return v.gate(v.deltas(r, ["composite", "recall"]), ["recall"]).select("ts", F.round("d_composite", 6).alias("d_composite"), F.round("d_recall", 6).alias("d_recall"), "failed")


def latency_query(spark, sf):
    return v.latency(ev(spark, sf), "event_type", "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99", "min", "max")])


def votes_query(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("query_id"), F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("rank"))
    return v.votes(e, 5)


def _stream(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    src = path if os.path.isdir(path) else sf
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if os.path.isdir(path) else "events.parquet").parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(spark, df, name, mode):
    """Runs a stream over what is there and reads its Parquet sink."""
    at = scratch(spark, name)
    df.writeStream.format("parquet").option("path", at).option("checkpointLocation", at + "-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(at)


def stream_rates(spark, sf):
    return _drain(spark, m.rates(_stream(spark, sf), "1 hour", None, "event_type", late="10 minutes"), "rates", "append")


def stream_limited(spark, sf):
    x = _stream(spark, sf).select(F.col("user_id").cast("string").alias("client"), "ts", "event_id")
    return _drain(spark, m.rate_limited(x, 20, None), "limited", "append")


W = "strftime({}, '%Y-%m-%d %H:%M:%S')"
QUERIES = {
    "win_rate": rate_query,
    "win_topk": lambda s, d: _start(m.top_labels(m.rates(ev(s, d), "1 day", None, "event_type"), 3, "event_type")).select("start", "event_type", "n", "rank"),
    "win_quantile": lambda s, d: _start(m.quantiles(ev(s, d), "1 day", "event_type")).select("start", "event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")]),
    "win_ratio": lambda s, d: _start(m.ratio(ev(s, d), "6 hours", "event_type", "error")).select("start", "n", "bad", F.round("share", 6).alias("share"), F.round("health", 6).alias("health")),
    "win_spike": spike_query,
    "win_threshold": lambda s, d: _start(m.threshold(ev(s, d), "1 hour", "event_type", 2)),
    "win_session": session_query,
    "counters": lambda s, d: m.counters(ev(s, d), "event_type", "user_id"),
    "insight_links": link_query,
    "insight_correlation": correlation_query,
    "insight_confirm": confirm_query,
    "insight_add": add_query,
    "eval_hit_mrr_ndcg": eval_query,
    "eval_fp": fp_query,
    "eval_delta": delta_query,
    "eval_latency": latency_query,
    "eval_votes": votes_query,
    "stream_rates": stream_rates,
    "stream_rate_limited": stream_limited,
}
RES = "r AS (SELECT vec_id % 25 AS query_id, vec_id AS id, label, row_number() OVER (PARTITION BY vec_id % 25 ORDER BY vec_id) AS rank FROM embeddings)"
SQL = {
    "win_rate": f"SELECT {W.format('s')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(count(*) / 21600.0::DOUBLE, 9) AS rate FROM (SELECT *, unnest([time_bucket(INTERVAL 2 HOURS, ts), time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 2 HOURS, time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 4 HOURS]) AS s FROM events) GROUP BY ALL",
    "win_topk": f"SELECT {W.format('s')} AS start, event_type, n, row_number() OVER (PARTITION BY s ORDER BY n DESC, event_type)::INT AS rank FROM (SELECT date_trunc('day', ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY rank <= 3",
    "win_quantile": f"SELECT {W.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)::TIMESTAMP')} AS start, event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL",
    "win_ratio": f"SELECT {W.format('time_bucket(INTERVAL 6 HOURS, ts)')} AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS share, round(greatest(0.0, 100 - 10 * count(*) FILTER (event_type = 'error') / 360.0::DOUBLE), 6)::DOUBLE AS health FROM events GROUP BY time_bucket(INTERVAL 6 HOURS, ts)",
    "win_spike": f"""WITH a AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS s, event_type, count(*) / 300.0::DOUBLE AS now FROM events GROUP BY ALL), b AS (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS h, event_type, count(*) / 3600.0::DOUBLE AS base FROM events GROUP BY ALL)
     SELECT {W.format('s')} AS start, event_type, round(now, 9) AS now, round(base, 9) AS base FROM a JOIN b USING (event_type) WHERE date_trunc('hour', s) = h AND now > 1.5 * base""",
    "win_threshold": f"SELECT {W.format('s')} AS start, event_type, n FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS s, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE n > 2",
    "win_session": """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
     SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "counters": "SELECT event_type, user_id, count(*) AS total FROM events GROUP BY ALL",
    "insight_links": LINKS,
    "insight_correlation": """WITH o AS (SELECT DISTINCT user_id AS src, event_type || ':' || floor(value)::BIGINT AS dst FROM events), n AS (SELECT src, count(*) AS n FROM o GROUP BY 1)
     SELECT a, b, round(k / (x.n + y.n - k)::DOUBLE, 6) AS shared, round(0.4 * k / (x.n + y.n - k)::DOUBLE + 0.1, 6) AS combined FROM (SELECT p.src AS a, q.src AS b, count(*) AS k FROM o p JOIN o q USING (dst) WHERE p.src < q.src GROUP BY ALL) JOIN n x ON x.src = a JOIN n y ON y.src = b""",
    "insight_confirm": "SELECT c_custkey::VARCHAR AS id, round(least(1.0, 0.5 + 0.05 * count(o_orderkey)), 6)::DOUBLE AS confidence FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "insight_add": "WITH x AS (SELECT max(s_suppkey) AS m FROM supplier) SELECT 'TK-' || lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INT, '0') AS id, s_name AS title, '' AS tags FROM supplier UNION ALL SELECT 'TK-' || lpad((m + row_number() OVER (ORDER BY n_name))::VARCHAR, greatest(3, length((m + 25)::VARCHAR))::INT, '0'), n_name, 't,project:w' FROM nation, x",
    "eval_hit_mrr_ndcg": f"WITH {RES}, w AS (SELECT DISTINCT query_id, id FROM r WHERE label = 3), n AS (SELECT query_id, least(count(*), 5) AS n FROM w GROUP BY 1), f AS (SELECT query_id, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN w USING (query_id, id) WHERE rank <= 5 GROUP BY 1) SELECT count(*) AS queries, round(avg((first IS NOT NULL)::INT), 6) AS hit_at_k, round(avg(coalesce(1 / first::DOUBLE, 0)), 6) AS mrr, round(avg(coalesce(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, n + 1)]), 0)), 6) AS ndcg_at_k FROM n LEFT JOIN f USING (query_id)",
    "eval_fp": f"WITH {RES}, w AS (SELECT query_id, id FROM r WHERE label = 7), q AS (SELECT DISTINCT query_id FROM w), b AS (SELECT DISTINCT query_id FROM r SEMI JOIN w USING (query_id, id) WHERE rank <= 5) SELECT count(*) AS queries, round(avg((b.query_id IS NOT NULL)::INT), 6) AS fp_rate, round(1 - avg((b.query_id IS NOT NULL)::INT), 6) AS specificity FROM q LEFT JOIN b USING (query_id)",
    "eval_delta": "WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS ts, round(avg(value) / 100, 9) AS composite, round(avg(user_id / 100::DOUBLE), 9) AS recall FROM events GROUP BY 1), d AS (SELECT ts, composite - lag(composite) OVER (ORDER BY ts) AS dc, recall - lag(recall) OVER (ORDER BY ts) AS dr FROM r) SELECT ts, round(dc, 6) AS d_composite, round(dr, 6) AS d_recall, coalesce(dc < -0.02, false) OR coalesce(dr < -0.05, false) AS failed FROM d",
    "eval_latency": "WITH x AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(v), 6) AS mean, round(median(v), 6) AS p50, round(max(v) FILTER (i = least(n * 95 // 100, n - 1)), 6) AS p95, round(max(v) FILTER (i = least(n * 99 // 100, n - 1)), 6) AS p99, round(min(v), 6) AS min, round(max(v), 6) AS max FROM x GROUP BY 1",
    "eval_votes": "WITH v AS (SELECT l_orderkey % 10 AS query_id, l_suppkey AS id, count(*) AS votes, min(l_linenumber) AS best FROM lineitem GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best, id)::INT AS rank FROM v QUALIFY rank <= 5",
}
