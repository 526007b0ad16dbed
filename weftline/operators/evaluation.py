"""Retrieval and detection quality, run deltas and gates, as aggregations over (query_id, id, rank) and judgements (query_id, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hit, rr, ndcg) at k, for every query with a judgement."""
    want = relevant.select("query_id", "id").distinct()
    n = want.groupBy("query_id").agg(F.count("*").alias("n"))
    found = results.filter(F.col("rank") <= k).join(want, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    x = n.join(found, "query_id", "left")
    return x.select("query_id", F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def summary(each: DataFrame) -> DataFrame:
    return each.agg(F.count("*").alias("queries"), F.avg("hit").alias("hit_at_k"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg_at_k"))


def false_positives(results: DataFrame, forbidden: DataFrame, k: int = 5) -> DataFrame:
    """One row: queries with a forbidden id in the first k, and specificity."""
    asked = forbidden.select("query_id").distinct()
    bad = results.filter(F.col("rank") <= k).join(forbidden, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("bad", F.lit(1))
    return asked.join(bad, "query_id", "left").agg(F.count("*").alias("queries"), F.avg(F.coalesce("bad", F.lit(0))).alias("fp_rate")).withColumn("specificity", 1 - F.col("fp_rate"))


def set_recall(expected: DataFrame, found: DataFrame, case: str = "case_id", item: str = "item") -> DataFrame:
    """(case, n, hits, complete): how much of each case's expected set was found."""
    x = expected.select(case, item).distinct().join(found.select(case, item).distinct().withColumn("got", F.lit(1)), [case, item], "left")
    return x.groupBy(case).agg(F.count("*").alias("n"), F.count("got").alias("hits")).withColumn("complete", F.col("n") == F.col("hits"))


def composite(recall: float, fp: float, specificity: float, smell_recall: float) -> float:
    return 0.3 * recall + 0.3 * (1 - fp) + 0.2 * specificity + 0.2 * smell_recall


def deltas(runs: DataFrame, metrics: list[str], order: str = "ts") -> DataFrame:
    """Each metric's change to the run before."""
    own = Window.orderBy(order)  # runs are a handful
    return runs.select(order, *metrics, *[(F.col(m) - F.lag(m).over(own)).alias(f"d_{m}") for m in metrics])


def gate(changes: DataFrame, metrics: list[str], composite_drop: float = 0.02, drop: float = 0.05) -> DataFrame:
    """Fails a run whose composite fell by more than composite_drop or any metric by more than drop."""
    bad = F.coalesce(F.col("d_composite") < -composite_drop, F.lit(False))
    for m in metrics:
        bad = bad | F.coalesce(F.col(f"d_{m}") < -drop, F.lit(False))
    return changes.withColumn("failed", bad)


def latency(df: DataFrame, group: str, value: str) -> DataFrame:
    """mean, p50 (true median), p95 and p99 (element int(n p / 100), no interpolation), min, max."""
    # equal values are counted before a group is ordered, so a group costs its distinct values
    own = Window.partitionBy(group).orderBy("v")
    x = df.select(group, F.col(value).alias("v")).groupBy(group, "v").agg(F.count("*").alias("k"))
    x = x.withColumn("below", F.sum("k").over(own) - F.col("k")).withColumn("n", F.sum("k").over(Window.partitionBy(group)))
    holds = lambda i: (F.col("below") <= i) & (i < F.col("below") + F.col("k"))
    at = lambda p: F.max(F.when(holds(F.least((F.col("n") * p / 100).cast("long"), F.col("n") - 1)), F.col("v")))
    middle = [F.max(F.when(holds(F.floor((F.col("n") - 1 + j) / 2)), F.col("v"))) for j in range(2)]
    mean = F.sum(F.col("v") * F.col("k")) / F.sum("k")
    return x.groupBy(group).agg(mean.alias("mean"), ((middle[0] + middle[1]) / 2).alias("p50"), at(95).alias("p95"), at(99).alias("p99"), F.min("v").alias("min"), F.max("v").alias("max"))


def votes(results: DataFrame, limit: int) -> DataFrame:
    """Several result lists (list_id, query_id, id, rank) merged: most votes, then best rank."""
    v = results.groupBy("query_id", "id").agg(F.count("*").alias("votes"), F.min("rank").alias("best"))
    own = Window.partitionBy("query_id").orderBy(F.desc("votes"), "best", "id")
    return v.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= limit)


def concept_coverage(answers: DataFrame, concepts: dict[str, list[str]]) -> DataFrame:
    """(id, covered, share): a concept is covered if the normalised answer holds any of its aliases."""
    from weftline.functions.scalars import strip_markdown

    text = strip_markdown(F.col("answer"))
    hit = [F.greatest(*[F.contains(text, F.lit(a)).cast("int") for a in aliases], F.lit(0)) for aliases in concepts.values()]
    total = sum(hit[1:], hit[0])
    return answers.select("id", total.alias("covered"), (total / len(concepts)).alias("share"))


def rollup(each: DataFrame, by: list[str]) -> DataFrame:
    """(dimension, value, queries, hit_at_k, mrr): each column of ``by`` on its own, in one pass."""
    dims = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by]))
    return each.select(dims.alias("d"), "hit", "rr").groupBy("d.dimension", "d.value").agg(F.count("*").alias("queries"), F.avg("hit").alias("hit_at_k"), F.avg("rr").alias("mrr"))


def first_occurrence(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, as a pre-aggregated minimum and not by sorting groups."""
    rest = [c for c in rows.columns if c not in by and c not in order]
    return rows.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("f")).select(*by, "f.*")


def clean_rates(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(language, total, flagged, fp_rate, specificity) over files (location, language) that are known to be clean."""
    bad = findings.select("location").distinct().withColumn("bad", F.lit(1))
    x = files.join(bad, "location", "left").groupBy("language").agg(F.count("*").alias("total"), F.count("bad").alias("flagged"))
    rate = F.round(F.col("flagged") / F.col("total"), 6)
    return x.withColumn("fp_rate", rate).withColumn("specificity", F.round(1 - F.col("fp_rate"), 6))


def neighbor_cases(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, coverage, hit) for cases (case_id, entity_id, expected array, min_count): half of the expected neighbours found, and as many as asked for."""
    found = cases.select("case_id", "entity_id").join(edges.select(F.col("src").alias("entity_id"), "dst").distinct(), "entity_id")
    want = cases.select("case_id", F.explode("expected").alias("dst")).distinct()
    got = found.groupBy("case_id").agg(F.count("*").alias("n"))
    both = want.join(found.select("case_id", "dst"), ["case_id", "dst"], "left_semi").groupBy("case_id").agg(F.count("*").alias("both"))
    x = cases.join(got, "case_id", "left").join(both, "case_id", "left")
    wanted = F.size(F.array_distinct("expected"))
    coverage = F.when(wanted > 0, F.coalesce("both", F.lit(0)) / wanted).otherwise(0.0)
    return x.select("case_id", F.round(coverage, 6).alias("coverage"), ((coverage >= 0.5) & (F.coalesce("n", F.lit(0)) >= F.coalesce("min_count", F.lit(0)))).alias("hit"))


def path_cases(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, hit) for cases (case_id, should_find, expected_length) and paths found (case_id, nodes): found, at most one node longer than expected; or not found where none should be."""
    x = cases.join(found.select("case_id", "nodes"), "case_id", "left")
    short = F.col("expected_length").isNull() | (F.col("nodes") <= F.col("expected_length") + 1)
    return x.select("case_id", F.when(F.col("should_find"), F.col("nodes").isNotNull() & short).otherwise(F.col("nodes").isNull()).alias("hit"))
