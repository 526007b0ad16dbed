"""Smell detectors and remedy ranking as Catalyst expressions over a metrics table.

A detector is a confidence column (null: no finding) and an array of reasons.
``detect_all`` builds one struct for each detector of the item's kind and
explodes the findings: one pass, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["loc", "cyclomatic_complexity", "nesting_depth", "parameter_count", "local_variables", "return_statements", "method_count", "field_count", "external_calls", "primitive_params", "branch_count", "method_call_chains", "delegation_methods", "comment_count", "doc_comment_count", "override_count"]


def m(name: str) -> Column:
    return F.col(name)


@dataclass(frozen=True)
class Detector:
    smell_id: str
    name: str
    confidence: Column
    reasons: list[tuple[Column, str, str]]  # when, metric, text

    def finding(self) -> Column:
        says = F.filter(F.array(*[F.when(c, F.concat(F.lit(f"{k}="), F.col(k).cast("string"), F.lit(" " + t))) for c, k, t in self.reasons]), lambda x: x.isNotNull())
        return F.when(self.confidence.isNotNull(), F.struct(F.lit(self.smell_id).alias("smell_id"), F.lit(self.name).alias("smell_name"), F.round(self.confidence, 6).alias("confidence"), says.alias("reasons")))


def tiers(fire: float, *rules: tuple[str, list[tuple[int, float]]]) -> tuple[Column, list]:
    """Sums, for each metric, the points of the highest threshold exceeded; fires at a sum, capped at 1."""
    total, says = F.lit(0.0), []
    for metric, steps in rules:
        c = F.lit(0.0)
        for limit, points in sorted(steps):
            c = F.when(m(metric) > limit, F.lit(points)).otherwise(c)
            says.append((_only(metric, limit, steps), metric, f"exceeds {limit}"))
        total = total + c
    total = F.round(total, 9)
    return F.when(total >= fire, F.least(total, F.lit(1.0))), says


def _only(metric: str, limit: int, steps: list[tuple[int, float]]) -> Column:
    above = [x for x, _ in steps if x > limit]
    return (m(metric) > limit) & (m(metric) <= min(above)) if above else m(metric) > limit


def ladder(metric: str, steps: list[tuple[int, float]]) -> Column:
    """The value of the highest threshold exceeded, else null."""
    c = F.lit(None).cast("double")
    for limit, value in sorted(steps):
        c = F.when(m(metric) > limit, F.lit(value)).otherwise(c)
    return c


def cases(*pairs: tuple[Column, float]) -> Column:
    """The value of the first condition that holds, else null."""
    out = F.lit(None).cast("double")
    for c, v in reversed(pairs):
        out = F.when(c, F.lit(v)).otherwise(out)
    return out


def ratio(a: str, b: str) -> Column:
    return m(a) / F.nullif(m(b), F.lit(0))


def _detectors() -> tuple[list[Detector], list[Detector], list[Detector]]:
    c, says = tiers(0.5, ("loc", [(50, 0.30), (30, 0.15)]), ("cyclomatic_complexity", [(15, 0.40), (10, 0.25)]), ("nesting_depth", [(4, 0.20), (3, 0.10)]))
    d01 = Detector("SMELL-01", "Long Method", c, says)
    d02 = Detector("SMELL-02", "Long Parameter List", ladder("parameter_count", [(8, 0.95), (6, 0.85), (5, 0.70)]), [(m("parameter_count") > 5, "parameter_count", "parameters")])
    d03 = Detector("SMELL-03", "Primitive Obsession", cases(((m("primitive_params") >= 5) & (ratio("primitive_params", "parameter_count") >= 0.8), 0.85)), [(F.lit(True), "primitive_params", "primitive parameters")])
    branch = ladder("branch_count", [(10, 0.90), (7, 0.75), (5, 0.60)])
    d06 = Detector("SMELL-06", "Switch Statements", F.when(branch.isNotNull(), F.least(F.lit(1.0), branch + F.when(m("cyclomatic_complexity") > 15, 0.15).otherwise(0.0))), [(F.lit(True), "branch_count", "branches"), (m("cyclomatic_complexity") > 15, "cyclomatic_complexity", "exceeds 15")])
    envy = F.round(F.when(m("external_calls") > 5, 0.70).otherwise(0.0) + F.when(m("return_statements") > 5, 0.30).otherwise(0.0) + F.when((m("cyclomatic_complexity") > 8) & (m("loc") < 40), 0.20).otherwise(0.0), 9)
    d18 = Detector("SMELL-18", "Feature Envy", F.when(envy >= 0.5, F.least(envy, F.lit(1.0))), [(m("external_calls") > 5, "external_calls", "exceeds 5"), (m("return_statements") > 5, "return_statements", "exceeds 5")])
    d20 = Detector("SMELL-20", "Message Chains", ladder("method_call_chains", [(4, 0.90), (3, 0.70)]), [(F.lit(True), "method_call_chains", "calls in a chain")])
    c, says = tiers(0.5, ("method_count", [(20, 0.40), (15, 0.20)]), ("field_count", [(15, 0.30), (10, 0.15)]), ("loc", [(300, 0.30), (200, 0.15)]))
    d04 = Detector("SMELL-04", "Large Class", c, says)
    d05 = Detector("SMELL-05", "Data Clumps", cases(((m("parameter_count") >= 7) & (m("primitive_params") >= 5), 0.80), ((m("parameter_count") >= 6) & (m("primitive_params") >= 4), 0.65)), [(F.lit(True), "parameter_count", "parameters travel together")])
    d07 = Detector("SMELL-07", "Data Class", cases(((m("field_count") >= 5) & (m("method_count") == 0), 0.60), ((m("field_count") >= 5) & (ratio("field_count", "method_count") >= 2), 0.75)), [(F.lit(True), "field_count", "fields")])
    change = cases(((m("cyclomatic_complexity") > 25) & (m("method_count") > 15), 0.80), ((m("cyclomatic_complexity") > 20) & (m("method_count") > 12), 0.65), ((m("cyclomatic_complexity") > 15) & (m("method_count") > 8), 0.55))
    d10 = Detector("SMELL-10", "Divergent Change", F.when(change.isNotNull(), F.least(F.lit(1.0), change + F.when(m("field_count") > 10, 0.10).otherwise(0.0))), [(F.lit(True), "method_count", "methods"), (m("field_count") > 10, "field_count", "exceeds 10")])
    holder = (m("method_count") == 0) & (m("field_count") >= 2)
    lazy = cases((holder, float("nan")), ((m("loc") < 8) & (m("method_count") == 0) & (m("field_count") == 0), 0.80), ((m("loc") < 10) & (m("method_count") <= 1) & (m("field_count") < 3) & ~((m("field_count") >= 1) & (m("method_count") == 1)), 0.75))
    d11 = Detector("SMELL-11", "Lazy Class", F.when(~F.isnan(lazy), lazy), [(F.lit(True), "loc", "lines")])
    share = ratio("delegation_methods", "method_count")
    d14 = Detector("SMELL-14", "Middle Man", cases(((m("method_count") >= 3) & (share > 0.85), 0.85), ((m("method_count") >= 3) & (share > 0.7), 0.70), ((m("method_count") >= 3) & (m("external_calls") >= m("method_count")) & (m("loc") < 50), 0.70)), [(F.lit(True), "delegation_methods", "delegating methods")])
    inline = F.greatest(m("comment_count") - m("doc_comment_count"), F.lit(0))
    dense = inline / F.nullif(m("loc"), F.lit(0)) >= 0.35
    much = F.round(F.when(inline > F.floor(m("loc") * 0.75), 0.70).when(inline > F.floor(m("loc") * 0.35), 0.40).otherwise(0.0) + F.when((m("loc") > 50) & dense, 0.25).otherwise(0.0) + F.when((m("cyclomatic_complexity") > 10) & dense, 0.20).otherwise(0.0), 9)
    d16 = Detector("SMELL-16", "Comments", F.when(much >= 0.65, F.least(much, F.lit(1.0))), [(F.lit(True), "comment_count", "comment lines")])
    c, says = tiers(0.6, ("method_count", [(30, 0.35), (25, 0.20)]), ("field_count", [(20, 0.35), (15, 0.20)]), ("loc", [(500, 0.30), (400, 0.15)]), ("cyclomatic_complexity", [(50, 0.20)]))
    d21 = Detector("SMELL-21", "God Object", c, says)
    over = ratio("override_count", "method_count")
    d22 = Detector(
        "SMELL-22", "Refused Bequest",
        cases(((m("override_count") >= 3) & (m("method_count") <= 5) & (over >= 0.5), 0.75), ((m("override_count") >= 2) & (m("method_count") <= 4), 0.70), ((m("field_count") >= 8) & (m("method_count") <= 2) & (m("override_count") > 0), 0.55), ((m("override_count") == 0) & m("method_count").between(1, 3) & (m("field_count") <= 2) & (m("loc") < 30), 0.55)),
        [(F.lit(True), "override_count", "overrides")],
    )
    return [d01, d02, d03, d06, d18, d20], [d04, d07, d11, d10, d14, d21, d22], [d05, d16]


def detect_all(items: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(location, name, smell_id, smell_name, confidence, reasons) for every finding; functions and classes have their own detectors, two apply to both."""
    functions, classes, both = _detectors()
    pick = lambda ds, kind: [F.when(F.col("item_type") == kind, d.finding()) for d in ds]
    found = F.array(*pick(functions, "function"), *pick(classes, "class"), *[d.finding() for d in both])
    out = items.select("location", "name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return out.select("location", "name", "f.smell_id", "f.smell_name", "f.confidence", "f.reasons").filter(F.col("confidence") >= min_confidence)


def external(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Findings that need project-wide counts (location, name, dependencies, subclasses, usages): shotgun surgery and speculative generality."""
    x = items.join(counts, ["location", "name"])
    shotgun = cases((F.col("dependencies") >= 10, 0.80), (F.col("dependencies") >= 7, 0.65))
    general = F.greatest(
        cases((F.col("subclasses") == 1, 0.75)), cases(((F.col("usages") == 0) & (m("method_count") > 0), 0.85)),
        cases(((F.col("usages") == 1) & (m("method_count") > 3), 0.60)), cases(((F.col("subclasses") == 1) & (F.col("usages") <= 1), 0.90)),
    )
    made = F.array(
        F.when(shotgun.isNotNull(), F.struct(F.lit("SMELL-09").alias("smell_id"), F.lit("Shotgun Surgery").alias("smell_name"), shotgun.alias("confidence"))),
        F.when(general >= 0.6, F.struct(F.lit("SMELL-12").alias("smell_id"), F.lit("Speculative Generality").alias("smell_name"), general.alias("confidence"))),
    )
    return x.select("location", "name", F.explode(F.filter(made, lambda v: v.isNotNull())).alias("f")).select("location", "name", "f.*")


def duplicate_code(items: DataFrame, hash_col: str = "ast_hash", listed: int = 3) -> DataFrame:
    """(location, name, copies, confidence, others): items whose hash occurs more than once; at most ``listed`` other locations are named."""
    own = Window.partitionBy(hash_col)
    ranked = items.filter(F.col(hash_col).isNotNull()).withColumn("r", F.row_number().over(own.orderBy("location", "name")))
    # the first listed + 1 locations of a hash serve all its items, so no group is collected
    heads = ranked.filter(F.col("r") <= listed + 1).groupBy(hash_col).agg(F.array_sort(F.collect_list("location")).alias("heads"))
    size = items.groupBy(hash_col).agg(F.count("*").alias("copies")).filter("copies > 1")
    both = items.join(size, hash_col).join(heads, hash_col)
    others = F.slice(F.filter("heads", lambda x: x != F.col("location")), 1, listed)
    return both.select("location", "name", "copies", F.round(F.least(F.lit(0.95), F.lit(0.7) + F.lit(0.1) * (F.col("copies") - 1)), 6).alias("confidence"), others.alias("others"))


def severity(findings: DataFrame) -> DataFrame:
    """One row: high, medium, and the verdict."""
    high, medium = F.count_if(F.col("confidence") >= 0.7), F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") < 0.7))
    return findings.agg(high.alias("high"), medium.alias("medium")).withColumn("verdict", F.when(F.col("high") + F.col("medium") == 0, "PASS").otherwise("FAIL"))


def effort(when_to_use: Column, benefits: Column) -> Column:
    """small, medium or large, by words in two texts."""
    return F.when(F.lower(when_to_use).contains("simple") | F.lower(benefits).contains("quick"), "small").when(F.lower(when_to_use).contains("complex") | F.lower(when_to_use).contains("significant"), "large").otherwise("medium")


EFFORT = {"small": 1.0, "medium": 0.6, "large": 0.3}


def rank_remedies(findings: DataFrame, edges: DataFrame, remedies: DataFrame, top_k: int = 3) -> DataFrame:
    """(location, name, smell_id, remedy, priority, rank).

    edges (src, rel, dst) with solves, violates, enforces; remedies (id, effort).
    priority = .4 confidence + .3 effort + .2 alignment + .1 usage; alignment is
    the share of the laws the smell violates that the remedy enforces, a half if
    it violates none; usage is the remedy's edges over 20, at most 1.
    """
    top_k = min(10, max(1, top_k))
    solves = edges.filter("rel = 'solves'").select(F.col("src").alias("remedy"), F.col("dst").alias("smell_id")).distinct()
    laws = edges.filter("rel = 'violates'").select(F.col("src").alias("smell_id"), F.col("dst").alias("law")).distinct()
    held = edges.filter("rel = 'enforces'").select(F.col("src").alias("remedy"), F.col("dst").alias("law")).distinct()
    broken = laws.groupBy("smell_id").agg(F.count("*").alias("broken"))
    kept = solves.join(laws, "smell_id").join(held, ["remedy", "law"]).groupBy("remedy", "smell_id").agg(F.count("*").alias("kept"))
    usage = edges.groupBy(F.col("src").alias("remedy")).agg(F.count("*").alias("uses"))
    weight = F.create_map(*[F.lit(x) for p in EFFORT.items() for x in p])
    pairs = solves.join(kept, ["remedy", "smell_id"], "left").join(broken, "smell_id", "left").join(usage, "remedy", "left").join(remedies.select(F.col("id").alias("remedy"), "effort"), "remedy")
    alignment = F.when(F.col("broken") > 0, F.coalesce("kept", F.lit(0)) / F.col("broken")).otherwise(0.5)
    base = 0.3 * weight[F.col("effort")] + 0.2 * alignment + 0.1 * F.least(F.lit(1.0), F.coalesce("uses", F.lit(0)) / 20)
    scored = findings.join(pairs.select("smell_id", "remedy", base.alias("base")), "smell_id").withColumn("priority", F.round(0.4 * F.col("confidence") + F.col("base"), 6))
    own = Window.partitionBy("location", "name", "smell_id").orderBy(F.desc("priority"), "remedy")
    return scored.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top_k).select("location", "name", "smell_id", "remedy", "priority", "rank")


def describe(ranked: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked remedies (remedy, smell_name) with a sentence: the remedy's title, its first benefit, the smell, and up to three laws it enforces by id.

    entities (id, title, context) name remedies and laws.
    """
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown"))
    laws = edges.filter("rel = 'enforces'").select(F.col("src").alias("remedy"), F.col("dst").alias("law")).distinct()
    own = Window.partitionBy("remedy").orderBy("law")
    named = laws.withColumn("r", F.row_number().over(own)).filter("r <= 3").join(entities.select(F.col("id").alias("law"), F.coalesce(F.nullif("title", F.lit("")), F.col("id")).alias("name")), "law")
    three = named.groupBy("remedy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("laws"))
    of = entities.select(F.col("id").alias("remedy"), title.alias("title"), F.coalesce(F.try_element_at(F.try_element_at("context", F.lit("benefits")), F.lit(1)), F.lit("improve code structure")).alias("benefit"))
    x = ranked.join(of, "remedy").join(three, "remedy", "left")
    return x.withColumn("description", F.format_string("Apply %s to %s. This addresses %s and improves %s.", "title", "benefit", "smell_name", F.coalesce("laws", F.lit("code quality")))).drop("title", "benefit", "laws")
