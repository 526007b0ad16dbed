"""Detectors over metrics derived from documents, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import detectors as d
from weftline.session import table

#: Metric -> modulus of the expression over (doc_id, n_chars); spreads every rule's branches over the rows.
PARTS = {
    "loc": "CASE WHEN doc_id % 9 = 1 THEN n_chars % 10 ELSE n_chars % 631 END", "cyclomatic_complexity": "n_chars % 59", "nesting_depth": "n_chars % 7", "parameter_count": "n_chars % 11", "local_variables": "n_chars % 13",
    "return_statements": "n_chars % 8", "method_count": "CASE WHEN doc_id % 9 = 1 THEN n_chars % 2 ELSE n_chars % 37 END", "field_count": "CASE WHEN doc_id % 9 = 1 THEN 0 ELSE n_chars % 23 END", "external_calls": "n_chars % 17", "primitive_params": "n_chars % 9",
    "branch_count": "n_chars % 14", "method_call_chains": "n_chars % 6", "delegation_methods": "n_chars % 19", "comment_count": "n_chars % 97", "doc_comment_count": "n_chars % 12", "override_count": "n_chars % 5",
}
COLUMNS = ", ".join(f"CAST({v} AS INT) AS {k}" for k, v in PARTS.items())
ITEMS = f"SELECT source AS location, CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 2 = 0 THEN 'function' ELSE 'class' END AS item_type, text, {COLUMNS} FROM documents"


def items(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "function").otherwise("class")
    return docs.select(F.col("source").alias("location"), F.col("doc_id").cast("string").alias("name"), kind.alias("item_type"), "text", *[F.expr(f"CAST({v} AS INT)").alias(k) for k, v in PARTS.items()])


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return d.detect_all(items(spark, sf))


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Remedies RF-k and laws LAW-k over smells, from part keys."""
    parts = table(spark, sf, "part")
    smell = lambda c: F.format_string("SMELL-%02d", (c % 23 + 1).cast("int"))
    rf, law = F.format_string("RF-%03d", (F.col("p_partkey") % 40).cast("int")), F.format_string("LAW-%03d", (F.col("p_partkey") % 17).cast("int"))
    edge = lambda s, r, t: parts.select(s.alias("src"), F.lit(r).alias("rel"), t.alias("dst")).distinct()
    e = edge(rf, "solves", smell(F.col("p_size"))).unionAll(edge(smell(F.col("p_partkey")), "violates", law)).unionAll(edge(rf, "enforces", law))
    return e, parts.select(F.format_string("RF-%03d", (F.col("p_partkey") % 40).cast("int")).alias("id"), F.expr("CASE p_partkey % 40 % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END").alias("effort")).distinct()


def one(smell: str):
    return lambda s, sf: findings(s, sf).filter(F.col("smell_id") == smell).select("location", "name", "confidence")


def ranked(spark, sf):
    e, r = graph(spark, sf)
    return d.rank_remedies(findings(spark, sf), e, r, 3)


def duplicates(spark, sf):
    x = items(spark, sf).select("location", "name", F.md5(F.lower(F.regexp_replace("text", "[ \\n\\t]+", " "))).alias("ast_hash"))
    return d.duplicate_code(x).select("location", "name", "copies", "confidence", F.array_join("others", ",").alias("others"))


def project_wide(spark, sf):
    x = items(spark, sf)
    counts = x.select("location", "name", (F.col("loc") % 13).alias("dependencies"), (F.col("loc") % 4).alias("subclasses"), (F.col("loc") % 5).alias("usages"))
    return d.external(x, counts)


def audit(spark, sf):
    return d.severity(findings(spark, sf))


# each detector's confidence in SQL, by smell: (kind, expression over the metrics)
_T = lambda *rules: " + ".join("CASE " + " ".join(f"WHEN {k} > {lim} THEN {v}" for lim, v in sorted(s, reverse=True)) + " ELSE 0 END" for k, s in rules)
CC = "cyclomatic_complexity"
_SUM = lambda fire, x: f"CASE WHEN round({x}, 9) >= {fire} THEN least(round({x}, 9), 1.0) END"
_BR = "CASE WHEN branch_count > 10 THEN 0.9 WHEN branch_count > 7 THEN 0.75 WHEN branch_count > 5 THEN 0.6 END"
_INL = "greatest(comment_count - doc_comment_count, 0)"
_DENSE = f"({_INL} / nullif(loc, 0)::DOUBLE >= 0.35)"
RULES = {
    "SMELL-01": ("function", _SUM(0.5, _T(("loc", [(50, 0.3), (30, 0.15)]), (CC, [(15, 0.4), (10, 0.25)]), ("nesting_depth", [(4, 0.2), (3, 0.1)])))),
    "SMELL-02": ("function", "CASE WHEN parameter_count > 8 THEN 0.95 WHEN parameter_count > 6 THEN 0.85 WHEN parameter_count > 5 THEN 0.7 END"),
    "SMELL-03": ("function", "CASE WHEN primitive_params >= 5 AND primitive_params / nullif(parameter_count, 0)::DOUBLE >= 0.8 THEN 0.85 END"),
    "SMELL-06": ("function", f"least(1.0, {_BR} + CASE WHEN {CC} > 15 THEN 0.15 ELSE 0 END) + 0 * ({_BR})"),
    "SMELL-18": ("function", _SUM(0.5, f"CASE WHEN external_calls > 5 THEN 0.7 ELSE 0 END + CASE WHEN return_statements > 5 THEN 0.3 ELSE 0 END + CASE WHEN {CC} > 8 AND loc < 40 THEN 0.2 ELSE 0 END")),
    "SMELL-20": ("function", "CASE WHEN method_call_chains > 4 THEN 0.9 WHEN method_call_chains > 3 THEN 0.7 END"),
    "SMELL-04": ("class", _SUM(0.5, _T(("method_count", [(20, 0.4), (15, 0.2)]), ("field_count", [(15, 0.3), (10, 0.15)]), ("loc", [(300, 0.3), (200, 0.15)])))),
    "SMELL-07": ("class", "CASE WHEN field_count >= 5 AND method_count = 0 THEN 0.6 WHEN field_count >= 5 AND field_count / nullif(method_count, 0)::DOUBLE >= 2 THEN 0.75 END"),
    "SMELL-10": ("class", f"CASE WHEN {CC} > 25 AND method_count > 15 THEN 0.8 WHEN {CC} > 20 AND method_count > 12 THEN 0.65 WHEN {CC} > 15 AND method_count > 8 THEN 0.55 END + CASE WHEN field_count > 10 THEN 0.1 ELSE 0 END"),
    "SMELL-11": ("class", "CASE WHEN method_count = 0 AND field_count >= 2 THEN NULL WHEN loc < 8 AND method_count = 0 AND field_count = 0 THEN 0.8 WHEN loc < 10 AND method_count <= 1 AND field_count < 3 AND NOT (field_count >= 1 AND method_count = 1) THEN 0.75 END"),
    "SMELL-14": ("class", "CASE WHEN method_count >= 3 AND delegation_methods / nullif(method_count, 0)::DOUBLE > 0.85 THEN 0.85 WHEN method_count >= 3 AND delegation_methods / nullif(method_count, 0)::DOUBLE > 0.7 THEN 0.7 WHEN method_count >= 3 AND external_calls >= method_count AND loc < 50 THEN 0.7 END"),
    "SMELL-21": ("class", _SUM(0.6, _T(("method_count", [(30, 0.35), (25, 0.2)]), ("field_count", [(20, 0.35), (15, 0.2)]), ("loc", [(500, 0.3), (400, 0.15)]), (CC, [(50, 0.2)])))),
    "SMELL-22": ("class", "CASE WHEN override_count >= 3 AND method_count <= 5 AND override_count / nullif(method_count, 0)::DOUBLE >= 0.5 THEN 0.75 WHEN override_count >= 2 AND method_count <= 4 THEN 0.7 WHEN field_count >= 8 AND method_count <= 2 AND override_count > 0 THEN 0.55 WHEN override_count = 0 AND method_count BETWEEN 1 AND 3 AND field_count <= 2 AND loc < 30 THEN 0.55 END"),
    "SMELL-05": (None, "CASE WHEN parameter_count >= 7 AND primitive_params >= 5 THEN 0.8 WHEN parameter_count >= 6 AND primitive_params >= 4 THEN 0.65 END"),
    "SMELL-16": (None, _SUM(0.65, f"CASE WHEN {_INL} > floor(loc * 0.75) THEN 0.7 WHEN {_INL} > floor(loc * 0.35) THEN 0.4 ELSE 0 END + CASE WHEN loc > 50 AND {_DENSE} THEN 0.25 ELSE 0 END + CASE WHEN {CC} > 10 AND {_DENSE} THEN 0.2 ELSE 0 END")),
}


def _sql(smell: str) -> str:
    kind, rule = RULES[smell]
    where = f" AND item_type = '{kind}'" if kind else ""
    return f"SELECT location, name, round(({rule})::DOUBLE, 6) AS confidence, '{smell}' AS smell_id FROM items WHERE ({rule}) IS NOT NULL{where}"


FOUND = f"WITH items AS ({ITEMS}), found AS (" + " UNION ALL ".join(map(_sql, RULES)) + ")"
_GRAPH = """, e AS (SELECT DISTINCT printf('RF-%03d', p_partkey % 40) AS src, 'solves' AS rel, printf('SMELL-%02d', p_size % 23 + 1) AS dst FROM part
 UNION ALL SELECT DISTINCT printf('SMELL-%02d', p_partkey % 23 + 1), 'violates', printf('LAW-%03d', p_partkey % 17) FROM part
 UNION ALL SELECT DISTINCT printf('RF-%03d', p_partkey % 40), 'enforces', printf('LAW-%03d', p_partkey % 17) FROM part),
 r AS (SELECT DISTINCT printf('RF-%03d', p_partkey % 40) AS remedy, CASE p_partkey % 40 % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.3 END AS w FROM part),
 pairs AS (SELECT s.dst AS smell_id, remedy, 0.3 * w + 0.2 * CASE WHEN b > 0 THEN coalesce(k, 0) / b::DOUBLE ELSE 0.5 END + 0.1 * least(1.0, coalesce(u, 0) / 20.0::DOUBLE) AS base
  FROM e s JOIN r ON remedy = s.src LEFT JOIN (SELECT src, count(*) AS b FROM e WHERE rel = 'violates' GROUP BY src) v ON v.src = s.dst
  LEFT JOIN (SELECT src, count(*) AS u FROM e GROUP BY src) n ON n.src = remedy
  LEFT JOIN (SELECT x.src AS rf, y.src AS sm, count(*) AS k FROM e x JOIN e y ON x.dst = y.dst WHERE x.rel = 'enforces' AND y.rel = 'violates' GROUP BY ALL) o ON o.rf = remedy AND o.sm = s.dst WHERE s.rel = 'solves')"""

QUERIES = {f"detect_{k[-2:]}": one(k) for k in RULES} | {
    "detect_all": lambda s, sf: findings(s, sf).groupBy("smell_id", "smell_name").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total")),
    "detect_reasons": lambda s, sf: findings(s, sf).filter("smell_id = 'SMELL-02'").select("name", F.array_join("reasons", "; ").alias("reasons")),
    "detect_severity": audit,
    "detect_project_wide": project_wide,
    "dup_code_hash": duplicates,
    "rank_remedies": ranked,
}
SQL = {f"detect_{k[-2:]}": FOUND + f" SELECT location, name, confidence FROM found WHERE smell_id = '{k}'" for k in RULES} | {
    "detect_reasons": FOUND + " SELECT name, 'parameter_count=' || (n_chars % 11) || ' parameters' AS reasons FROM found JOIN documents ON doc_id = name::BIGINT WHERE smell_id = 'SMELL-02'",
    "detect_severity": FOUND + " SELECT count(*) FILTER (confidence >= 0.7) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS medium, CASE WHEN count(*) FILTER (confidence >= 0.5) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM found",
    "detect_project_wide": f"""WITH items AS ({ITEMS}), x AS (SELECT *, loc % 13 AS dep, loc % 4 AS sub, loc % 5 AS us FROM items)
     SELECT location, name, 'SMELL-09' AS smell_id, 'Shotgun Surgery' AS smell_name, (CASE WHEN dep >= 10 THEN 0.8 ELSE 0.65 END)::DOUBLE AS confidence FROM x WHERE dep >= 7 UNION ALL
     SELECT * FROM (SELECT location, name, 'SMELL-12', 'Speculative Generality', greatest(CASE WHEN sub = 1 THEN 0.75 END, CASE WHEN us = 0 AND method_count > 0 THEN 0.85 END, CASE WHEN us = 1 AND method_count > 3 THEN 0.6 END, CASE WHEN sub = 1 AND us <= 1 THEN 0.9 END)::DOUBLE AS c FROM x) WHERE c >= 0.6""",
    "dup_code_hash": """WITH x AS (SELECT source AS location, doc_id::VARCHAR AS name, md5(lower(regexp_replace(text, '[ \\n\\t]+', ' ', 'g'))) AS h FROM documents),
     r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY location, name) AS r, count(*) OVER (PARTITION BY h) AS copies FROM x),
     heads AS (SELECT h, list(location ORDER BY location) AS heads FROM r WHERE r <= 4 GROUP BY h)
     SELECT location, name, copies, round(least(0.95, 0.7 + 0.1 * (copies - 1)), 6)::DOUBLE AS confidence, array_to_string(list_filter(heads, lambda v: v <> location)[1:3], ',') AS others FROM r JOIN heads USING (h) WHERE copies > 1""",
    "rank_remedies": FOUND + _GRAPH + """ SELECT location, name, smell_id, remedy, round(0.4 * confidence + base, 6) AS priority, row_number() OVER (PARTITION BY location, name, smell_id ORDER BY round(0.4 * confidence + base, 6) DESC, remedy)::INT AS rank
     FROM found JOIN pairs USING (smell_id) QUALIFY rank <= 3""",
}
NAMES = {"SMELL-01": "Long Method", "SMELL-02": "Long Parameter List", "SMELL-03": "Primitive Obsession", "SMELL-04": "Large Class", "SMELL-05": "Data Clumps", "SMELL-06": "Switch Statements", "SMELL-07": "Data Class", "SMELL-10": "Divergent Change", "SMELL-11": "Lazy Class", "SMELL-14": "Middle Man", "SMELL-16": "Comments", "SMELL-18": "Feature Envy", "SMELL-20": "Message Chains", "SMELL-21": "God Object", "SMELL-22": "Refused Bequest"}
SQL["detect_all"] = FOUND + " SELECT smell_id, CASE smell_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END AS smell_name, count(*) AS n, round(sum(confidence), 4) AS total FROM found GROUP BY ALL"
