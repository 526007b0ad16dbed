"""Projections, budgets, expansion, incremental sinks and code items over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import detectors, graph, retrieval as r
from weftline.session import table
from weftline.sources import code_items, files


def context(spark, sf):
    """Parts with a context map: benefits and drawbacks by size and price."""
    p = table(spark, sf, "part")
    ctx = F.create_map(F.lit("benefits"), F.array("p_brand", "p_type", F.col("p_size").cast("string")), F.lit("drawbacks"), F.array(F.concat(F.lit("size "), F.col("p_size").cast("string"))))
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("part").alias("type"), F.col("p_brand").alias("category"), ctx.alias("context"))


def summary_query(spark, sf):
    return r.detail(context(spark, sf), "summary")


def detailed_query(spark, sf):
    d = r.detail(context(spark, sf), "detailed")
    return d.select("id", "title", F.array_join(F.try_element_at("context", F.lit("benefits")), "|").alias("benefits"), F.array_join(F.try_element_at("context", F.lit("drawbacks")), "|").alias("drawbacks"))


def expand_query(spark, sf):
    o = table(spark, sf, "orders")
    res = o.select(F.col("o_custkey").alias("query_id"), F.format_string("SMELL-%02d", (F.col("o_orderkey") % 23 + 1).cast("int")).alias("entity_id"), F.round(F.col("o_totalprice") / 1000, 3).alias("score")).groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
    e = table(spark, sf, "part").select(F.format_string("SMELL-%02d", (F.col("p_size") % 23 + 1).cast("int")).alias("src"), F.when(F.col("p_size") % 23 < 15, "solved_by").otherwise("related_to").alias("rel"), F.format_string("RF-%03d", (F.col("p_partkey") % 40).cast("int")).alias("dst")).distinct()
    return r.expand_remedies(res, e, 8).select("query_id", "entity_id", F.round("score", 6).alias("score"), "rank")


EXPAND = """WITH res AS (SELECT o_custkey AS query_id, printf('SMELL-%02d', o_orderkey % 23 + 1) AS entity_id, max(round(o_totalprice / 1000, 3)) AS score FROM orders GROUP BY ALL),
 e AS (SELECT DISTINCT printf('SMELL-%02d', p_size % 23 + 1) AS src, printf('RF-%03d', p_partkey % 40) AS dst FROM part),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM res), sm AS (SELECT * FROM rk WHERE rank <= 3),
 low AS (SELECT query_id, min(score) * 0.95::DOUBLE AS floor FROM sm GROUP BY 1), f AS (SELECT query_id, dst AS entity_id, min(rank) AS sr FROM sm JOIN e ON src = entity_id GROUP BY ALL),
 a AS (SELECT query_id, entity_id, floor AS score FROM f JOIN low USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sr, entity_id) <= 2), u AS (SELECT query_id, entity_id, score FROM rk UNION ALL SELECT * FROM a)
 SELECT query_id, entity_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id)::INT AS rank FROM u QUALIFY rank <= 8"""


def missing_query(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return files.missing_embeddings(d, table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


def one_sided_query(spark, sf):
    x = table(spark, sf, "events").select((F.col("user_id") % 10).alias("query_id"), F.col("event_id").alias("id"), (F.col("value") - 20).alias("score"))
    return r.one_sided(x, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def edge_upsert_query(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    old = c.select(F.col("c_nationkey").cast("string").alias("src"), F.lit("has").alias("rel"), F.col("c_custkey").cast("string").alias("dst"))
    new = n.select(F.col("n_nationkey").cast("string").alias("src"), F.lit("IN").alias("rel"), F.col("n_regionkey").cast("string").alias("dst"))
    return graph.upsert_edges(old, new.unionAll(new), n.filter("n_regionkey <= 1").select(F.col("n_nationkey").cast("string").alias("id")))


def budget_query(spark, sf):
    own = context(spark, sf).withColumn("query_id", F.col("id").cast("int") % 50).withColumn("rank", F.col("id").cast("int"))
    return r.budget(r.costed(own), 600)


SNIPPET = "def f{k}(a, b, c, d, e, f, g):\n    for x in a:\n        if x:\n            while b:\n                c.d().e().g()\n    return {k}\n\nclass K{k}(B):\n    x = 1\n    def run(self):\n        return self.y.run()\n"


def code(spark, sf):
    """A source file for each supplier."""
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf, "supplier").select(F.concat(F.lit("s"), k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.replace(F.lit(SNIPPET), F.lit("{k}"), k).alias("code"))


def code_query(spark, sf):
    return code_items.code_items(code(spark, sf)).select("location", "name", "item_type", "loc", "cyclomatic_complexity", "nesting_depth", "parameter_count", "method_call_chains")


def code_smells(spark, sf):
    return detectors.detect_all(code_items.code_items(code(spark, sf))).select("location", "name", "smell_id", "confidence")


QUERIES = {"p_summary": summary_query, "p_detailed": detailed_query, "p_budget": budget_query, "expand_related": expand_query, "embed_missing": missing_query, "hybrid_one_sided": one_sided_query, "edge_upsert": edge_upsert_query, "code_items_python": code_query, "code_smells_python": code_smells}
SQL = {
    "p_summary": "SELECT p_partkey::VARCHAR AS id, p_name AS title, 'part' AS type, p_brand AS category, 'benefits: ' || p_brand || '; drawbacks: size ' || p_size AS summary FROM part",
    "p_detailed": "SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand || '|' || p_type AS benefits, 'size ' || p_size AS drawbacks FROM part",
    "expand_related": EXPAND,
    "embed_missing": "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "hybrid_one_sided": "SELECT user_id % 10 AS query_id, event_id AS id, round(abs(value - 20), 6) AS score, row_number() OVER (PARTITION BY user_id % 10 ORDER BY abs(value - 20) DESC, event_id)::INT AS rank FROM events WHERE abs(value - 20) > 0 QUALIFY rank <= 5",
    "edge_upsert": "SELECT DISTINCT c_nationkey::VARCHAR AS src, 'has' AS rel, c_custkey::VARCHAR AS dst FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 1) UNION ALL SELECT DISTINCT n_nationkey::VARCHAR, 'in', n_regionkey::VARCHAR FROM nation",
    "code_items_python": "SELECT 's' || s_suppkey || '.py:' || line AS location, name || s_suppkey AS name, item_type, loc::INT AS loc, cc::INT AS cyclomatic_complexity, nest::INT AS nesting_depth, par::INT AS parameter_count, chain::INT AS method_call_chains FROM supplier, (VALUES (1, 'f', 'function', 6, 4, 3, 7, 0), (8, 'K', 'class', 4, 1, 0, 0, 0)) t(line, name, item_type, loc, cc, nest, par, chain) UNION ALL SELECT 's' || s_suppkey || '.py:10', 'run', 'function', 2, 1, 0, 1, 0 FROM supplier",
}
