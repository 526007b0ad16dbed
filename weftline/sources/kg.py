"""The knowledge graph over the driver's tables: entities and typed edges, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import table

ENTITIES = "id string, type string, title string, name string, category string"


def _id(prefix: str, key: str) -> F.Column:
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, title, category."""
    parts = [
        ("region", "R", "r_regionkey", "r_name", F.lit(None).cast("string")),
        ("nation", "N", "n_nationkey", "n_name", F.lit(None).cast("string")),
        ("customer", "C", "c_custkey", "c_name", F.col("c_mktsegment")),
        ("supplier", "S", "s_suppkey", "s_name", F.lit(None).cast("string")),
        ("part", "P", "p_partkey", "p_name", F.col("p_brand")),
        ("orders", "O", "o_orderkey", "o_orderstatus", F.col("o_orderpriority")),
    ]
    kind = {"orders": "order"}
    out = None
    for name, prefix, key, title, category in parts:
        x = table(spark, sf_dir, name).select(_id(prefix, key).alias("id"), F.lit(kind.get(name, name)).alias("type"), F.col(title).alias("title"), category.alias("category"))
        out = x if out is None else out.unionAll(x)
    return out


def edges(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """src, rel, dst. Forward relations only; inverses are derived (graph.derive_inverses). For those who make a set of them anyway they come with repeats, and aren't shuffled for that."""
    once = DataFrame.distinct if distinct else lambda df: df
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, s, rel, d: df.select(s.alias("src"), F.lit(rel).alias("rel"), d.alias("dst"))
    li = t("lineitem")
    heavy = li.filter("l_quantity >= 49").select("l_orderkey", "l_suppkey")
    solves = heavy.join(t("orders").select("o_orderkey", "o_custkey"), heavy.l_orderkey == F.col("o_orderkey"))
    parts = [
        edge(t("nation"), _id("N", "n_nationkey"), "in_region", _id("R", "n_regionkey")),
        edge(t("customer"), _id("C", "c_custkey"), "in_nation", _id("N", "c_nationkey")),
        edge(t("supplier"), _id("S", "s_suppkey"), "in_nation", _id("N", "s_nationkey")),
        edge(t("orders"), _id("O", "o_orderkey"), "placed_by", _id("C", "o_custkey")),
        once(edge(li, _id("O", "l_orderkey"), "contains", _id("P", "l_partkey"))),
        once(edge(solves, _id("C", "o_custkey"), "solves", _id("S", "l_suppkey"))),
        once(edge(li.filter("l_returnflag = 'R' and l_quantity >= 45"), _id("S", "l_suppkey"), "violates", _id("P", "l_partkey"))),
        once(edge(li.filter("l_returnflag = 'N' and l_quantity >= 25"), _id("S", "l_suppkey"), "enforces", _id("P", "l_partkey"))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


#: The same as CTEs for DuckDB; a query's SQL follows them.
CTE = """
WITH RECURSIVE kg_entities AS (
  SELECT 'R:' || r_regionkey AS id, 'region' AS type, r_name AS title, NULL::VARCHAR AS category FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'nation', n_name, NULL FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'customer', c_name, c_mktsegment FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'supplier', s_name, NULL FROM supplier
  UNION ALL SELECT 'P:' || p_partkey, 'part', p_name, p_brand FROM part
  UNION ALL SELECT 'O:' || o_orderkey, 'order', o_orderstatus, o_orderpriority FROM orders
), kg_edges AS (
  SELECT 'N:' || n_nationkey AS src, 'in_region' AS rel, 'R:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'in_nation', 'N:' || c_nationkey FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'in_nation', 'N:' || s_nationkey FROM supplier
  UNION ALL SELECT 'O:' || o_orderkey, 'placed_by', 'C:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'O:' || l_orderkey, 'contains', 'P:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'C:' || o_custkey, 'solves', 'S:' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49
  UNION ALL SELECT DISTINCT 'S:' || l_suppkey, 'violates', 'P:' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45
  UNION ALL SELECT DISTINCT 'S:' || l_suppkey, 'enforces', 'P:' || l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity >= 25
)"""
