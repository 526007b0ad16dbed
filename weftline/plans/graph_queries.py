"""Graph queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph as g
from weftline.session import checkpointed, table
from weftline.sources import kg

ORDER = ["region", "nation", "supplier", "customer", "part", "order"]


def _kg(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return kg.entities(spark, sf), kg.edges(spark, sf)


def _user_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A user layer: customers note the nations of the suppliers they solve for, as derives_from."""
    return table(spark, sf, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("src"), F.lit("derives_from").alias("rel"), F.concat(F.lit("N:"), (F.col("s_suppkey") % 25).cast("string")).alias("dst"))


USER = ", user_edges AS (SELECT 'S:' || s_suppkey AS src, 'derives_from' AS rel, 'N:' || (s_suppkey % 25) AS dst FROM supplier)"


def inverse(spark, sf):
    e, x = _kg(spark, sf)
    return g.derive_inverses(x, e).filter(F.col("rel").isin(*g.INVERSE.values())).select("src", "rel", "dst")


def sankey(spark, sf):
    e, x = _kg(spark, sf)
    return g.flow(x, e)


def hop_query(spark, sf):
    e, x = _kg(spark, sf)
    return g.hops(spark, x, "C:1", 4).select("id", "depth", F.array_join("path", ">").alias("path"))


def path_query(spark, sf):
    e, x = _kg(spark, sf)
    x = checkpointed(spark, x.select("src", "dst"))  # both searches read one copy
    return g.shortest_path(spark, x, e, "O:1", "R:1", 5, written=True).union(g.shortest_path(spark, x, e, "C:7", "R:2", 5, written=True)).select(F.array_join("path", ">").alias("path"), "length")


def path_edge_query(spark, sf):
    e, x = _kg(spark, sf)
    return g.path_edges(g.hops(spark, x, "C:1", 4).filter("depth >= 1").select("path")).distinct()


def neighborhood_query(spark, sf):
    _, x = _kg(spark, sf)
    return g.neighborhood(x, "S:1").select("direction", "rel", F.array_join("ids", ",").alias("ids"))


def layered_query(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("id"), F.col("s_name").alias("title"))
    return g.layered(a, b)


def batch_query(spark, sf):
    e, _ = _kg(spark, sf)
    wanted = table(spark, sf, "supplier").select(F.concat(F.lit("C:"), "s_suppkey").alias("id"))
    return e.join(wanted, "id", "left_semi")


def upsert_query(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("title"))
    return g.upsert(a, b)


def visible_query(spark, sf):
    e, x = _kg(spark, sf)
    return g.visible(x, e.filter("type in ('nation', 'supplier', 'region')"))


def degree_query(spark, sf):
    e, x = _kg(spark, sf)
    full = g.derive_inverses(x, e)
    return full.groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


HOPS = kg.CTE + """, walk(id, depth, path) AS (
  SELECT 'C:1', 0, 'C:1' UNION ALL
  SELECT dst, depth + 1, path || '>' || dst FROM walk JOIN kg_edges ON src = id WHERE depth < 4),
first AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""

QUERIES = {
    "graph_inverse": inverse,
    "graph_sankey": sankey,
    "graph_neighbors": lambda s, d: g.neighbors(kg.edges(s, d), "S:1"),
    "graph_neighbors_rel": lambda s, d: g.neighbors(kg.edges(s, d), "S:1", "enforces"),
    "graph_merged_neighbors": lambda s, d: g.merged_neighbors(kg.edges(s, d), _user_edges(s, d), "N:3"),
    "graph_all_edges": lambda s, d: g.all_edges(kg.edges(s, d), "S:3", _user_edges(s, d)),
    "graph_neighborhood": neighborhood_query,
    "graph_neighbors_labelled": lambda s, d: g.labelled(g.neighbors(kg.edges(s, d), "S:1"), kg.entities(s, d)),
    "graph_chain": lambda s, d: g.chain(kg.edges(s, d), "O:1", ["placed_by", "in_nation", "in_region"], s).select(F.array_join("path", ">").alias("path")),
    "graph_hops": hop_query,
    "graph_path": path_query,
    "graph_path_edges": path_edge_query,
    "graph_subgraph": lambda s, d: g.subgraph(s, kg.edges(s, d), kg.entities(s, d), "C:1", 2),
    "graph_transitive": lambda s, d: g.transitive_enforcements(kg.edges(s, d)),
    "graph_contradictions": lambda s, d: g.contradictions(kg.edges(s, d), kg.entities(s, d)),
    "graph_similar": lambda s, d: g.similar(kg.edges(s, d), "S:1", 0.01).select("id", F.round("similarity", 6).alias("similarity")),
    "graph_stats": lambda s, d: g.stats(kg.entities(s, d), kg.edges(s, d)).select("key", F.round("value", 6).alias("value")),
    "graph_tree": lambda s, d: g.tree(kg.entities(s, d), ORDER),
    "graph_export": lambda s, d: g.export(kg.edges(s, d), kg.entities(s, d)),
    "graph_integrity": lambda s, d: g.integrity(kg.edges(s, d), kg.entities(s, d)),
    "graph_degrees": degree_query,
    "graph_visible": visible_query,
    "layer_union": layered_query,
    "entity_batch": batch_query,
    "entity_upsert": upsert_query,
}

_INV = "SELECT DISTINCT dst AS src, CASE rel WHEN 'solves' THEN 'solved_by' WHEN 'enforces' THEN 'enforced_by' ELSE 'violated_by' END AS rel, src AS dst FROM kg_edges WHERE rel IN ('solves','enforces','violates') AND dst IN (SELECT id FROM kg_entities)"

SQL = {
    "graph_inverse": kg.CTE + _INV,
    "graph_sankey": kg.CTE + "SELECT a.type AS src_type, rel, b.type AS dst_type, count(*) AS n FROM kg_edges JOIN kg_entities a ON a.id = src JOIN kg_entities b ON b.id = dst GROUP BY ALL",
    "graph_neighbors": kg.CTE + "SELECT DISTINCT dst AS id FROM kg_edges WHERE src = 'S:1'",
    "graph_neighbors_rel": kg.CTE + "SELECT dst AS id FROM kg_edges WHERE src = 'S:1' AND rel = 'enforces'",
    "graph_merged_neighbors": kg.CTE + USER + "SELECT dst AS id FROM kg_edges WHERE src = 'N:3' UNION SELECT dst FROM user_edges WHERE src = 'N:3' UNION SELECT src FROM user_edges WHERE dst = 'N:3'",
    "graph_all_edges": kg.CTE + USER + "SELECT src, rel, dst FROM kg_edges WHERE src = 'S:3' UNION SELECT src, rel, dst FROM user_edges WHERE src = 'S:3' OR dst = 'S:3'",
    "graph_neighborhood": kg.CTE + "SELECT direction, rel, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT 'out' AS direction, rel, dst AS id FROM kg_edges WHERE src = 'S:1' UNION SELECT DISTINCT 'in', rel, src FROM kg_edges WHERE dst = 'S:1') GROUP BY ALL",
    "graph_neighbors_labelled": kg.CTE + "SELECT DISTINCT id, type, title FROM kg_edges JOIN kg_entities ON id = dst WHERE src = 'S:1'",
    "graph_chain": kg.CTE + "SELECT a.src || '>' || a.dst || '>' || b.dst || '>' || c.dst AS path FROM kg_edges a JOIN kg_edges b ON b.src = a.dst JOIN kg_edges c ON c.src = b.dst WHERE a.src = 'O:1' AND a.rel = 'placed_by' AND b.rel = 'in_nation' AND c.rel = 'in_region'",
    "graph_hops": HOPS + "SELECT id, depth::INT AS depth, min(path) AS path FROM walk JOIN first USING (id, depth) GROUP BY ALL",
    "graph_path": kg.CTE + """, walk(start, id, depth, path) AS (
      SELECT v, v, 0, v FROM (VALUES ('O:1'), ('C:7')) t(v) UNION ALL
      SELECT start, dst, depth + 1, path || '>' || dst FROM walk JOIN kg_edges ON src = id WHERE depth < 5 AND rel IN ('placed_by', 'in_nation', 'in_region', 'contains', 'solves'))
      SELECT path, depth::INT AS length FROM walk WHERE (start, id) IN (('O:1', 'R:1'), ('C:7', 'R:2')) QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, path) = 1""",
    "graph_path_edges": HOPS + """, chosen AS (SELECT string_split(min(path), '>') AS p FROM walk JOIN first USING (id, depth) WHERE depth >= 1 GROUP BY id)
      SELECT DISTINCT i::INT AS step, p[i] AS src, p[i + 1] AS dst FROM (SELECT p, unnest(range(1, len(p))) AS i FROM chosen)""",
    "graph_subgraph": HOPS + "SELECT DISTINCT src, rel, dst FROM kg_edges WHERE src IN (SELECT id FROM first WHERE depth <= 1) AND dst IN (SELECT id FROM kg_entities)",
    "graph_transitive": kg.CTE + "SELECT DISTINCT a.src AS remedy, a.dst AS smell, b.dst AS law FROM kg_edges a JOIN kg_edges b ON b.src = a.dst WHERE a.rel = 'solves' AND b.rel = 'violates' AND NOT EXISTS (SELECT 1 FROM kg_edges c WHERE c.rel = 'enforces' AND c.src = a.src AND c.dst = b.dst)",
    "graph_contradictions": kg.CTE + "SELECT DISTINCT a.src AS id, coalesce(nullif(title, ''), 'Unknown') AS title, a.dst AS target FROM kg_edges a JOIN kg_edges b ON a.src = b.src AND a.dst = b.dst LEFT JOIN kg_entities e ON e.id = a.src WHERE a.rel = 'enforces' AND b.rel = 'violates'",
    "graph_similar": kg.CTE + """, labels AS (SELECT DISTINCT src AS id, rel || ':' || dst AS label FROM kg_edges), n AS (SELECT id, count(*) AS n FROM labels GROUP BY id),
      shared AS (SELECT id, count(*) AS b FROM labels WHERE label IN (SELECT label FROM labels WHERE id = 'S:1') GROUP BY id)
      SELECT id, round(b / (n + (SELECT n FROM n WHERE id = 'S:1') - b), 6) AS similarity FROM n JOIN shared USING (id) WHERE id <> 'S:1' AND b / (n + (SELECT n FROM n WHERE id = 'S:1') - b) >= 0.01""",
    "graph_stats": kg.CTE + """SELECT 'type:' || type AS key, count(*)::DOUBLE AS value FROM kg_entities GROUP BY type
      UNION ALL SELECT 'entities', count(*)::DOUBLE FROM kg_entities UNION ALL SELECT 'edges', count(*)::DOUBLE FROM kg_edges UNION ALL SELECT 'linked', count(DISTINCT src)::DOUBLE FROM kg_edges
      UNION ALL SELECT 'avg_edges', round((SELECT count(*) FROM kg_edges) / (SELECT count(*) FROM kg_entities), 6)""",
    "graph_tree": kg.CTE + "SELECT list_position(['region','nation','supplier','customer','part','order'], type)::INT AS type_rank, upper(type[1]) || type[2:] AS label, coalesce(nullif(category, ''), 'uncategorized') AS category, count(*) AS n, min(id) AS first_id FROM kg_entities GROUP BY ALL",
    "graph_export": kg.CTE + "SELECT DISTINCT src || '-' || rel || '-' || dst AS edge_id, src, rel, dst FROM kg_edges WHERE dst IN (SELECT id FROM kg_entities)",
    "graph_integrity": kg.CTE + """SELECT 'dangling_src' AS "check", count(*) AS n FROM kg_edges WHERE src NOT IN (SELECT id FROM kg_entities) UNION ALL SELECT 'dangling_dst', count(*) FROM kg_edges WHERE dst NOT IN (SELECT id FROM kg_entities)
      UNION ALL SELECT 'stored_inverse', count(*) FROM kg_edges WHERE rel IN ('solved_by','enforced_by','violated_by') UNION ALL SELECT 'self_loop', count(*) FROM kg_edges WHERE src = dst
      UNION ALL SELECT 'repeated', count(*) FROM (SELECT 1 FROM kg_edges GROUP BY src, rel, dst HAVING count(*) > 1)
      UNION ALL SELECT 'largest_relation_bp', floor(max(k) * 10000 / sum(k))::BIGINT FROM (SELECT count(*) AS k FROM kg_edges GROUP BY rel)""",
    "graph_degrees": kg.CTE + f", f AS (SELECT * FROM kg_edges UNION ALL {_INV}) SELECT rel, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM f GROUP BY rel",
    "graph_visible": kg.CTE + ", v AS (SELECT id FROM kg_entities WHERE type IN ('nation','supplier','region')) SELECT src, rel, dst FROM kg_edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)",
    "layer_union": "SELECT c_custkey AS id, c_name AS title, 'canonical' AS layer FROM customer UNION ALL SELECT s_suppkey * 2, s_name, 'user' FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "entity_batch": kg.CTE + "SELECT id, type, title, category FROM kg_entities WHERE id IN (SELECT 'C:' || s_suppkey FROM supplier)",
    "entity_upsert": "SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier",
}
SQL["graph_path"] = SQL["graph_path"].replace(" AND rel IN ('placed_by', 'in_nation', 'in_region', 'contains', 'solves')", "")
