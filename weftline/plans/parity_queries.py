"""Lookups, exports, notes, evaluation, budgets and merges over the driver's tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import scalars as s
from weftline.operators import detectors, evaluation as v, graph as g, insights as ins, retrieval as r
from weftline.plans import detector_queries as dq, event_queries as eq, graph_queries as gq, more_queries as mq, retrieval_queries as rq
from weftline.session import buckets, scratch, table
from weftline.sources import code_items, files, kg, versions


def user_notes(spark, sf):
    return table(spark, sf, "supplier").select(F.concat(F.lit("U:"), "s_suppkey").alias("src"), F.lit("derives_from").alias("rel"), F.concat(F.lit("N:"), (F.col("s_suppkey") % 25).cast("string")).alias("dst"))


def export_query(spark, sf):
    """A node of the graph, and one that only notes know."""
    e, x, u = kg.entities(spark, sf), kg.edges(spark, sf), user_notes(spark, sf)
    one = lambda n: g.entity_export(spark, x, e, u, n, 2).withColumn("node", F.lit(n))
    return one("S:1").unionByName(one("U:3"))


def relations(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").cast("string").alias("src"), F.lit("in").alias("rel"), F.col("c_nationkey").cast("string").alias("dst"))
    given = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("src"), F.lit("in").alias("rel"), F.col("s_nationkey").cast("string").alias("dst"))
    return old, given.unionAll(given)


def rollup_query(spark, sf):
    each = v.per_query(eq.results(spark, sf), eq.results(spark, sf).filter("label = 3"), 5)
    x = v.rollup(each.withColumn("tier", F.col("query_id") % 3).withColumn("category", F.col("query_id") % 4), ["tier", "category"])
    return x.select("dimension", "value", "queries", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"))


def buckets_query(spark, sf):
    """Result sizes in classes, and the share of events in each as a percentage of two digits."""
    size = F.floor(F.abs("value"))
    kind = F.when(size == 0, "none").when(size < 5, "few").when(size < 20, "some").otherwise("many")
    x = eq.ev(spark, sf).groupBy("event_type").agg(*[F.count_if(kind == k).alias(k) for k in ("none", "few", "some", "many")], F.count("*").alias("n"))
    return x.withColumn("hit_rate", F.round((F.col("n") - F.col("none")) / F.col("n") * 10000) / 100)


def first_query(spark, sf):
    x = eq.ev(spark, sf).select("user_id", "event_type", "ts", "event_id", "value")
    return v.first_occurrence(x, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def notes(spark, sf):
    c = table(spark, sf, "conversations")
    tags = F.array(F.concat(F.lit("project:"), "role"), F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("title"), F.col("text").alias("content"), F.lit("user").alias("author"), tags.alias("tags"), F.lit(0.5).alias("confidence"))


def _ranked(df):
    """Re-ranks by rounded scores, so that engines agree on ties."""
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return df.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(own))


def search_query(spark, sf):
    """All hits, so that the cut can't fall among ties that engines round differently."""
    return _ranked(ins.search(notes(spark, sf), rq.queries(spark, sf), 1 << 30)).select("query_id", "id", "score", "rank")


def duplicate_query(spark, sf):
    new = spark.createDataFrame([(1, "user", "the"), (2, "in", "and t1"), (3, "assistant", "les")], "query_id int, title string, content string")
    return _ranked(ins.duplicates(notes(spark, sf), new, 1 << 30)).filter("rank <= 5").select("query_id", "id", "score", "rank", "match")


NOTES = """ch AS (SELECT conv_id || '-' || turn AS id, role AS title, 'project:' || role || ' t' || (turn % 3) AS section, text FROM conversations)"""


def _bm(q: str) -> str:
    return rq.BM.replace(rq.CH, NOTES).replace(rq.Q, f"q AS (SELECT * FROM (VALUES {q}) t(query_id, query))").replace("list_distinct(string_split(query, ' '))", "list_distinct(list_filter(string_split(regexp_replace(lower(query), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda t: t <> ''))")


def describe_query(spark, sf):
    e, remedies = dq.graph(spark, sf)
    smells = dq.findings(spark, sf).select("smell_id", "smell_name").distinct()
    ranked = e.filter("rel = 'solves'").select(F.col("src").alias("remedy"), F.col("dst").alias("smell_id")).distinct().join(smells, "smell_id")
    parts = table(spark, sf, "part")
    context = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("benefits"), F.array("p_brand"))).otherwise(F.create_map(F.lit("drawbacks"), F.array("p_brand")))
    entities = parts.select(F.format_string("RF-%03d", F.col("p_partkey").cast("int")).alias("id"), F.col("p_name").alias("title"), context.alias("context")).unionAll(
        parts.select(F.format_string("LAW-%03d", F.col("p_partkey").cast("int")), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise(""), context))
    return detectors.describe(ranked, entities, e).select("remedy", "smell_id", "description")


def clean_query(spark, sf):
    d = table(spark, sf, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("location"), F.col("lang").alias("language"))
    return v.clean_rates(files, dq.findings(spark, sf).filter("confidence >= 0.7").select(F.col("name").alias("location")))


def neighbor_query(spark, sf):
    """Each customer is expected in its nation and in the next one; suppliers without a case stay out."""
    c = table(spark, sf, "customer")
    n = lambda k: F.concat(F.lit("N:"), ((F.col("c_nationkey") + k) % 25).cast("string"))
    cases = c.select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("C:"), "c_custkey").alias("entity_id"), F.array(n(0), n(1), n(F.col("c_custkey") % 3)).alias("expected"), (F.col("c_custkey") % 4).cast("int").alias("min_count"))
    return v.neighbor_cases(cases, kg.edges(spark, sf))


def path_cases_query(spark, sf):
    o = table(spark, sf, "orders")
    cases = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 3 > 0).alias("should_find"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 4).cast("int").alias("expected_length"))
    found = table(spark, sf, "lineitem").filter("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("case_id")).agg((F.max("l_quantity") % 6).cast("int").alias("nodes"))
    return v.path_cases(cases, found)


def prompts(spark):
    return spark.createDataFrame([(1, "Brand#1 PART 1"), (2, "part part 7"), (3, "nothing here")], "query_id int, query string")


def ground_query(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("name"), F.col("p_brand").alias("category"), F.array("p_type", F.col("p_size").cast("string")).alias("tags"))
    return r.ground(e, prompts(spark))


def multi_query(spark, sf):
    """One search for each of a query's types, merged."""
    c, q = rq.chunks(spark, sf), rq.queries(spark, sf)
    types = spark.createDataFrame([(1, "en"), (1, "fr"), (2, "de"), (3, "fr"), (3, "es"), (4, "en")], "query_id int, entity_type string")
    known = c.withColumn("id", F.struct("id", "entity_id", "entity_type"))  # what a hit needs goes with its id, so that chunks are scanned and never shuffled
    hits = r.bm25_scan(known, q).select("query_id", "id.*", F.round("score", 9).alias("score")).join(types, ["query_id", "entity_type"])
    own = Window.partitionBy("query_id", "entity_type").orderBy(F.desc("score"), "id")
    each = hits.withColumn("r", F.row_number().over(own)).filter("r <= 10")
    return r.merge_types(each, 15).select("query_id", "entity_id", F.round("score", 6).alias("score"), "rank")


def fallback_query(spark, sf):
    """Names, tags and context are searched too; homonyms go after the cut."""
    p = table(spark, sf, "part")
    e = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("").alias("title"), F.col("p_name").alias("name"), F.lit("part").alias("type"), F.array("p_brand").alias("tags"), F.create_map(F.lit("benefits"), F.array("p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")))).alias("context"))
    q = spark.createDataFrame([(1, "brand 11"), (2, "part 1 steel size"), (3, "small benefits")], "query_id int, query string")
    no = p.filter("p_size <= 7").select(F.lit(2).alias("query_id"), F.col("p_partkey").cast("string").alias("entity_id"))
    return r.graph_fallback(e, q, 15, no).select("query_id", "id", "total", "in_title", "rank")


def metadata_query(spark, sf):
    e, x = kg.entities(spark, sf), kg.edges(spark, sf)
    chunks = table(spark, sf, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("entity_id"), F.concat(F.lit("S:"), "s_suppkey", F.lit("-C000")).alias("id"))
    m = F.col("metadata")
    return g.chunk_metadata(chunks, e, g.derive_inverses(x, e)).select("id", m["type"].alias("type"), *[F.array_join(m[k], ",").alias(k) for k in ("solves", "solved_by", "enforces", "violates")])


def build_query(spark, sf):
    """Documents as markdown files, and the graph of the tables, built twice into tables kept by version: what the metadata then says. The second run brings half of the documents again and changes nothing."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), F.col("lang").alias("entity_type"), F.left("text", F.lit(20)).alias("title"), F.regexp_replace("text", "\n", "\n## ").alias("text"))
    e, x, at = kg.entities(spark, sf), kg.edges(spark, sf, distinct=False), scratch(spark, "build")
    files.build(spark, d, e, x, at, 1, 64)
    return files.build(spark, d.filter("cast(entity_id AS long) % 2 = 0"), e, x, at, 2, 64)


def text_query(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", F.format_string("**Seen** [RF-%03d] and `[LAW-%03d]`  in\n\n# %s", F.col("o_orderkey").cast("int"), (F.col("o_custkey") % 100).cast("int"), "o_orderpriority").alias("text"), "o_totalprice", "o_orderdate")
    ids = s.entity_ids(F.col("text"))
    return t.select("o_orderkey", s.strip_markdown(F.col("text")).alias("plain"), F.array_join(ids, ",").alias("ids"), s.type_prefix(F.element_at(ids, 2)).alias("prefix"), F.regexp_count("text", F.lit("[A-Z]+")).alias("capitals"), s.saturating_sub(F.col("o_orderkey"), F.lit(100)).alias("less"),
        F.round("o_totalprice", 2).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("days"), s.jaccard(ids, F.array(F.element_at(ids, 1))).alias("same"))


def merged_query(spark, sf):
    e, x, u = kg.entities(spark, sf), kg.edges(spark, sf), user_notes(spark, sf)
    return g.merged_stats(g.stats(e, x), u.select(F.col("src").alias("id")).distinct(), u).select("key", F.round("value", 6).alias("value"))


def recall_query(spark, sf):
    """Smells expected of a class of items, and those found."""
    want = dq.items(spark, sf).filter("parameter_count > 5").select(F.col("name").alias("case_id"), F.explode(F.array(F.lit("SMELL-02"), F.lit("SMELL-05"))).alias("item"))
    return v.set_recall(want, dq.findings(spark, sf).select(F.col("name").alias("case_id"), F.col("smell_id").alias("item")))


def coverage_query(spark, sf):
    a = table(spark, sf, "conversations").filter("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("answer"))
    return v.concept_coverage(a, {"articles": ["the ", "les "], "joins": [" and ", " und "], "of": [" of ", " de "]}).select("id", "covered", F.round("share", 6).alias("share"))


#: Bodies of one shape in several languages: m plain lines, a branch and two returns.
BODIES = {
    "rust": ("fn f{k}(a: i32, b: i32) -> i32 {\n", "    let x = 1;\n", "    if a > b {\n        return 1;\n    }\n    return 2;\n}\n"),
    "go": ("func f{k}(a int, b int) int {\n", "    x := 1\n", "    if a > b {\n        return 1\n    }\n    return 2\n}\n"),
    "java": ("class K{k} {\n    public int f{k}(int a, int b) {\n", "        int x = 1;\n", "        if (a > b) {\n            return 1;\n        }\n        return 2;\n    }\n}\n"),
    "typescript": ("function f{k}(a: number, b: number): number {\n", "    const x = 1;\n", "    if (a > b) {\n        return 1;\n    }\n    return 2;\n}\n"),
    "python": ("def f{k}(a, b):\n", "    x = 1\n", "    if a > b:\n        return 1\n    return 2\n"),
}


def language_files(spark, sf):
    """A file for each part and language; m follows the part's size."""
    k = F.col("p_partkey").cast("string")
    body = lambda n: F.concat(F.replace(F.lit(BODIES[n][0]), F.lit("{k}"), k), F.repeat(F.lit(BODIES[n][1]), F.col("p_size")), F.lit(BODIES[n][2]))
    files = F.explode(F.array(*[F.struct(F.lit(n).alias("language"), body(n).alias("code")) for n in BODIES]))
    parts = table(spark, sf, "part").select("p_partkey", "p_size").repartition(buckets(spark, 4))  # a few bytes make five files: dealt first, as one input split holds a million parts
    return parts.select(F.concat(F.lit("p"), k).alias("p"), files.alias("f")).select(F.concat_ws(".", "p", "f.language").alias("path"), "f.language", "f.code")


def language_query(spark, sf):
    x = code_items.code_items(language_files(spark, sf)).filter("item_type = 'function'")
    return x.select("location", "name", "loc", "parameter_count", "return_statements", "cyclomatic_complexity", "branch_count")


def stream_notes(spark, sf):
    """Notes arriving as a stream are linked batch by batch."""
    source, at = scratch(spark, "notes"), scratch(spark, "links")
    eq.notes(spark, sf).write.parquet(source)
    entities = eq.pages_as_entities(spark, sf)

    def link(batch, number):
        versions.append(ins.detect_links(batch, entities), at, "insight_id", ("links", number))
        versions.append(ins.detect_links(batch, entities), at, "insight_id", ("links", number))  # a batch that is tried again changes nothing

    schema = "id string, title string, content string"
    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(link).option("checkpointLocation", at + "-state").trigger(availableNow=True).start().awaitTermination()
    return versions.read(spark, at, "insight_id string, entity_id string, score double, link_type string").withColumn("score", F.round("score", 6))


QUERIES = {
    "p_title_lookup": lambda a, b: g.title_lookup(table(a, b, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title")), "GIZ"),
    "graph_entity_export": export_query,
    "relation_add": lambda a, b: g.add_relations(*relations(a, b)),
    "relation_remove": lambda a, b: g.remove_relations(*relations(a, b)),
    "graph_merged_stats": merged_query,
    "eval_rollup": rollup_query,
    "result_size_buckets": buckets_query,
    "first_occurrence": first_query,
    "insight_search": search_query,
    "insight_duplicates": duplicate_query,
    "insight_facets": lambda a, b: ins.facets(notes(a, b)),
    "remedy_description": describe_query,
    "eval_clean_rates": clean_query,
    "eval_neighbors": neighbor_query,
    "eval_paths": path_cases_query,
    "eval_set_recall": recall_query,
    "eval_concepts": coverage_query,
    "ground_search": ground_query,
    "multi_type_search": multi_query,
    "graph_fallback_fields": fallback_query,
    "chunk_metadata": metadata_query,
    "build_pipeline": build_query,
    "f_text": text_query,
    "code_languages": language_query,
    "stream_insight_links": stream_notes,
}

_LOC = "(VALUES ('rust', 1, 3), ('go', 1, 3), ('java', 2, 3), ('typescript', 1, 3), ('python', 1, 4)) t(language, line, more)"
SQL = {
    "p_title_lookup": "SELECT p_partkey::VARCHAR AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'giz') ORDER BY id LIMIT 20",
    "graph_entity_export": kg.CTE + """, u AS (SELECT 'U:' || s_suppkey AS src, 'derives_from' AS rel, 'N:' || (s_suppkey % 25) AS dst FROM supplier),
      near AS (SELECT 'S:1' AS id UNION SELECT dst FROM kg_edges WHERE src = 'S:1' AND dst IN (SELECT id FROM kg_entities))
      SELECT DISTINCT src || '-' || rel || '-' || dst AS edge_id, src, rel, dst, 'S:1' AS node FROM kg_edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM kg_entities)
      UNION ALL SELECT src || '-' || rel || '-' || dst, src, rel, dst, 'U:3' FROM u WHERE src = 'U:3' OR dst = 'U:3'""",
    "relation_add": "SELECT c_custkey::VARCHAR AS src, 'in' AS rel, c_nationkey::VARCHAR AS dst FROM customer UNION SELECT s_suppkey::VARCHAR, 'in', s_nationkey::VARCHAR FROM supplier",
    "relation_remove": "SELECT c_custkey::VARCHAR AS src, 'in' AS rel, c_nationkey::VARCHAR AS dst FROM customer WHERE (c_custkey, c_nationkey) NOT IN (SELECT (s_suppkey, s_nationkey) FROM supplier)",
    "graph_merged_stats": gq.SQL["graph_stats"].replace(kg.CTE, kg.CTE + ", base AS (") + """), u AS (SELECT s_suppkey FROM supplier), more AS (SELECT 'entities' AS key, count(*)::DOUBLE AS value FROM u UNION ALL SELECT 'edges', count(*)::DOUBLE FROM u UNION ALL SELECT 'type:insight', count(*)::DOUBLE FROM u)
      SELECT key, round(sum(value), 6) AS value FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY key""",
    "eval_rollup": f"WITH {eq.RES}, w AS (SELECT DISTINCT query_id, id FROM r WHERE label = 3), q AS (SELECT DISTINCT query_id FROM w), f AS (SELECT query_id, min(rank) AS first FROM r JOIN w USING (query_id, id) WHERE rank <= 5 GROUP BY 1), e AS (SELECT query_id, first FROM q LEFT JOIN f USING (query_id)), x AS (SELECT 'tier' AS dimension, (query_id % 3)::VARCHAR AS value, first FROM e UNION ALL SELECT 'category', (query_id % 4)::VARCHAR, first FROM e) SELECT dimension, value, count(*) AS queries, round(avg((first IS NOT NULL)::INT), 6) AS hit_at_k, round(avg(coalesce(1 / first::DOUBLE, 0)), 6) AS mrr FROM x GROUP BY ALL",
    "result_size_buckets": "WITH x AS (SELECT event_type, floor(abs(value)) AS n FROM events) SELECT event_type, count(*) FILTER (n = 0) AS none, count(*) FILTER (n > 0 AND n < 5) AS few, count(*) FILTER (n >= 5 AND n < 20) AS some, count(*) FILTER (n >= 20) AS many, count(*) AS n, round((count(*) - count(*) FILTER (n = 0)) / count(*)::DOUBLE * 10000) / 100 AS hit_rate FROM x GROUP BY 1",
    "first_occurrence": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "insight_search": "WITH " + _bm("(1, 'the'), (2, 'und der'), (3, 'les de'), (4, 'in and')") + " SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)::INT AS rank FROM bm",
    "insight_duplicates": "WITH " + _bm("(1, 'user the'), (2, 'in and t1'), (3, 'assistant les')") + " SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)::INT AS rank, 'partial' AS match FROM bm QUALIFY rank <= 5",
    "insight_facets": "SELECT role AS project, count(*) AS n FROM conversations GROUP BY 1",
    "remedy_description": dq.FOUND + """, rf AS (SELECT DISTINCT printf('RF-%03d', p_partkey % 40) AS remedy, printf('SMELL-%02d', p_size % 23 + 1) AS smell_id FROM part), en AS (SELECT DISTINCT printf('RF-%03d', p_partkey % 40) AS remedy, printf('LAW-%03d', p_partkey % 17) AS law FROM part),
      nm AS (SELECT printf('LAW-%03d', p_partkey) AS law, CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE printf('LAW-%03d', p_partkey) END AS name FROM part),
      th AS (SELECT remedy, string_agg(name, ', ' ORDER BY law) AS laws FROM (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY remedy ORDER BY law) <= 3) JOIN nm USING (law) GROUP BY remedy),
      en2 AS (SELECT printf('RF-%03d', p_partkey) AS remedy, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'improve code structure' END AS benefit FROM part),
      sm AS (SELECT DISTINCT smell_id, CASE smell_id """ + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in dq.NAMES.items()) + """ END AS smell_name FROM found)
      SELECT remedy, smell_id, 'Apply ' || title || ' to ' || benefit || '. This addresses ' || smell_name || ' and improves ' || coalesce(laws, 'code quality') || '.' AS description FROM rf JOIN sm USING (smell_id) JOIN en2 USING (remedy) LEFT JOIN th USING (remedy)""",
    "eval_clean_rates": dq.FOUND + ", b AS (SELECT DISTINCT name FROM found WHERE confidence >= 0.7) SELECT lang AS language, count(*) AS total, count(name) AS flagged, round(count(name) / count(*)::DOUBLE, 6) AS fp_rate, round(1 - round(count(name) / count(*)::DOUBLE, 6), 6) AS specificity FROM documents LEFT JOIN b ON name = doc_id::VARCHAR GROUP BY lang",
    "eval_neighbors": kg.CTE + """, c AS (SELECT c_custkey AS case_id, 'C:' || c_custkey AS src, list_distinct(['N:' || c_nationkey % 25, 'N:' || (c_nationkey + 1) % 25, 'N:' || (c_nationkey + c_custkey % 3) % 25]) AS want, c_custkey % 4 AS least FROM customer),
      f AS (SELECT case_id, count(DISTINCT dst) AS n, count(DISTINCT dst) FILTER (list_contains(want, dst)) AS hits FROM c JOIN kg_edges USING (src) GROUP BY 1)
      SELECT case_id, round(coalesce(hits, 0) / len(want)::DOUBLE, 6) AS coverage, coalesce(hits, 0) / len(want)::DOUBLE >= 0.5 AND coalesce(n, 0) >= least AS hit FROM c LEFT JOIN f USING (case_id)""",
    "eval_paths": """WITH c AS (SELECT o_orderkey AS case_id, o_orderkey % 3 > 0 AS should_find, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 END AS want FROM orders), f AS (SELECT l_orderkey AS case_id, (max(l_quantity) % 6)::INT AS nodes FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
      SELECT case_id, CASE WHEN should_find THEN nodes IS NOT NULL AND (want IS NULL OR nodes <= want + 1) ELSE nodes IS NULL END AS hit FROM c LEFT JOIN f USING (case_id)""",
    "eval_set_recall": dq.FOUND + ", w AS (SELECT name AS case_id, unnest(['SMELL-02', 'SMELL-05']) AS item FROM items WHERE parameter_count > 5) SELECT case_id, count(*) AS n, count(smell_id) AS hits, count(*) = count(smell_id) AS complete FROM w LEFT JOIN found ON name = case_id AND smell_id = item GROUP BY 1",
    "eval_concepts": "WITH x AS (SELECT conv_id || '-' || turn AS id, trim(regexp_replace(regexp_replace(lower(text), '[*_`#>]+', '', 'g'), '\\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL), y AS (SELECT id, (contains(t, 'the ') OR contains(t, 'les '))::INT + (contains(t, ' and ') OR contains(t, ' und '))::INT + (contains(t, ' of ') OR contains(t, ' de '))::INT AS covered FROM x) SELECT id, covered, round(covered / 3.0::DOUBLE, 6) AS share FROM y",
    "ground_search": """WITH q AS (SELECT query_id, list_filter(string_split(lower(query), ' '), lambda w: w <> '') AS words FROM (VALUES (1, 'Brand#1 PART 1'), (2, 'part part 7'), (3, 'nothing here')) t(query_id, query)),
      h AS (SELECT query_id, p_partkey::VARCHAR AS id, len(list_filter(words, lambda w: contains(lower(concat_ws(' ', p_name, p_brand, p_type, p_size)), w)))::INT AS matches FROM part, q)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, id)::INT AS rank FROM h WHERE matches > 0 QUALIFY rank <= 3""",
    "multi_type_search": "WITH " + rq.BM + """, ty AS (SELECT * FROM (VALUES (1, 'en'), (1, 'fr'), (2, 'de'), (3, 'fr'), (3, 'es'), (4, 'en')) t(query_id, lang)),
      e AS (SELECT query_id, entity_id, round(score, 9) AS s FROM bm JOIN ch USING (id) JOIN documents d ON d.doc_id::VARCHAR = entity_id JOIN ty USING (query_id, lang) QUALIFY row_number() OVER (PARTITION BY query_id, lang ORDER BY round(score, 9) DESC, id) <= 10),
      b AS (SELECT query_id, entity_id, max(s) AS s FROM e GROUP BY ALL) SELECT query_id, entity_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entity_id)::INT AS rank FROM b QUALIFY rank <= 15""",
    "graph_fallback_fields": """WITH q AS (SELECT query_id, string_split(query, ' ') AS terms FROM (VALUES (1, 'brand 11'), (2, 'part 1 steel size'), (3, 'small benefits')) t(query_id, query)),
      h AS (SELECT query_id, p_size AS k, p_partkey::VARCHAR AS id, len(list_filter(terms, lambda x: contains(lower(concat_ws(' ', p_name, 'part', p_brand, 'benefits', p_type, 'size ' || p_size)), x)))::INT AS total, len(list_filter(terms, lambda x: contains(lower(p_name), x)))::INT AS in_title FROM part, q),
      c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, in_title DESC, id)::INT AS rank FROM h WHERE total > 0 QUALIFY rank <= 15) SELECT query_id, id, total, in_title, rank FROM c WHERE NOT (query_id = 2 AND k <= 7)""",
    "chunk_metadata": kg.CTE + f", f AS (SELECT * FROM kg_edges UNION ALL {gq._INV}), m AS (SELECT src, rel, string_agg(DISTINCT dst, ',' ORDER BY dst) AS d FROM f GROUP BY ALL) SELECT 'S:' || s_suppkey || '-C000' AS id, 'supplier' AS type, " + ", ".join(f"coalesce((SELECT d FROM m WHERE src = 'S:' || s_suppkey AND rel = '{k}'), '') AS {k}" for k in ("solves", "solved_by", "enforces", "violates")) + " FROM supplier",
    "build_pipeline": kg.CTE + f""", p AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## ')) AS part, generate_subscripts(string_split(replace(text, chr(10), chr(10) || '## '), chr(10) || '## '), 1) AS pos FROM documents),
      t AS (SELECT doc_id, {rq.TRIM.format("CASE WHEN pos = 1 THEN part ELSE '## ' || part END")} AS text FROM p), k AS (SELECT doc_id FROM t WHERE strlen(text) > 50)
      SELECT 'files' AS key, count(DISTINCT doc_id)::VARCHAR AS value FROM k UNION ALL SELECT 'chunks', count(*)::VARCHAR FROM k UNION ALL SELECT 'embedded', count(*)::VARCHAR FROM k UNION ALL SELECT 'dimension', '64'
      UNION ALL SELECT 'entities', count(DISTINCT id)::VARCHAR FROM kg_entities UNION ALL SELECT 'edges', count(*)::VARCHAR FROM (SELECT DISTINCT src, lower(rel), dst FROM kg_edges)""",
    "f_text": """WITH x AS (SELECT *, printf('RF-%03d', o_orderkey) AS a, printf('LAW-%03d', o_custkey % 100) AS b FROM orders), t AS (SELECT *, '**Seen** [' || a || '] and `[' || b || ']`  in' || chr(10) || chr(10) || '# ' || o_orderpriority AS text FROM x)
      SELECT o_orderkey, trim(regexp_replace(regexp_replace(lower(text), '[*_`#>]+', '', 'g'), '\\s+', ' ', 'g')) AS plain, a || ',' || b AS ids, 'LAW' AS prefix, len(regexp_extract_all(text, '[A-Z]+'))::INT AS capitals, greatest(o_orderkey - 100, 0) AS less, round(o_totalprice, 2) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, (o_orderdate::DATE - DATE '1970-01-01')::INT AS days, 0.5::DOUBLE AS same FROM t""",
    "code_languages": f"SELECT 'p' || p_partkey || '.' || language || ':' || line AS location, 'f' || p_partkey AS name, (p_size + more)::INT AS loc, 2 AS parameter_count, 2 AS return_statements, 2 AS cyclomatic_complexity, 1 AS branch_count FROM part, {_LOC}",
    "stream_insight_links": eq.LINKS,
    "p_budget": """WITH RECURSIVE x AS (SELECT p_partkey AS k, p_partkey % 50 AS q, p_partkey::VARCHAR AS id, 'benefits: ' || p_brand || '; drawbacks: size ' || p_size AS sm, [p_brand, p_type, p_size::VARCHAR] AS b, ['size ' || p_size] AS d, p_name, p_brand FROM part),
      j AS (SELECT k, q, id, json_object('id', id, 'title', p_name, 'type', 'part', 'category', p_brand, 'context', json_object('benefits', b, 'drawbacks', d)) AS j1, json_object('id', id, 'title', p_name, 'type', 'part', 'category', p_brand, 'summary', sm, 'context', json_object('benefits', b[1:2], 'drawbacks', d)) AS j2,
        json_object('id', id, 'title', p_name, 'type', 'part', 'category', p_brand, 'summary', sm) AS j3, json_object('id', id, 'title', p_name, 'type', 'part', 'category', p_brand) AS j4 FROM x),
      c AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY k) AS i, strlen(j1::VARCHAR) // 4 + 20 AS full_, strlen(j2::VARCHAR) // 4 + 20 AS detailed, strlen(j3::VARCHAR) // 4 + 20 AS summary, strlen(j4::VARCHAR) // 4 + 20 AS minimal FROM j),
      w AS (SELECT DISTINCT q, 0::BIGINT AS i, 600::BIGINT AS remaining, NULL::VARCHAR AS id, NULL::VARCHAR AS level FROM c UNION ALL
        SELECT c.q, c.i, remaining - CASE WHEN remaining >= 300 THEN full_ WHEN remaining >= 200 THEN detailed WHEN remaining >= 100 THEN summary ELSE minimal END, c.id, CASE WHEN remaining >= 300 THEN 'full' WHEN remaining >= 200 THEN 'detailed' WHEN remaining >= 100 THEN 'summary' ELSE 'minimal' END
        FROM w JOIN c ON c.q = w.q AND c.i = w.i + 1 WHERE remaining >= 50)
      SELECT q::INT AS query_id, (i - 1)::INT AS place, id, level FROM w WHERE i > 0""",
}
