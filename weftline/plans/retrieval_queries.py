"""Retrieval over documents, conversations and embeddings, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalars as s
from weftline.operators import matching, retrieval as r
from weftline.session import table

#: Our own small lexicon of query intents (key, term).
LEXICON = [("english", "the"), ("english", "tion"), ("english", "with"), ("english", "and"), ("french", "les"), ("french", "eux"), ("french", "pour"), ("french", "une"), ("german", "und"), ("german", "keit"), ("german", "der"), ("german", "sch"), ("spanish", "ción"), ("spanish", "que"), ("spanish", "los"), ("spanish", "mente")]
SYNONYMS = [("the", "1"), ("in the", "2"), ("und", "3"), ("les", "4"), ("que", "5"), ("of the", "6")]
#: Sections that lines of documents take in turn.
SECTION = ["Overview", "Intent", "When to use", "Notes"]
_VALUES = lambda rows: "(VALUES " + ", ".join("('" + "', '".join(x) + "')" for x in rows) + ")"

WORDS = "list_filter(string_split_regex(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"

def chunks(spark, sf):
    """Lines of documents as chunks; the entity is the document."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("entity_id"), "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        F.concat_ws("-", "entity_id", F.col("pos").cast("string")).alias("id"), "entity_id", F.col("lang").alias("entity_type"), F.left("text", F.lit(20)).alias("title"), F.element_at(F.array(*map(F.lit, SECTION)), (F.col("pos") % 4 + 1).cast("int")).alias("section"), "text"
    )


CH = "ch AS (SELECT entity_id || '-' || pos AS id, entity_id, left(text, 20) AS title, ['Overview', 'Intent', 'When to use', 'Notes'][pos % 4 + 1] AS section, text FROM (SELECT doc_id::VARCHAR AS entity_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"


def queries(spark, sf):
    return spark.createDataFrame([(1, "the"), (2, "und der"), (3, "les de"), (4, "in and")], "query_id int, query string")


Q = "q AS (SELECT * FROM (VALUES (1, 'the'), (2, 'und der'), (3, 'les de'), (4, 'in and')) t(query_id, query))"
POST = CH + ", w AS (SELECT id, " + WORDS.format("concat_ws(' ', text, title, section)") + " AS w FROM ch), post AS (SELECT term, id, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY term, id)"
BM = POST + ", " + Q + """, t AS (SELECT query_id, len(l) AS n_terms, unnest(l) AS term FROM (SELECT query_id, list_distinct(string_split(query, ' ')) AS l FROM q)),
 n AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM (SELECT DISTINCT id, len FROM post)), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 bm AS (SELECT query_id, id, sum(greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score FROM post JOIN t USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY query_id, id, n_terms HAVING count(*) = n_terms)"""
KW = BM + """, cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r0 FROM bm QUALIFY r0 <= 20),
 kw AS (SELECT query_id, id, entity_id, round(score * CASE WHEN len(tok) > 0 AND hit = len(tok) THEN 1.35::DOUBLE WHEN hit > 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN nc <= 2 THEN 1.3::DOUBLE WHEN nc <= 4 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score,
   CASE WHEN nc <= 2 THEN 1.3::DOUBLE WHEN nc <= 4 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END * CASE section WHEN 'Overview' THEN 1.12::DOUBLE WHEN 'Intent' THEN 1.15::DOUBLE WHEN 'When to use' THEN 1.10::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN len(tok) > 0 AND hit = len(tok) THEN 1.35::DOUBLE WHEN hit > 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM (
   SELECT c.query_id, c.id, round(c.score, 9) AS score, ch.entity_id, ch.section, nc, tok, len(list_filter(tok, lambda x: contains(lower(title), x))) AS hit FROM cut c JOIN ch USING (id) JOIN (SELECT entity_id, count(*) AS nc FROM ch GROUP BY 1) USING (entity_id)
   JOIN (SELECT query_id, list_filter(list_distinct(string_split(query, ' ')), lambda x: x NOT IN ('the', 'a', 'an', 'of', 'in', 'to')) AS tok FROM q) USING (query_id)))"""


def _rounded(df, c="score"):
    return df.withColumn(c, F.round(c, 6))


def bm25_query(spark, sf):
    return _rounded(r.bm25_scan(chunks(spark, sf), queries(spark, sf)))


def keyword_query(spark, sf):
    return r.keyword_search(None, chunks(spark, sf), queries(spark, sf), 20).select("query_id", "id", "entity_id", F.round("score", 6).alias("score"), F.round("boost", 6).alias("boost"), "rank")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("entity_id"), F.col("embedding").alias("vec"))


def qvecs(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select((F.col("vec_id") / 50 + 1).cast("int").alias("query_id"), F.col("embedding").alias("qvec"))


VEC = "sem AS (SELECT query_id, id, entity_id, round(list_cosine_similarity(vec, qvec)::DOUBLE, 5) AS similarity FROM (SELECT vec_id::VARCHAR AS id, label::VARCHAR AS entity_id, embedding::DOUBLE[] AS vec FROM embeddings), (SELECT (vec_id // 50 + 1)::INT AS query_id, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id % 50 = 0))"


def cosine_query(spark, sf, where=None):
    v = vectors(spark, sf)
    x = r.semantic_search(v, qvecs(spark, sf), 20, where).select("query_id", "id", "entity_id", F.round("similarity", 5).alias("similarity"))
    return r.top(x, 10, score="similarity")  # ranked by rounded scores, so that engines agree on ties


def demoted(spark, sf):
    """Documents that mean something else to two of the queries."""
    return table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.explode(F.array(F.lit(1), F.lit(6))).alias("query_id"), F.col("doc_id").cast("string").alias("entity_id"))


def rrf_query(spark, sf):
    """Keyword hits by document, vectors by the same number: a document's best chunk meets vector '<doc>'. Queries beyond the fourth have vectors only and keep their similarity."""
    k = r.keyword_search(None, chunks(spark, sf), queries(spark, sf), 20)
    own = k.groupBy("query_id", "entity_id").agg(F.min("rank").alias("rank"), F.min_by("boost", "rank").alias("boost"), F.max("score").alias("score")).withColumn("id", F.col("entity_id"))
    sem = cosine_query(spark, sf).select("query_id", "id", F.col("id").alias("entity_id"), "similarity", "rank")
    return r.fuse(own, sem, 10, demoted(spark, sf)).select("query_id", "entity_id", F.round("score", 6).alias("score"), "rank")


RRF = "WITH " + KW + ", " + VEC + """, a AS (SELECT query_id, entity_id AS id, min(rank) AS kr, min_by(boost, rank) AS kb FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kw) GROUP BY ALL),
 b AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS sr FROM sem QUALIFY sr <= 10),
 no AS (SELECT unnest([1, 6]) AS query_id, doc_id::VARCHAR AS entity_id FROM documents WHERE doc_id % 3 = 0),
 f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS entity_id, coalesce(0.45::DOUBLE / (20 + kr) * kb, 0) + coalesce(0.55::DOUBLE / (20 + sr), 0) AS score, similarity, sr FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id),
 g AS (SELECT query_id, entity_id, CASE WHEN query_id <= 4 THEN score ELSE similarity END AS score, CASE WHEN query_id <= 4 THEN 0 ELSE sr END AS first FROM f WHERE (query_id, entity_id) NOT IN (SELECT (query_id, entity_id) FROM no))
 SELECT query_id, entity_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY first, score DESC, entity_id)::INT AS rank FROM g WHERE score > 0 QUALIFY rank <= 10"""


def talk(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "key string, term string")


TALK = "talk AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations)"
TYPES = TALK + ", lex AS (SELECT key, list(term) AS terms FROM " + _VALUES(LEXICON) + " t(key, term) GROUP BY key), ty AS (SELECT query_id, key, least(1.0, len(list_filter(terms, lambda t: contains(lower(query), t))) / greatest(len(terms), 5)::DOUBLE)::DOUBLE AS score FROM talk, lex)"


def types_query(spark, sf):
    return r.detect_types(talk(spark, sf), lexicon(spark)).select("query_id", "key", F.round("score", 6).alias("score"))


def strategy_query(spark, sf):
    q = talk(spark, sf)
    return r.strategy(r.detect_types(q, lexicon(spark)), q).select("query_id", "strategy", F.array_join("categories", ",").alias("categories"))


def synonym_query(spark, sf):
    q = talk(spark, sf)
    res = q.select("query_id", (F.col("query_id") % 7).cast("string").alias("entity_id"), (1.0 / (1 + F.col("query_id") % 5)).alias("score"))
    return r.inject_synonyms(res, q, spark.createDataFrame(SYNONYMS, "term string, entity_id string")).select("query_id", "entity_id", F.round("score", 6).alias("score"))


TOK = WORDS.format("query")
SYN = "WITH " + TALK + ", res AS (SELECT query_id, (query_id % 7)::VARCHAR AS entity_id, (1.0::DOUBLE / (1 + query_id % 5)) AS score FROM talk), syn AS (SELECT * FROM " + _VALUES(SYNONYMS) + f""" t(term, entity_id)),
 named AS (SELECT DISTINCT query_id, entity_id FROM talk JOIN syn ON CASE WHEN contains(term, ' ') THEN contains(lower(query), term) ELSE list_contains({TOK}, term) END),
 added AS (SELECT query_id, entity_id, best * 0.95::DOUBLE AS score FROM named JOIN (SELECT query_id, max(score) AS best FROM res GROUP BY 1) USING (query_id) WHERE (query_id, entity_id) NOT IN (SELECT query_id, entity_id FROM res) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY entity_id) <= 2)
 SELECT query_id, entity_id, round(score, 6) AS score FROM res UNION ALL SELECT query_id, entity_id, round(score, 6) FROM added"""


def homonym_query(spark, sf):
    return r.homonym_hits(talk(spark, sf), spark.createDataFrame([(e, t) for t, e in SYNONYMS], "entity_id string, term string"))


def lexicon_query(spark, sf):
    """How many of the benchmark's words each document holds somewhere, and the longest of them."""
    words = table(spark, sf, "benchmark").select(F.explode(s.query_tokens(F.col("text"))).alias("term")).filter("char_length(term) >= 4")
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    found = matching.contained(d, words)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.struct(F.char_length("term"), "term"))["term"].alias("longest"))


def boosted_query(spark, sf):
    """Vectors as chunks whose section and title follow their document and number, asked with texts."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("type"), F.col("doc_id") % 3).alias("entity_type"), F.left("text", F.lit(40)).alias("title"), F.element_at(F.array(*map(F.lit, SECTION)), (F.col("doc_id") % 4 + 1).cast("int")).alias("section"))
    asked = qvecs(spark, sf).select("query_id", F.element_at(F.array(F.lit("und der"), F.lit("les type1"), F.lit("nothing")), (F.col("query_id") % 3 + 1).cast("int")).alias("query"))
    types = spark.createDataFrame([("type1", "type1")], "key string, term string")
    x = r.semantic_search(vectors(spark, sf), qvecs(spark, sf), 20, chunks=d, asked=asked, types=types).withColumn("score", F.round("score", 5))
    return r.top(x.drop("rank"), 10).select("query_id", "id", "entity_id", "score", "rank")


BOOSTED = """WITH d AS (SELECT doc_id::VARCHAR AS id, doc_id % 3 AS kind, lower(left(text, 40)) AS title, [1.12, 1.15, 1.10, 1.0][doc_id % 4 + 1]::DOUBLE AS sec FROM documents),
 a AS (SELECT (vec_id // 50 + 1)::INT AS query_id, embedding::DOUBLE[] AS qvec, [['und', 'der'], ['les', 'type1'], ['nothing']][(vec_id // 50 + 1) % 3 + 1] AS tok FROM embeddings WHERE vec_id % 50 = 0),
 x AS (SELECT query_id, vec_id::VARCHAR AS id, label::VARCHAR AS entity_id, list_cosine_similarity(embedding::DOUBLE[], qvec) * coalesce(sec, 1.0::DOUBLE) * CASE WHEN title IS NULL THEN 1.0::DOUBLE WHEN len(list_filter(tok, lambda t: contains(title, t))) = len(tok) THEN 1.35::DOUBLE WHEN len(list_filter(tok, lambda t: contains(title, t))) > 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN kind = 1 AND list_contains(tok, 'type1') THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS s FROM embeddings CROSS JOIN a LEFT JOIN d ON d.id = vec_id::VARCHAR)
 SELECT query_id, id, entity_id, round(s, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 5) DESC, id)::INT AS rank FROM x QUALIFY rank <= 10"""


def fallback_query(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.col("p_brand").alias("category"))
    q = spark.createDataFrame([(1, "brand"), (2, "part 1 steel"), (3, "small")], "query_id int, query string")
    return r.graph_fallback(e, q, 15).select("query_id", "id", "total", "in_title", "rank")


FALL = """WITH q AS (SELECT query_id, string_split(query, ' ') AS terms FROM (VALUES (1, 'brand'), (2, 'part 1 steel'), (3, 'small')) t(query_id, query)),
 h AS (SELECT query_id, p_partkey::VARCHAR AS id, len(list_filter(terms, lambda x: contains(lower(concat_ws(' ', p_name, p_type, p_brand)), x)))::INT AS total, len(list_filter(terms, lambda x: contains(lower(p_name), x)))::INT AS in_title FROM part, q)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, in_title DESC, id)::INT AS rank FROM h WHERE total > 0 QUALIFY rank <= 15"""


def chunk_query(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), F.concat(F.regexp_replace("text", "\n", "\n## "), F.lit("\nend")).alias("text"))
    return r.chunk_markdown(d).select("id", "entity_id", "chunk_index", "section", F.octet_length("text").alias("n_bytes"))


TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CHUNK = f"""WITH p AS (SELECT entity_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id::VARCHAR AS entity_id, string_split(replace(text, chr(10), chr(10) || '## ') || chr(10) || 'end', chr(10) || '## ') AS parts FROM documents)),
 t AS (SELECT entity_id, pos, CASE WHEN pos = 1 THEN 'Overview' ELSE trim(string_split(part, chr(10))[1]) END AS section, {TRIM.format("CASE WHEN pos = 1 THEN part ELSE '## ' || part END")} AS text FROM p)
 SELECT entity_id || '-C' || lpad((row_number() OVER (PARTITION BY entity_id ORDER BY pos) - 1)::VARCHAR, greatest(3, length((row_number() OVER (PARTITION BY entity_id ORDER BY pos) - 1)::VARCHAR))::INT, '0') AS id, entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY pos) - 1)::INT AS chunk_index, section, strlen(text)::INT AS n_bytes FROM t WHERE strlen(text) > 50"""


def scalars_query(spark, sf):
    t = table(spark, sf, "conversations").filter("text is not null")
    return t.select("conv_id", "turn", s.truncate(F.col("text"), 30).alias("cut"), s.title_of(F.col("text"), 40).alias("title"), s.estimate_tokens(F.col("text")).alias("tokens"), s.cache_key("q", F.col("role"), F.col("text")).alias("key"), F.array_join(s.comma_list(F.col("text")), "|").alias("parts"), s.line_of(F.col("text"), F.lit(100)).cast("int").alias("line"), s.next_id(F.col("conv_id"), F.col("turn")).alias("next"))


SCALARS = """SELECT conv_id, turn, CASE WHEN length(text) > 30 THEN left(text, 27) || '...' ELSE text END AS cut,
 CASE WHEN length(string_split(text, chr(10))[1]) > 40 THEN left(string_split(text, chr(10))[1], 37) || '...' ELSE string_split(text, chr(10))[1] END AS title, greatest(strlen(text) // 4, 1) AS tokens, 'q:' || md5(role || ':' || text) AS key,
 array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts, (1 + length(left(text, 100)) - length(replace(left(text, 100), chr(10), '')))::INT AS line,
 'TK-' || lpad((conv_id + turn)::VARCHAR, greatest(3, length((conv_id + turn)::VARCHAR))::INT, '0') AS next FROM conversations WHERE text IS NOT NULL"""

QUERIES = {
    "text_chunk": chunk_query,
    "text_postings": lambda a, b: r.postings(chunks(a, b)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")),
    "text_bm25": bm25_query,
    "text_keyword_boosted": keyword_query,
    "vec_cosine_topk": cosine_query,
    "vec_filtered": lambda a, b: cosine_query(a, b, F.col("entity_id") == "3"),
    "vec_boosted": boosted_query,
    "text_lexicon": lexicon_query,
    "hybrid_rrf": rrf_query,
    "query_type_detect": types_query,
    "query_strategy": strategy_query,
    "synonym_inject": synonym_query,
    "homonym_filter": homonym_query,
    "graph_fallback": fallback_query,
    "f_scalars": scalars_query,
}
SQL = {
    "text_chunk": CHUNK,
    "text_postings": "WITH " + POST + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
    "text_bm25": "WITH " + BM + " SELECT query_id, id, round(score, 6) AS score FROM bm",
    "text_keyword_boosted": "WITH " + KW + " SELECT query_id, id, entity_id, round(score, 6) AS score, round(boost, 6) AS boost, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM kw",
    "vec_cosine_topk": "WITH " + VEC + " SELECT query_id, id, entity_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sem QUALIFY rank <= 10",
    "vec_filtered": "WITH " + VEC + " SELECT query_id, id, entity_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sem WHERE entity_id = '3' QUALIFY rank <= 10",
    "vec_boosted": BOOSTED,
    "text_lexicon": "WITH w AS (SELECT DISTINCT unnest(" + WORDS.format("text") + ") AS term FROM benchmark), f AS (SELECT doc_id, term FROM documents JOIN w ON contains(lower(text), term) WHERE length(term) >= 4) SELECT doc_id, count(*) AS n, arg_max(term, (length(term), term)) AS longest FROM f GROUP BY 1",
    "hybrid_rrf": RRF,
    "query_type_detect": "WITH " + TYPES + " SELECT query_id, key, round(score, 6) AS score FROM ty WHERE score > 0",
    "query_strategy": "WITH " + TYPES + """, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM ty WHERE score > 0 QUALIFY r <= 2), b AS (SELECT query_id, max(score) AS best, string_agg(key, ',' ORDER BY r) AS two, min_by(key, r) AS one FROM rk GROUP BY 1)
     SELECT query_id, CASE WHEN best > 0.7 THEN 'category' WHEN best > 0.3 THEN 'hybrid' ELSE 'semantic' END AS strategy, CASE WHEN best > 0.7 THEN one WHEN best > 0.3 THEN two ELSE '' END AS categories FROM talk LEFT JOIN b USING (query_id)""",
    "synonym_inject": SYN,
    "homonym_filter": "WITH " + TALK + " SELECT DISTINCT query_id, entity_id FROM talk JOIN " + _VALUES(SYNONYMS) + " t(term, entity_id) ON contains(lower(query), term)",
    "graph_fallback": FALL,
    "f_scalars": SCALARS,
}
