"""Terms in texts and exact vector search against brute force, on every path."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import matching, nearest, retrieval as r


def ordered(rows):
    return sorted((tuple(x) for x in rows), key=repr)


def lexicon_and_texts(seed, n_terms, n_texts):
    g = random.Random(seed)
    word = lambda a, b: "".join(g.choice("abcdé ß") for _ in range(g.randint(a, b)))
    terms = [word(1, 6) for _ in range(n_terms)] + ["", None, "a", "ab", "ab", "é", "zzz"]
    texts = [(i, word(0, 60)) for i in range(n_texts)] + [(1000, None), (1001, ""), (1002, "ab"), (1003, "ab"), (None, "zzzé" * 300)]
    return terms, texts


@pytest.mark.parametrize("most", [matching.MOST_BYTES, 0])
def test_contained_terms_equal_brute_force(spark, most):
    terms, texts = lexicon_and_texts(1, 200, 120)
    df = spark.createDataFrame([(i, 7, t) for i, t in texts], "id long, term int, text string").withColumnRenamed("term", "other")
    got = matching.contained(df, spark.createDataFrame([(t,) for t in terms], "term string"), most_bytes=most)
    want = [(i, 7, t) for i, text in texts for t in {t for t in terms if t} if t in (text or "")]
    assert ordered(got.select("id", "other", "term").collect()) == ordered(want)


@pytest.mark.parametrize("most", [matching.MOST_BYTES, 0])
def test_contained_of_nothing(spark, most):
    some = spark.createDataFrame([(1, "abc")], "id long, text string")
    none = spark.createDataFrame([], "term string")
    assert matching.contained(some, none, most_bytes=most).collect() == []
    assert matching.contained(some.filter("false"), spark.createDataFrame([("abc",)], "term string"), most_bytes=most).collect() == []


def test_a_lexicon_of_a_hundred_thousand_terms(spark):
    texts = spark.range(3000).select(F.col("id"), F.concat(F.lit("x "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    terms = spark.range(100_000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 5, 12).alias("term"))
    got = matching.contained(texts, terms)
    assert got.filter(F.substring(F.sha2(F.col("id").cast("string"), 256), 5, 12) == F.col("term")).count() == 3000
    large = matching.contained(texts, terms, most_bytes=1000)
    assert got.exceptAll(large).count() == 0 and large.exceptAll(got).count() == 0


def vectors(seed, n, dim=6):
    g = random.Random(seed)
    rows = [(f"v{i}", f"e{i % 7}", [g.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return rows + [("zero", "e0", [0.0] * dim), ("same", "e1", rows[0][2]), ("null", "e1", None), ("short", "e1", [1.0]), ("hole", "e1", [None] * dim)]


def cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0


@pytest.mark.parametrize(("most", "limit"), [(nearest.MOST_BYTES, 4), (200, 4), (nearest.MOST_BYTES, 1000), (200, 1)])
def test_exact_search_equals_brute_force(spark, most, limit):
    rows = vectors(2, 300)
    asked = [(i, rows[i * 5][2]) for i in range(40)] + [(90, [0.0] * 6), (91, None)]
    v = spark.createDataFrame(rows, "id string, entity_id string, vec array<double>").repartition(5)
    q = spark.createDataFrame(asked, "query_id int, qvec array<double>")
    pairs = nearest.top_pairs(v, q, limit, most_bytes=most)
    got = nearest.merged(pairs.withColumn("score", F.round("similarity", 9)), limit)
    usable = [x for x in rows if x[2] and None not in x[2] and len(x[2]) == 6]
    want = []
    for i, w in asked:
        if w is not None:
            best = sorted(((-round(cosine(x[2], w), 9) + 0.0, x[0], x[1]) for x in usable))[:limit]
            want += [(i, key, e, -s + 0.0, k) for k, (s, key, e) in enumerate(best, 1)]
    assert [x[:3] + x[4:] for x in ordered((a.query_id, a.id, a.entity_id, a.score, a["rank"]) for a in got.collect())] == [x[:3] + x[4:] for x in ordered(want)]


def test_losing_pairs_stay_in_their_task(spark):
    v = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.lit("e").alias("entity_id"), F.array(*[F.rand(k) - 0.5 for k in range(8)]).alias("vec")).repartition(4)
    q = v.filter("id % 500 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    assert nearest.top_pairs(v, q, 5).count() <= 40 * 5 * 4 + 40


def test_boosted_search_keeps_what_a_boost_lets_win(spark):
    g = random.Random(8)
    rows = [x for x in vectors(3, 400) if x[2] and len(x[2]) == 6 and None not in x[2]]
    section = lambda k: ["Intent", "Other", None, "When to use it", "Overview"][k % 5]
    chunks = [(x[0], x[1], f"type{k % 3}", g.choice(["red fox", "blue", "the fox runs", None]), section(k)) for k, x in enumerate(rows) if k % 11]
    asked = [(k, g.choice(["red fox", "fox type1", "nothing"]), [g.gauss(0, 1) for _ in range(6)]) for k in range(12)]
    v = spark.createDataFrame(rows, "id string, entity_id string, vec array<double>").repartition(6)
    c = spark.createDataFrame(chunks, "id string, entity_id string, entity_type string, title string, section string")
    a = spark.createDataFrame([(k, t) for k, t, _ in asked], "query_id int, query string")
    q = spark.createDataFrame([(k, w) for k, _, w in asked], "query_id int, qvec array<double>")
    types = spark.createDataFrame([("type1", "type1")], "key string, term string")
    got = r.semantic_search(v, q, 6, chunks=c, asked=a, types=types).collect()
    by = {x[0]: x for x in chunks}
    want = []
    for k, text, w in asked:
        tokens = [t for t in dict.fromkeys(text.split()) if t not in r.STOP]
        scored = []
        for key, _, vec in rows:
            s = cosine(vec, w)
            if key in by:
                _, _, kind, title, sec = by[key]
                low = (sec or "").lower()
                s *= r.SECTIONS.get(low) or max((b for n, b in r.SECTIONS.items() if low.startswith(n)), default=1.0)
                have = sum(t in (title or "").lower() for t in tokens)
                s *= 1.35 if tokens and have == len(tokens) else 1.1 if have else 1.0
                s *= 1.05 if kind == "type1" and "type1" in text else 1.0
            scored.append((-s, key))
        want += [(k, key, n) for n, (_, key) in enumerate(sorted(scored)[:6], 1)]
    assert sorted((x.query_id, x.id, x["rank"]) for x in got) == sorted(want)
