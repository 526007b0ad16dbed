"""Operators on small hand-made tables: bugs decided, ties, sources, streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as s
from weftline.operators import detectors, evaluation, graph, insights, retrieval
from weftline.sources import code_items, files, versions
from weftline.streaming import metrics

SF = "/root/testdata/sf0.001"


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, rel string, dst string")


def ents(spark, *ids):
    return spark.createDataFrame([(i, "t", f"title {i}", None) for i in ids], "id string, type string, title string, category string")


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def test_inverses_replace_stored_ones_only_where_derived(spark):
    x = edges(spark, ("RF-1", "solves", "SMELL-1"), ("SMELL-1", "solved_by", "RF-9"), ("SMELL-2", "solved_by", "RF-8"), ("RF-1", "solves", "GONE"))
    got = bag(graph.derive_inverses(x, ents(spark, "RF-1", "SMELL-1", "SMELL-2")))
    assert got == [("RF-1", "solves", "GONE"), ("RF-1", "solves", "SMELL-1"), ("SMELL-1", "solved_by", "RF-1"), ("SMELL-2", "solved_by", "RF-8")]


def test_paths_are_shortest_directed_and_bounded(spark):
    x = edges(spark, ("a", "r", "b"), ("b", "r", "c"), ("a", "r", "d"), ("d", "r", "c"), ("c", "r", "a"), ("c", "r", "e"))
    e = ents(spark, *"abcdez")
    assert bag(graph.shortest_path(spark, x, e, "a", "e", 5)) == [(["a", "b", "c", "e"], 3)]
    assert bag(graph.shortest_path(spark, x, e, "a", "e", 2)) == []
    assert bag(graph.shortest_path(spark, x, e, "a", "a", 2)) == [(["a"], 0)]
    assert bag(graph.shortest_path(spark, x, e, "a", "nowhere", 5)) == bag(graph.shortest_path(spark, x, e, "e", "a", 5)) == []
    assert bag(graph.chain(x, "a", [], spark)) == [(["a"],)]
    assert len(bag(graph.subgraph(spark, x, e, "a", 1))) == 2


def test_similar_at_threshold_zero_keeps_disjoint(spark):
    x = edges(spark, ("a", "r", "1"), ("b", "r", "1"), ("b", "r", "2"), ("c", "r", "3"))
    assert bag(graph.similar(x, "a", 0.0)) == [("b", 0.5), ("c", 0.0)]
    assert bag(graph.similar(x, "a", 0.1)) == [("b", 0.5)]


def item(**kw):
    return {"location": "f", "name": "n", "item_type": "function", **dict.fromkeys(detectors.METRICS, 0), "cyclomatic_complexity": 1, **kw}


@pytest.mark.parametrize(
    ("smell", "kind", "metrics", "confidence"),
    [
        ("SMELL-01", "function", {"loc": 51, "cyclomatic_complexity": 11}, 0.55), ("SMELL-01", "function", {"loc": 50, "cyclomatic_complexity": 10}, None), ("SMELL-02", "function", {"parameter_count": 9}, 0.95),
        ("SMELL-02", "function", {"parameter_count": 5}, None), ("SMELL-04", "class", {"method_count": 21, "field_count": 11}, 0.55), ("SMELL-05", "class", {"parameter_count": 6, "primitive_params": 4}, 0.65),
        ("SMELL-06", "function", {"branch_count": 11, "cyclomatic_complexity": 16}, 1.0), ("SMELL-07", "class", {"field_count": 5}, 0.6), ("SMELL-10", "class", {"cyclomatic_complexity": 16, "method_count": 9, "field_count": 11}, 0.65),
        ("SMELL-11", "class", {"loc": 5, "field_count": 2}, None), ("SMELL-11", "class", {"loc": 5}, 0.8), ("SMELL-14", "class", {"method_count": 4, "delegation_methods": 3}, 0.7), ("SMELL-18", "function", {"external_calls": 6}, 0.7),
        ("SMELL-20", "function", {"method_call_chains": 5}, 0.9), ("SMELL-21", "class", {"method_count": 31, "field_count": 21}, 0.7), ("SMELL-22", "class", {"override_count": 3, "method_count": 5}, 0.75),
    ],
)
def test_detectors_at_their_thresholds(spark, smell, kind, metrics, confidence):
    df = spark.createDataFrame([item(item_type=kind, **metrics)])
    got = {r.smell_id: r.confidence for r in detectors.detect_all(df).collect()}
    assert got.get(smell) == confidence


def test_remedies_rank_by_the_four_part_formula(spark):
    x = edges(spark, ("RF-1", "solves", "SMELL-01"), ("RF-2", "solves", "SMELL-01"), ("SMELL-01", "violates", "L1"), ("SMELL-01", "violates", "L2"), ("RF-2", "enforces", "L1"))
    found = spark.createDataFrame([("f", "n", "SMELL-01", 0.8)], "location string, name string, smell_id string, confidence double")
    remedies = spark.createDataFrame([("RF-1", "small"), ("RF-2", "large")], "id string, effort string")
    got = {r.remedy: (r.priority, r["rank"]) for r in detectors.rank_remedies(found, x, remedies).collect()}
    assert got == {"RF-1": (round(0.32 + 0.3 + 0 + 0.005, 6), 1), "RF-2": (round(0.32 + 0.09 + 0.1 + 0.01, 6), 2)}


def test_fusion_demotes_homonyms_and_keeps_one_chunk_each(spark):
    k = spark.createDataFrame([(1, "a-1", "a", 1.0, 1), (1, "a-2", "a", 1.0, 2), (1, "b-1", "b", 1.3, 3)], "query_id int, id string, entity_id string, boost double, rank int")
    v = spark.createDataFrame([(1, "c-1", "c", 1), (1, "a-2", "a", 2)], "query_id int, id string, entity_id string, rank int")
    h = spark.createDataFrame([(1, "c")], "query_id int, entity_id string")
    got = [(r.entity_id, r.id) for r in retrieval.rrf(k, v, 5, homonyms=h).orderBy("rank").collect()]
    assert got == [("a", "a-2"), ("b", "b-1")]


def test_expansion_adds_two_and_raises_the_rest(spark):
    res = spark.createDataFrame([(1, "SMELL-01", 1.0), (1, "DP-1", 0.9), (1, "SMELL-02", 0.8), (1, "RF-5", 0.1)], "query_id int, entity_id string, score double")
    x = edges(spark, ("SMELL-01", "solved_by", "RF-1"), ("SMELL-01", "solved_by", "RF-2"), ("SMELL-01", "solved_by", "RF-3"), ("SMELL-02", "solved_by", "RF-5"))
    got = {r.entity_id: round(r.score, 6) for r in retrieval.expand_remedies(res, x, 10).collect()}
    assert got == {"SMELL-01": 1.0, "DP-1": 0.9, "SMELL-02": 0.8, "RF-5": 0.76, "RF-1": 0.76, "RF-2": 0.76}


def test_budget_is_greedy_in_order(spark):
    rows = spark.createDataFrame([(1, k, f"e{k}", 220, 120, 60, 30) for k in range(1, 7)] + [(2, 1, "z", 900, 50, 50, 50), (2, 2, "y", 1, 1, 1, 1)], "query_id int, rank int, id string, full long, detailed long, summary long, minimal long")
    got = [(r.query_id, r.id, r.level) for r in retrieval.budget(rows, 500).orderBy("query_id", "place").collect()]
    # 500 full, 280 detailed, 160 summary, 100 summary, 40: stop
    assert got == [(1, "e1", "full"), (1, "e2", "detailed"), (1, "e3", "summary"), (1, "e4", "summary"), (2, "z", "full")]


def test_a_smell_nothing_solves_brings_related_remedies(spark):
    res = spark.createDataFrame([(1, "SMELL-01", 1.0), (1, "SMELL-02", 0.9)], "query_id int, entity_id string, score double")
    edges = spark.createDataFrame([("SMELL-01", "solved_by", "RF-001"), ("SMELL-01", "related_to", "RF-009"), ("SMELL-02", "related_to", "RF-002"), ("SMELL-02", "related_to", "LAW-001")], "src string, rel string, dst string")
    got = [r.entity_id for r in retrieval.expand_remedies(res, edges, 9).orderBy("rank").collect()]
    assert got == ["SMELL-01", "SMELL-02", "RF-001", "RF-002"]


def test_links_keep_the_higher_provenance(spark):
    edges = spark.createDataFrame([], "src string, rel string, dst string")
    given = spark.createDataFrame([("a", "x", 0.4, "auto"), ("a", "b", 1.0, "supersedes")], "insight_id string, entity_id string, score double, source string")
    old = spark.createDataFrame([("a", "x", "user", 0.9)], "insight_id string, entity_id string, source string, score double")
    links, kept = insights.supersede(edges, given, old)
    assert sorted(tuple(r) for r in links.collect()) == [("a", "derives_from", "x"), ("a", "supersedes", "b")]
    assert sorted(tuple(r) for r in kept.collect()) == [("a", "b", "supersedes", 1.0), ("a", "x", "user", 0.9)]


def test_files_too_large_are_reported():
    from weftline.sources import code_items

    assert [x["item_type"] for x in code_items.extract("x = 1\n" * 100_000, "python")] == ["rejected"]


def test_scalars(spark):
    d = spark.createDataFrame([("각각", "a, ,b", [1.0, 0.0], [0.0, 0.0])], "t string, l string, a array<double>, b array<double>")
    r = d.select(s.estimate_tokens(F.col("t")).alias("n"), s.comma_list(F.col("l")).alias("l"), s.cosine(F.col("a"), F.col("b")).alias("c"), s.jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j"), s.truncate(F.lit("abcdef"), 5).alias("x"), s.entity_ids(F.lit("see [RF-001] and [X]")).alias("e")).first()
    assert tuple(r) == (1, ["a", "b"], 0.0, 0.5, "ab...", ["RF-001"])


PY = '''
class Box(Base):
    """Doc."""
    size = 1

    def __init__(self, a, b: int):
        self.a = a  # note
        self.b = b

    def run(self):
        return self.inner.run()


def long(a, b, c, d, e, f, g):
    for x in a:
        if x:
            while b:
                try:
                    c.d().e().f()
                except ValueError:
                    return 1
    return 2
'''
JAVA = """
// head
public class Shop {
    private int count;
    public String name;
    /** Doc. */
    public int add(int a, String b) {
        // inner
        if (a > 1 || b == null) { return client.get().post().send().done(); }
        for (int i = 0; i < a; i++) { while (true) { break; } }
        return a;
    }
    @Override
    public void go() { this.client.run(a); }
}
"""


def test_python_and_java_items(spark):
    d = spark.createDataFrame([("a.py", "python", PY), ("S.java", "java", JAVA), ("x", "cobol", "x"), ("bad.py", "py", "def ("), ("n", "go", None)], "path string, language string, code string")
    got = {r.name: r for r in code_items.code_items(d).collect()}
    box, long, add, shop = got["Box"], got["long"], got["add"], got["Shop"]
    assert (box.item_type, box.method_count, box.field_count, box.override_count, box.delegation_methods) == ("class", 2, 3, 1, 1)
    assert (long.parameter_count, long.primitive_params, long.cyclomatic_complexity, long.nesting_depth, long.return_statements) == (7, 7, 6, 4, 2)
    assert (add.parameter_count, add.primitive_params, add.method_call_chains, add.return_statements, add.location) == (2, 2, 4, 2, "S.java:7")
    assert (shop.method_count, shop.field_count, shop.override_count) == (2, 2, 1)


@pytest.mark.parametrize(
    ("language", "code", "name"),
    [("go", "package m\nfunc (s *Srv) Do(a int, b string) error {\n if a > 1 { return nil }\n return nil\n}\ntype Srv struct {\n x int\n}\n", "Do"), ("rust", "pub fn work(a: i32, b: &str) -> i32 {\n match a { 1 => 2, _ => 3 }\n}\n", "work"), ("typescript", "const go = (a: number, b: string) => {\n  return a;\n}\n", "go"), ("cpp", "int add(int a, int b) {\n  int c = a;\n  return c + b;\n}\n", "add"), ("csharp", "public int Add(int a, string b) {\n  foreach (var x in y) { }\n  return 1;\n}\n", "Add"), ("kotlin", "fun add(a: Int, b: String): Int {\n  val c = 1\n  return c\n}\n", "add"), ("php", "<?php\nfunction add(int $a, $b) {\n  $c = 1;\n  return $c;\n}\n", "add"), ("ruby", "class A\n  def add(a, b)\n    if a\n      b.c\n    end\n  end\nend\n", "add")],
)
def test_other_languages_find_their_function(language, code, name):
    found = {x["name"]: x for x in code_items.extract(code, language)}
    assert found[name]["item_type"] == "function" and found[name]["parameter_count"] == 2


def test_json_graph_and_first_section(spark, tmp_path):
    body = {"_meta": {"x": 1}, "RF-001": {"title": "T", "type": "Refactoring", "relations": {"solves": ["SMELL-01"]}, "tags": ["a"]}, "SMELL-01": {"name": "S"}, "XX-1": {}}
    (tmp_path / "g.json").write_text(json.dumps(body))
    e, x = files.load_graph(spark, str(tmp_path / "g.json"))
    assert [(r.id, r.type, r.title) for r in e.orderBy("id").collect()] == [("RF-001", "refactoring", "T"), ("SMELL-01", "smell", "")]
    assert bag(x) == [("RF-001", "solves", "SMELL-01"), ("SMELL-01", "solved_by", "RF-001")]
    d = spark.createDataFrame([("# A\nintro\n## B\n\n one \ntwo\n\nthree\n## C\n",), ("none",)], "t string")
    assert [r[0] for r in d.select(files.first_section(F.col("t"))).collect()] == ["one two", ""]


def test_chunk_table_upserts(spark, tmp_path):
    c = lambda *rows: spark.createDataFrame(list(rows), "id string, text string, entity_type string")
    at = str(tmp_path / "chunks")
    files.write_chunks(c(("a", "1", "x"), ("b", "2", "y")), at)
    files.write_chunks(c(("b", "3", "y"), ("c", "4", "x")), at)
    assert bag(versions.read(spark, at).select("id", "text", "entity_type")) == [("a", "1", "x"), ("b", "3", "y"), ("c", "4", "x")]
    v = files.embed(spark.createDataFrame([("a b a",), ("",)], "text string"), dim=8).collect()
    assert abs(sum(x * x for x in v[0].embedding) - 1) < 1e-6 and set(v[1].embedding) == {0.0}


def test_chunks_number_what_they_keep(spark):
    long = "x" * 60
    d = spark.createDataFrame([("E", f"{long}\n## One\n{long}\n## Tiny\nno\n## Two\n{long}")], "entity_id string, text string")
    assert [(r.id, r.section) for r in retrieval.chunk_markdown(d).orderBy("id").collect()] == [("E-C000", "Overview"), ("E-C001", "One"), ("E-C002", "Two")]


def test_insight_findings_persist_once(spark):
    found = spark.createDataFrame([("f", "n", "SMELL-01", 0.5), ("f", "n", "SMELL-01", 0.5), ("f", "m", "SMELL-01", 0.5)], "location string, name string, smell_id string, confidence double")
    kept = spark.createDataFrame([("TK-001", ["found_in:f:m:SMELL-01"])], "id string, tags array<string>")
    assert [r.name for r in insights.persist_findings(kept, found).collect()] == ["n"]


def test_gate_and_coverage(spark):
    assert evaluation.composite(1, 0, 1, 1) == 1.0
    d = spark.createDataFrame([(1, "**Use** a Factory"), (2, "nothing")], "id int, answer string")
    assert bag(evaluation.concept_coverage(d, {"f": ["factory"], "s": ["strategy", "policy"]})) == [(1, 1, 0.5), (2, 0, 0.0)]


def test_streams_equal_their_batches(spark):
    from weftline.plans import event_queries as q

    batch = {(r.start, r.event_type): r.n for r in metrics.rates(q.ev(spark, SF), "1 hour", None, "event_type").collect()}
    stream = {(r.start, r.event_type): r.n for r in q.stream_rates(spark, SF).collect()}
    assert stream and all(batch[k] == n for k, n in stream.items())  # windows that the watermark closed
    limited = q.stream_limited(spark, SF)
    assert limited.count() == q.ev(spark, SF).count() and limited.filter("allowed").count() > 0


def test_search_answers_all_of_many_queries(spark):
    """More than a thousand queries, with and without a broadcast."""
    from weftline.plans.engine import Engine

    n = 1203
    vecs = spark.createDataFrame([("a", "A", [1.0, 0.0]), ("b", "B", [0.0, 1.0])], "id string, entity_id string, vec array<double>")
    q = spark.range(n).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(2.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("qvec"))
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("query"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (held, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = retrieval.semantic_search(vecs, q, 1).collect()
            assert {(r.query_id, r.id) for r in got} == {(i, "ab"[i % 2]) for i in range(n)} and len(got) == n
            got = retrieval.graph_fallback(ents(spark, "x", "y"), asked, 1).collect()
            assert {(r.query_id, r.id) for r in got} == {(i, "x") for i in range(n)} and len(got) == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    chunks = spark.createDataFrame([("c", "text", "Z", "t", "t", "s")], "id string, text string, entity_id string, entity_type string, title string, section string")
    e = Engine(spark, ents(spark, "A", "B"), edges(spark), chunks=chunks, vectors=vecs)
    assert {r.query_id for r in e.search(asked, query_vectors=q).collect()} == set(range(n))


def test_search_boosts_meanings_and_falls_back(spark):
    from weftline.plans.engine import Engine

    chunks = spark.createDataFrame([("a", "x", "A", "law", "other", "Notes"), ("b", "x", "B", "pattern", "other", "Overview"), ("c", "x", "C", "law", "state", "Notes")], "id string, text string, entity_id string, entity_type string, title string, section string")
    vecs = spark.createDataFrame([(i, i.upper(), [1.0, 0.0]) for i in "abc"], "id string, entity_id string, vec array<double>")
    asked = spark.createDataFrame([(1, "state rule"), (2, "nothing")], "query_id int, query string")
    types = spark.createDataFrame([("law", "rule")], "key string, term string")
    qv = asked.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("qvec"))
    got = {(r.query_id, r.id): (round(r.score, 6), r["rank"], r.similarity) for r in retrieval.semantic_search(vecs, qv, 3, chunks=chunks, asked=asked, types=types).collect()}
    assert got[1, "a"] == (1.05, 3, 1.0) and got[1, "b"] == (1.12, 2, 1.0) and got[1, "c"] == (round(1.05 * 1.1, 6), 1, 1.0)
    assert [got[2, i][1] for i in "bac"] == [1, 2, 3]
    e = Engine(spark, ents(spark, "E1", "E2"), edges(spark), chunks=chunks, types=types, vectors=vecs)
    found = e.search(spark.createDataFrame([(7, "title e2"), (8, " "), (9, "zzz")], "query_id int, query string"), limit=1).collect()
    assert [(r.query_id, r.entity_id, r.score, r["rank"]) for r in found] == [(7, "E2", 2.0, 1)]
    best = e.search(asked.limit(1), limit=1, query_vectors=qv.limit(1)).collect()
    assert [r.entity_id for r in best] == ["C"]


@pytest.mark.parametrize("text", ["*" * 400_000, "/" + ("*" * 60 + "\n") * 5000 + "*/ int f(int a) { return a; }", " " * 400_000, "a " * 200_000, "public " * 60_000])
@pytest.mark.parametrize("language", ["cpp", "java"])
def test_heads_take_linear_time(language, text):
    began = time.monotonic()
    list(code_items.brace_items(text, code_items.LANGUAGES[language]))
    assert time.monotonic() - began < 5


def test_cpp_heads():
    code = "static std::vector<int>* Box::go(int a) {\n return a; }\nint\n  plain (int a, int b) { if (a) { return b; } return a; }\nfoo(1);\n"
    assert [x["name"] for x in code_items.brace_items(code, code_items.LANGUAGES["cpp"])] == ["plain"]


def test_edges_of_a_checkpoint_and_a_table_are_written_once(spark):
    """Only the caller's word says that edges are written; a plan that merely reads a checkpoint is not."""
    from weftline.session import checkpointed

    x = edges(spark, ("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"))
    joined = checkpointed(spark, x).join(spark.createDataFrame([("r",)], "rel string"), "rel")
    want = [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert bag(graph.hops(spark, joined, "a", 3).select("id", "depth")) == want
    assert bag(graph.hops(spark, checkpointed(spark, x), "a", 3, written=True).select("id", "depth")) == want


def test_multi_type_search_shuffles_no_postings_and_files_are_dealt(spark):
    from weftline.plans import parity_queries as pq

    sf = "/root/testdata/sf0.001"
    plan = pq.multi_query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and not any("LeftSemi" in x for x in plan.splitlines())  # hits of the queries' terms only
    n = pq.language_files(spark, sf).rdd.getNumPartitions()
    assert n == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_correlations_shuffle_no_pairs(spark, block):
    from weftline.operators import insights as ins

    links = [(f"i{k}", "r", f"t{k * j % 11}") for k in range(40) for j in range(4)] + [("i1", "r", None), (None, "r", "t0"), ("lone", "r", "x")]
    found = ins.correlations(spark.createDataFrame(links, "src string, rel string, dst string"), block=block)
    of = {}
    for s, _, d in links:
        of.setdefault(s, set()).add(d)
    want = {}
    for a in of:
        for b in of:
            if a and b and a < b and (n := len((of[a] & of[b]) - {None})):
                want[a, b] = round(n / (len(of[a]) + len(of[b]) - n), 9)
    assert {(r.a, r.b): round(r.shared, 9) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
