"""Tables kept by version: writes that die, are repeated, collide or do not fit; embedding and the build."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.sources import files, versions

CHUNK = "id string, text string, section string"


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


def state(spark, at):
    return sorted(tuple(r) for r in versions.read(spark, at).collect())


class Killed(Exception):
    pass


@pytest.mark.parametrize("at_step", ["write", "commit"])
@pytest.mark.parametrize("first", [True, False])
def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch, at_step, first):
    at = str(tmp_path / "t")
    if not first:
        files.write_chunks(chunks(spark, ("a", "1", "s"), ("b", "2", "s")), at)
    before = [] if first else state(spark, at)

    def die(name):
        if name == at_step:
            raise Killed

    monkeypatch.setattr(versions, "step", die)
    with pytest.raises(Killed):
        files.write_chunks(chunks(spark, ("b", "3", "s"), ("c", "4", "s")), at)
    monkeypatch.undo()
    assert [tuple(r) for r in versions.read(spark, at, CHUNK).orderBy("id").collect()] == before
    files.write_chunks(chunks(spark, ("b", "3", "s"), ("c", "4", "s")), at)
    assert state(spark, at) == ([] if first else [("a", "1", "s")]) + [("b", "3", "s"), ("c", "4", "s")]


def test_a_half_written_log_line_does_not_count(spark, tmp_path):
    at = tmp_path / "t"
    files.write_chunks(chunks(spark, ("a", "1", "s")), str(at))
    (at / "log" / f"{2:012d}").write_text('{"version": 2, "sch')
    assert state(spark, str(at)) == [("a", "1", "s")]
    assert files.write_chunks(chunks(spark, ("b", "1", "s")), str(at)) == 3
    assert state(spark, str(at)) == [("a", "1", "s"), ("b", "1", "s")]


def test_columns_that_differ_are_an_error_and_change_nothing(spark, tmp_path):
    at = str(tmp_path / "t")
    files.write_chunks(chunks(spark, ("a", "1", "s"), ("b", "2", "s")), at)
    for other in ("id string, text string", "id string, text string, section string, more int", "id string, text int, section string"):
        with pytest.raises(versions.SchemaMismatch):
            files.write_chunks(spark.createDataFrame([], other), at)
    with pytest.raises(versions.SchemaMismatch):
        versions.upsert(chunks(spark, ("a", "1", "s")), at, "text")
    assert state(spark, at) == [("a", "1", "s"), ("b", "2", "s")]
    files.write_chunks(chunks(spark, ("c", "3", "s")).select("section", "id", "text"), at)  # the order of columns does not matter
    assert len(state(spark, at)) == 3


def test_a_repeated_transaction_changes_nothing(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = chunks(spark, ("a", "1", "s"), ("a", "2", "s"))
    assert versions.append(rows, at, "id", ("links", 0)) == versions.append(rows, at, "id", ("links", 0)) == 1
    assert versions.append(rows, at, "id", ("links", 1)) == 2
    assert versions.append(rows, at, "id", ("other", 0)) == 3
    assert len(state(spark, at)) == 6


def test_a_writer_that_comes_second_merges_again(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    files.write_chunks(chunks(spark, ("a", "1", "s")), at)
    done = []

    def meanwhile(name):
        if name == "commit" and not done:
            done.append(name)
            files.write_chunks(chunks(spark, ("a", "2", "s"), ("b", "2", "s")), at)

    monkeypatch.setattr(versions, "step", meanwhile)
    assert files.write_chunks(chunks(spark, ("b", "9", "s"), ("c", "9", "s")), at) == 3
    assert state(spark, at) == [("a", "2", "s"), ("b", "9", "s"), ("c", "9", "s")]


def test_upserts_equal_a_dictionary_and_rewrite_only_their_buckets(spark, tmp_path):
    r, at, want = random.Random(4), str(tmp_path / "t"), {}
    for _ in range(4):
        rows = {f"k{r.randint(0, 60)}": (str(r.random()), "s") for _ in range(12)}
        want |= rows
        files.write_chunks(chunks(spark, *[(k, *v) for k, v in rows.items()]), at)
    assert state(spark, at) == sorted((k, *v) for k, v in want.items())
    before = versions.current(spark, at)["buckets"]
    files.write_chunks(chunks(spark, ("k1", "new", "s")), at)
    after = versions.current(spark, at)["buckets"]
    assert sum(before.get(b) != w for b, w in after.items()) == 1
    versions.upsert(chunks(spark), at, "id")
    assert versions.current(spark, at)["buckets"] == after


def test_graph_tables_and_missing_vectors(spark, tmp_path):
    at = str(tmp_path / "g")
    e = spark.createDataFrame([("A", "t"), ("B", "t")], "id string, type string")
    x = spark.createDataFrame([("A", "Solves", "B"), ("A", "solves", "B")], "src string, rel string, dst string")
    files.write_graph(e, x, at)
    files.write_graph(e.filter("id = 'A'"), x, at)
    assert state(spark, f"{at}/entities") == [("A", "t"), ("B", "t")] and state(spark, f"{at}/edges") == [("A", "solves", "B")]
    c = spark.createDataFrame([("a", "x y"), ("b", "z")], "id string, text string")
    files.embed_missing(c.filter("id = 'a'"), f"{at}/v", 8)
    first = dict(state(spark, f"{at}/v"))
    files.embed_missing(c, f"{at}/v", 8)
    now = dict(state(spark, f"{at}/v"))
    assert sorted(now) == ["a", "b"] and now["a"] == first["a"]


def test_a_model_is_loaded_once_a_task_and_bad_texts_get_zero_vectors(spark, tmp_path):
    loads = tmp_path / "loads"
    loads.mkdir()

    def load():
        import uuid

        (loads / uuid.uuid4().hex).write_text("")

        def model(texts):
            if "bad" in texts:
                raise ValueError("bad")
            return [[float(len(t))] * (3 if t != "odd" else 2) for t in texts]

        return model

    rows = spark.createDataFrame([(t,) for t in ["a", "bbb", "bad", "odd", "cc"] * 500], "text string").coalesce(1)
    got = {r.text: list(r.embedding) for r in files.embed(rows, dim=3, load=load).distinct().collect()}
    assert got == {"a": [1.0] * 3, "bbb": [3.0] * 3, "bad": [0.0] * 3, "odd": [0.0] * 3, "cc": [2.0] * 3}
    assert len(list(loads.iterdir())) == 1


def test_hashed_embedding_counts_tokens():
    import pandas as pd
    import xxhash

    got = files.hashed(pd.Series(["A b a!", None, "?!"]), 1000)
    want = np.zeros(1000)
    for t in ("a", "b", "a"):
        want[xxhash.xxh64_intdigest(t) % 1000] += 1
    assert np.allclose(got[0], want / np.linalg.norm(want)) and not got[1].any() and not got[2].any()


def test_a_first_upsert_deals_its_rows_once(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 50 AS id", "'x' AS text").repartition(3).localCheckpoint()
    spark.sparkContext.setJobGroup("dealt once", "")
    versions.upsert(rows, str(tmp_path / "t"), "id")
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("dealt once") for s in tracker.getJobInfo(j).stageIds}
    ran = [s for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(ran) == 2 and versions.read(spark, str(tmp_path / "t")).count() == 50


def data_files(at):
    return {str(f.relative_to(at)) for f in at.glob("data/*/bucket=*/*.parquet")}


@pytest.mark.parametrize("at_once", [1, versions.AT_ONCE])
def test_an_upsert_of_rows_that_stand_keeps_no_new_files(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(versions, "AT_ONCE", at_once)
    rows = spark.range(200).selectExpr("id % 100 AS id", "CASE WHEN id % 3 > 0 THEN 'x' END AS text", "array(float('nan')) AS v")
    versions.upsert(rows, str(tmp_path), "id")
    before, files_before = versions.current(spark, str(tmp_path))["buckets"], data_files(tmp_path)
    stands = versions.read(spark, str(tmp_path))
    versions.upsert(stands.unionByName(stands).filter("id % 2 = 0"), str(tmp_path), "id")
    assert versions.current(spark, str(tmp_path))["buckets"] == before and data_files(tmp_path) == files_before
    versions.upsert(stands.filter("id = 7").withColumn("text", F.lit("new")).unionByName(stands.filter("id <> 7")), str(tmp_path), "id")
    after = versions.current(spark, str(tmp_path))["buckets"]
    assert sum(before[b] != w for b, w in after.items()) == 1
    got = {r.id: r.text for r in versions.read(spark, str(tmp_path)).collect()}
    assert versions.read(spark, str(tmp_path)).count() == len(got) == 100 and got[7] == "new"


def test_an_upsert_after_an_append_leaves_one_row_of_a_key(spark, tmp_path):
    at = str(tmp_path / "t")
    versions.append(chunks(spark, ("a", "1", "s"), ("a", "1", "s"), ("b", "1", "s")), at, "id")
    files.write_chunks(chunks(spark, ("a", "1", "s")), at)
    assert state(spark, at) == [("a", "1", "s"), ("b", "1", "s")]


def test_an_upsert_compares_no_maps(spark, tmp_path):
    at = str(tmp_path / "t")
    rows = spark.sql("SELECT 'a' AS id, map('k', 1) AS m UNION ALL SELECT 'b', map('k', 2)")
    versions.upsert(rows, at, "id")
    versions.upsert(rows.filter("id = 'a'"), at, "id")
    assert {r.id: r.m for r in versions.read(spark, at).collect()} == {"a": {"k": 1}, "b": {"k": 2}}


def test_a_bucket_is_dealt_over_tasks_and_a_job_leaves_no_shuffle_files(spark, tmp_path):
    import time

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: int(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size())
    try:
        at_first, was = held(), spark.conf.get(cleanup)
        versions.upsert(spark.range(1000), str(tmp_path), "id", n_buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    until = time.monotonic() + 20
    while held() > at_first and time.monotonic() < until:
        time.sleep(0.1)
    assert held() <= at_first and spark.conf.get(cleanup) == was
    assert all(len(list(d.glob("*.parquet"))) > 1 for d in tmp_path.glob("data/*/bucket=*"))


def test_chunks_of_a_row_are_those_of_the_window_and_shuffle_no_text(spark):
    from weftline.operators import retrieval

    long = "é" * 30
    texts = ["", None, f"a {long}\n## B b \n {long}\n## short\n\n## C\n{long}  ", f"## D\n{long}\n##E\n## \n{long}", f"\n\n {long} \n"]
    d = spark.createDataFrame([(str(i), "t", f"n{i}", t) for i, t in enumerate(texts)], "entity_id string, entity_type string, title string, text string")
    columns = ["entity_id", "section", "text", "chunk_index", "id", "entity_type", "title"]
    want = retrieval.chunk_markdown(d.select("entity_id", "text")).join(d.drop("text"), "entity_id").select(columns)
    got = files._chunked(d)
    assert got.columns == columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 6
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    twice = files._chunked(d.unionByName(d)).select("id").distinct()
    assert twice.count() == 12
