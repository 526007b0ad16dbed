"""The pipeline's stages against their definitions by brute force."""

import hashlib

from weftline.llm import op4_suffix, op7_simhash, op8_decontam, registry
from weftline.session import scratch, table

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = scratch(spark, "stage")
        stage(spark, docs, SF).write.parquet(at)
        before, docs = docs, spark.read.parquet(at)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
        old = {r.doc_id: r for r in before.collect()}
        raw = [(i, r.text.encode()) for i, r in sorted(old.items())]
        if name == "SimHash near-dedup":
            right = {i for i, c in op7_simhash.brute_copies(raw).items() if i == c}
            assert right <= set(kept[name]) and len(set(kept[name]) - right) <= 0.01 * len(raw)
        elif name == "suffix-array dedup":
            for i, n, gone, _, sha in op4_suffix.brute(raw):
                if gone == 0:
                    assert hashlib.sha256(kept[name][i].text.encode()).hexdigest() == sha
                elif i in kept[name]:
                    assert n - gone - 6 * 2 <= len(kept[name][i].text.encode()) <= n - gone
        elif name == "benchmark decontamination":
            items = [(r.item_id, (r.text or "").encode()) for r in table(spark, SF, "benchmark").collect()]
            assert set(kept[name]) == {r[0] for r in op8_decontam.brute(raw, items) if not r[5]}
        else:
            assert set(kept[name]) == set(old)  # all of them are in a language
        assert all(r.n_chars == len(r.text) for r in kept[name].values())
    last = corpus_pipeline.tokens(spark, docs, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in kept["benchmark decontamination"].items()}


def test_entry_has_all():
    import __spark_entry__

    assert set(registry.queries()) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages_survive_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the same text of some words in here", "en", "s", None), (2, "the same text of some words in here", "en", "s", None), (3, "the same text of some words in here", None, "s", 5), (None, "another text with quite other words", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, "another text with quite other words"), (2, "the same text of some words in here")]
