"""Quality classifier by importance resampling.

Two hashed n-gram models (words and word pairs) are counted: of the target
texts (labelled good) and of all texts, both smoothed, so that n-grams which
only the targets' own texts hold say little. A text's log-weight is the sum of
its n-grams' log-ratios, the logarithm of its importance weight. The sample is a
Gumbel top-k: each text's key is its log-weight plus Gumbel noise drawn from a
hash of its id and text, and the ``share`` of the rows with the largest keys is
selected, which is sampling without replacement in proportion to the weights
(with ``temper`` below 1, to that power of them). The threshold is found by
narrowing a histogram of keys, so no row travels to one place to be ranked.

The number of slots follows the bytes of text, a slot for about 1,000 of them,
from ``FEWEST`` to ``MOST`` (which bounds the broadcast table of log-ratios to
16 MB). All texts are counted in one scan without a join; only the targets are
found by a join with the labels, whose ids are broadcast if they were counted
to be at most ``IDS`` and merged otherwise. Counts are summed in two levels; a
core counts for two tasks at most, so that what is sent grows with the slots and
the cores, not with the slots times the files.

Defined results: null and empty texts have no n-grams and weight 0 and take
part; without any target text all weights are 0; ties of keys go to the smaller
doc_id, null ids last, and rows that repeat whole share one fate; a text is a
target if any of its labels has the wanted quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import sums, units
from weftline.llm.repeats import text_slices
from weftline.session import bounded_batches, checkpointed, table

FEWEST, MOST, SMOOTH, SHARE, SEED, IDS = 1 << 16, 1 << 22, 100.0, 0.5, 42, 1_000_000
U64 = np.uint64


def slots_of(texts: list[bytes], slots: int = FEWEST) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the texts' words and word pairs, and the index of the text that each belongs to."""
    buf, starts, stops, first = units.word_bounds([t.translate(units.LOWER) for t in texts], units.NON_ALNUM)
    u = units.word_hashes(buf, starts, stops)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = units.gram_hashes(u, 2)
    ok = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    h = np.concatenate([u, pair[ok]])
    return ((h >> U64(20)) & U64(slots - 1)).astype(np.int64), np.concatenate([owner, owner[1:][ok]])


def slots_for(size: int) -> int:
    """Slots for so many bytes of text."""
    return min(MOST, max(FEWEST, 1 << (size >> 10).bit_length()))


def count(texts: DataFrame, slots: int) -> np.ndarray:
    """Occurrences of n-grams by slot in all rows of (text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, np.int64)
        for _, own in text_slices(batches, 0):
            n += np.bincount(slots_of(own, slots)[0], minlength=slots)
        yield from sums.send({"n": n})

    few = texts.coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    found = sums.collect(few.mapInArrow(run, sums.SCHEMA)).get("n", np.zeros(0, np.int64))
    return np.append(found, np.zeros(slots - len(found), np.int64))


def fit(raw: DataFrame, target: DataFrame, slots: int) -> np.ndarray:
    """Log-ratios of target and raw for each slot, from two frames of (text binary)."""
    n = np.array([count(raw, slots), count(target, slots)], np.float64)
    if not n[1].sum():
        return np.zeros(slots, np.float32)
    share = n[1].sum() / n[0].sum()  # both models are smoothed alike: SMOOTH more of each slot among all texts, their share among the targets
    return (np.log((n[1] + SMOOTH * share) / (n[0] + SMOOTH)) - np.log(share)).astype(np.float32)


def score(spark: SparkSession, docs: DataFrame, ratios: np.ndarray, seed: int = SEED, temper: float = 1.0) -> DataFrame:
    """From (doc_id, text binary): doc_id, n_grams, log_weight, gumbel_key."""
    shared = spark.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for x, texts in text_slices(batches, 1):
            slot, owner = slots_of(texts, len(r))
            n = np.bincount(owner, minlength=len(texts))
            w = np.bincount(owner, r[slot], minlength=len(texts))
            ids = x.column(0).to_pylist()
            h = units.mix(np.array([(0 if i is None else i) & 0xFFFFFFFFFFFFFFFF for i in ids], U64) * units._ODD + np.array([units.subtag(t) for t in texts], U64) + U64(seed))
            u = ((h >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
            key = temper * w - np.log(-np.log(u))
            yield pa.record_batch([x.column(0), pa.array(n, pa.int64()), pa.array(w), pa.array(key)], ["doc_id", "n_grams", "log_weight", "gumbel_key"])

    return docs.mapInArrow(run, "doc_id long, n_grams long, log_weight double, gumbel_key double")


def top(scored: DataFrame, k: int, bins: int = 2048) -> DataFrame:
    """Marks the k rows with the largest keys (ties: smaller doc_id; all of the last tie's equal rows).

    Keys are narrowed as whole numbers (of 2**-32), a histogram at a time, until
    the bin that holds the k-th largest is small; only that bin is ranked.
    """
    whole = F.floor(F.col("gumbel_key") * F.lit(float(1 << 32))).cast("long")
    rows = scored.withColumn("_whole", whole)
    lo, hi = rows.agg(F.min("_whole"), F.max("_whole")).first()
    if lo is None or k <= 0:
        return scored.withColumn("selected", F.lit(False))
    above = 0
    while True:
        width = -(-(hi - lo + 1) // bins)
        part = rows.filter(F.col("_whole").between(lo, hi))
        n = {r.b: r["count"] for r in part.groupBy(F.expr(f"(_whole - {lo}L) div {width}L").alias("b")).count().collect()}
        for b in sorted(n, reverse=True):
            if above + n[b] >= k:
                break
            above += n[b]
        else:
            return scored.withColumn("selected", F.lit(True))
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
        if width == 1 or n[b] <= bins:
            break
    edge = rows.filter(F.col("_whole").between(lo, hi)).select("gumbel_key", "doc_id").orderBy(F.desc("gumbel_key"), F.asc_nulls_last("doc_id"))
    last = edge.offset(k - above - 1).limit(1).first()
    same = F.lit(True) if last.doc_id is None else F.coalesce(F.col("doc_id") <= last.doc_id, F.lit(False))
    return scored.withColumn("selected", (F.col("gumbel_key") > last.gumbel_key) | (F.col("gumbel_key") == last.gumbel_key) & same)


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, quality: int = 1, temper: float = 1.0) -> DataFrame:
    """Per row: doc_id, n_grams, log_weight, gumbel_key, selected."""
    bounded_batches(spark)
    good = checkpointed(spark, labels.filter(F.col("quality") == quality).select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    target = rows.join(good.hint("broadcast" if good.count() <= IDS else "merge"), "doc_id", "left_semi")
    ratios = fit(rows.select("text"), target.select("text"), slots_for(size))
    scored = checkpointed(spark, score(spark, rows, ratios, temper=temper))
    return top(scored, round(share * scored.count()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
