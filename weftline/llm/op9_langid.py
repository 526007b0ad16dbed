"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts, over every labelled text, how often each hashed 1-, 2- and
3-gram of lower-cased letters (anything else is a gap) occurs in each language.
Counts leave a map task in slices of the hash table, which are summed in two
levels by streaming. The matrix of log-probabilities,
``SLOTS`` times the number of languages and independent of the input's size, is
broadcast; scoring gathers its rows for a batch of texts at once in numpy.

Defined results: ``und`` with score 0 for a null text or one without letters
(and for all if nothing was learned); ties go to the first language by name;
rows with a null lang teach nothing but are predicted; a null doc_id is held
out of nothing (its remainder is that of the empty text); repeated rows count
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import sums
from weftline.session import bounded_batches, table

SLOTS, ORDERS, SMOOTH, BATCH = 1 << 16, (1, 2, 3), 0.5, 1 << 18
UND = "und"


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of the texts end to end, 0 for all else; and each text's begin. Two gaps begin every text and one ends it, so that no n-gram depends on the text before."""
    low = ["\n\n" + t.lower() + "\n" for t in texts]
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=ends[1:])
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[c], c, 0).astype(np.uint32), ends


def grams(c: np.ndarray, orders: tuple[int, ...] = ORDERS, slots: int = SLOTS) -> Iterator[np.ndarray]:
    """Slots of the n-grams that end at each place, for each order; -1 where that is no n-gram with a letter in its middle or end."""
    shift = np.uint32(32 - slots.bit_length() + 1)
    live = c > 0
    for n in orders:
        h = np.zeros(len(c), np.uint32)
        for k in range(n):
            h[n - 1 :] = h[n - 1 :] * np.uint32(0x01000193) + c[k : len(c) - n + 1 + k] + np.uint32(n)
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        out = (h >> shift).astype(np.int32)
        ok = live.copy()
        ok[: n - 1] = False
        if n > 1:  # also the gram that closes a word
            ok[1:] |= live[:-1]
            ok[: n - 1] = False
        out[~ok] = -1
        yield out


def text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about BATCH characters, with their texts."""
    for x in batches:
        texts = [t or "" for t in x.column(column).to_pylist()]
        lo, size = 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t)
            if size >= BATCH or hi == len(texts):
                yield x.slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0


def fit(spark: SparkSession, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (sorted), log-priors, and log-probabilities (slots by languages)."""

    bounded_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for x, texts in text_batches(batches, 0):
            langs = x.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, y in zip(texts, langs) if y == lang]
                rows[lang] = rows.get(lang, 0) + len(own)
                c, _ = codes(own)
                for g in grams(c):
                    n = np.bincount(g + 1, minlength=SLOTS + 1)[1:]
                    held[lang] = held[lang] + n if lang in held else n
        yield from sums.send({lang: np.append(n, np.bincount([0], [rows[lang]], minlength=sums.SLICE)) for lang, n in held.items()})

    counted = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null").mapInArrow(count, sums.SCHEMA)
    found = sums.collect(counted)
    langs = sorted(found)
    n = np.array([found[x][:SLOTS] for x in langs], np.float64).reshape(len(langs), SLOTS).T
    rows = np.array([found[x][SLOTS] for x in langs], np.float64)  # the rows' number stands behind the slots
    with np.errstate(divide="ignore"):
        return langs, np.log(rows / max(rows.sum(), 1)), np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * SLOTS)).astype(np.float32)


def predict(spark: SparkSession, docs: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score (the posterior of the prediction) added."""
    langs, prior, matrix = model
    table_ = spark.sparkContext.broadcast(np.vstack([np.zeros((1, len(langs)), np.float32), matrix]))
    names = [f.name for f in docs.schema]
    place = names.index(text_col)
    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")
    keep = [k for k, x in enumerate(names) if x not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table_.value
        for x, texts in text_batches(batches, place):
            c, ends = codes(texts)
            has = np.add.reduceat(c > 0, ends[:-1], dtype=np.int64) > 0
            total = np.tile(prior, (len(texts), 1))
            if langs:
                for g in grams(c):
                    total += np.add.reduceat(m[g + 1], ends[:-1], axis=0, dtype=np.float64)
                best = total.argmax(axis=1)
                p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            has &= bool(langs)
            pred = [langs[b] if h else UND for b, h in zip(best, has)] if langs else [UND] * len(texts)
            score = np.where(has, p, 0.0) if langs else np.zeros(len(texts))
            yield pa.record_batch([*(x.column(k) for k in keep), pa.array(pred), pa.array(score)], [*(names[k] for k in keep), "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows not held out, predicts all: doc_id, held_out, lang_pred, score."""
    model = fit(spark, docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(spark, rows, model).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))
