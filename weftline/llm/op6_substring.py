"""Substring dedup by super-k-mer partitioning.

A window is ``length`` consecutive words of one text. Consecutive windows that
share a minimiser travel as one packed string to its bucket (see repeats.py),
where windows are sorted, which counts them exactly: words are numbered by
their bytes and windows ranked by doubling, no hash deciding equality. A word
is removed if a window that covers it also starts earlier.

Defined results: a null or empty text has no words; one with fewer words than
``length`` keeps all; rows that repeat whole count as one text; rows that share
an id but not a text are ordered by a checksum; a null id sorts first; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import repeats, units
from weftline.llm.repeats import Rule, words_of
from weftline.session import table

LENGTH, GRAM = 20, 4
SCHEMA = "doc_id long, n_words long, n_removed long, kept binary, extra string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("extra", pa.string())])


def judge(length: int):
    def run(own: dict[str, np.ndarray], strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = b" ".join(strings).split(b" ")
        number = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
        size = own["n"].astype(np.int64) + length - 1
        string, offset = np.repeat(np.arange(len(strings)), size), units.ramp(size)
        rank = repeats.rank_windows(number, size[string] - offset, length)
        full = np.flatnonzero(rank > 0)
        full = full[np.bincount(rank)[rank[full]] > 1]
        return repeats.later(own, string[full], offset[full], rank[full])

    return run


def finish(length: int):
    def run(ids: list[int], texts: list[bytes], nulls: list[bool], extras: list[bytes], spans: dict) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in ARROW]
        for i, t, null, extra in zip(ids, texts, nulls, extras):
            words = words_of(t)
            x, kept = spans.get((i, units.subtag(t))), words
            if x is not None:
                gone = repeats.covered(len(words), length, *x).tolist()
                kept = [w for w, g in zip(words, gone) if not g]
            for k, v in enumerate((None if null else i, len(words), len(words) - len(kept), b" ".join(kept), extra.decode())):
                out[k].append(v)
        yield pa.record_batch([pa.array(v, f.type) for v, f in zip(out, ARROW)], schema=ARROW)

    return run


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per text: its words, how many were removed, and the words kept, joined by one blank; ``extra``: the columns to carry, as JSON."""
    return repeats.find(spark, docs, id_col, text_col, Rule(True, length, min(gram, length)), judge(length), finish(length), SCHEMA, carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[tuple[int, bytes]], length: int = LENGTH) -> list[tuple]:
    """The definition, literally; for tests."""
    seen: set[tuple] = set()
    out = []
    for i, t in sorted(texts):
        words = words_of(t)
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            s = tuple(words[p : p + length])
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
