"""Suffix-array dedup by merging shard Burrows-Wheeler transforms.

Bytes covered by a ``length``-byte string that also starts earlier in the
corpus are removed. Runs of windows that can repeat at all travel by their
minimiser (see repeats.py), so a bucket is a small corpus that holds every
occurrence of its windows. There

* the strings are split into shards, and each shard's suffixes are sorted to
  the window's depth, which gives its Burrows-Wheeler transform;
* the transforms are merged without re-sorting: the interleave (which shard
  each row of the merged order comes from) begins as "shard after shard" and is
  refined by stable passes over the symbols before each row. After pass h the
  rows are in the order of their first h symbols, and a row where the order
  first parted at pass h has a common prefix of h - 1 symbols with the row
  above it. Rows whose common prefix reaches the window's length form the
  repeated intervals.

A symbol is a step of ``length / passes`` bytes (20 at 100), each of a string's
20 phases being a sequence of its own: equal windows are equal in 5 symbols,
so 5 passes do what 100 passes over single bytes would.

Defined results: a null or empty text, and one shorter than ``length``, keeps
all it has; rows that repeat whole count as one text and get one result each;
rows that share an id but not a text are ordered by a checksum; a null id
sorts first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import repeats, units
from weftline.llm.repeats import Rule
from weftline.session import table

LENGTH, GRAM, SHARDS = 100, 20, 4
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<int>, stops array<int>, kept binary, extra string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("kept", pa.binary()), ("extra", pa.string())])


def step_of(length: int) -> int:
    """The symbol's width: a divisor of the length that leaves few passes."""
    return next(d for d in (length // k for k in range(min(5, length), length + 1) if length % k == 0))


def symbols(buf: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """The step bytes from each place as an ordered alphabet from 1; 0 where a string ends sooner."""
    if step % 5:
        return repeats.rank_windows(buf, left, step)
    five = np.zeros(len(buf), np.int64)
    ok = np.flatnonzero(left >= 5)
    for j in range(5):
        five[ok] = (five[ok] << 8) | buf[ok + j]
    r = np.zeros(len(buf), np.int64)
    r[ok] = repeats.rank_pairs(five[ok] >> 20, five[ok] & 0xFFFFF)
    return np.where(left >= step, _times(r, left, 5, step // 5), 0)


def _times(r: np.ndarray, left: np.ndarray, width: int, k: int) -> np.ndarray:
    """Ranks of k steps from ranks of one step of ``width`` bytes; what ends sooner ranks by the part it has."""
    out, have, at = None, 0, r

    def join(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
        tail = np.zeros(len(a), np.int64)
        ok = np.flatnonzero(left > gap)
        tail[ok] = b[ok + gap]
        live = np.flatnonzero(a > 0)
        c = np.zeros(len(a), np.int64)
        c[live] = repeats.rank_pairs(a[live], tail[live])
        return c

    while True:
        if k & 1:
            out, have = (at, width) if out is None else (join(out, at, have), have + width)
        k >>= 1
        if not k:
            return out
        at, width = join(at, at, width), width * 2


def transform(sym: np.ndarray, left: np.ndarray, before: np.ndarray, step: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffix order (to the window's depth) and the symbol before each suffix (0: its phase begins)."""
    depth = _times(sym, left, step, passes)
    _, order = repeats.order(depth.astype(np.uint64), 24 if len(depth) < 1 << 24 else 40)
    return order, np.where(before[order] >= step, sym[order - step], 0)


def merge(shards: list[tuple[np.ndarray, np.ndarray]], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges shards (suffix places, preceding symbols): the places in merged order, and each row's common prefix with the row above, in symbols."""
    sizes = np.array([len(x) for x, _ in shards])
    ends = np.append(0, np.cumsum(sizes))
    places, bwt = np.concatenate([x for x, _ in shards]), np.concatenate([c for _, c in shards])
    bits = max(1, int(bwt.max()).bit_length()) if len(bwt) else 1
    z = np.repeat(np.arange(len(shards), dtype=np.int8), sizes)
    lcp = np.full(len(z), passes, np.int64)
    if len(lcp):
        lcp[0] = 0
    block = np.zeros(len(z), np.int64)

    def source() -> np.ndarray:
        out = np.empty(len(z), np.int64)
        for k in range(len(shards)):
            out[np.flatnonzero(z == k)] = np.arange(ends[k], ends[k + 1])
        return out

    for h in range(1, passes + 1):
        c = bwt[source()]
        c, at = repeats.order(c.astype(np.uint64), bits)
        z, block = z[at], block[at]
        parted = np.append(True, (c[1:] != c[:-1]) | (block[1:] != block[:-1]) | (c[1:] == 0))
        lcp[parted & (lcp == passes) & (np.arange(len(z)) > 0)] = h - 1
        block = np.cumsum(parted)
    return places[source()], lcp


def judge(length: int, n_shards: int = SHARDS):
    step = step_of(length)
    passes = length // step

    def run(own: dict[str, np.ndarray], strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf, ends = units.lay([s + b"\0" for s in strings])  # the empty suffix ends one of the phases
        size = np.diff(ends)
        string = np.repeat(np.arange(len(strings)), size)
        before = np.arange(len(buf)) - ends[string]
        left = size[string] - 1 - before
        sym = symbols(buf, left, step)
        cut = np.unique(np.append(np.searchsorted(ends, np.linspace(0, len(buf), min(n_shards, len(strings)) + 1)[:-1]), len(strings)))
        shards = []
        for i, j in zip(cut[:-1], cut[1:]):
            a, b = ends[i], ends[j]
            order, c = transform(sym[a:b], left[a:b], before[a:b], step, passes)
            shards.append((order + a, c))
        places, lcp = merge(shards, passes)
        cls = np.cumsum(lcp < passes)
        again = np.bincount(cls)[cls] > 1
        places, cls = places[again], cls[again]
        return repeats.later(own, string[places], before[places], cls)

    return run


def characters(piece: bytes) -> bytes:
    """The piece of a UTF-8 text without the parts of characters at its ends."""
    lo, hi = 0, len(piece)
    while lo < hi and piece[lo] & 0xC0 == 0x80:
        lo += 1
    at = hi - 1
    while at >= lo and piece[at] & 0xC0 == 0x80:
        at -= 1
    if at >= lo and piece[at] >= 0xC0 and hi - at < 2 + (piece[at] >= 0xE0) + (piece[at] >= 0xF0):
        hi = at
    return piece[lo:hi]


def finish(length: int, whole: bool = False):
    def run(ids: list[int], texts: list[bytes], nulls: list[bool], extras: list[bytes], spans: dict) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in ARROW]
        for i, t, null, extra in zip(ids, texts, nulls, extras):
            x = spans.get((i, units.subtag(t)))
            starts, stops, kept = [], [], t
            if x is not None:
                gone = np.zeros(len(t) + 2, np.int8)
                gone[1:-1] = repeats.covered(len(t), length, *x)
                turn = np.diff(gone)
                starts, stops = np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()
                pieces = [t[a:b] for a, b in zip([0, *stops], [*starts, len(t)])]
                kept = b"".join(map(characters, pieces) if whole else pieces)
            for k, v in enumerate((None if null else i, len(t), sum(stops) - sum(starts), len(starts), starts, stops, kept, extra.decode())):
                out[k].append(v)
        yield pa.record_batch([pa.array(v, f.type) for v, f in zip(out, ARROW)], schema=ARROW)

    return run


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Per text: its bytes, how many were removed in how many spans, the spans, and the bytes kept; ``extra``: the columns to carry, as JSON.

    With ``whole`` the parts of characters that a cut leaves go from ``kept`` too.
    """
    return repeats.find(spark, docs, id_col, text_col, Rule(False, length, min(gram, length)), judge(length), finish(length, whole), SCHEMA, carry)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[tuple[int, bytes]], length: int = LENGTH) -> list[tuple]:
    """The definition, literally; for tests."""
    seen: set[bytes] = set()
    out = []
    for i, t in sorted(texts):
        gone = np.zeros(len(t) + 2, np.int8)
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if s in seen:
                gone[p + 1 : p + 1 + length] = 1
            seen.add(s)
        kept = bytes(c for c, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), len(t) - len(kept), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
