"""Vector code compression: product codes over integer vectors, by float32 screening and int64 re-evaluation.

Each component x becomes floor(1024 * x). A vector is cut into four equal parts,
and a part's code is the nearest of 256 codebook entries of its position. The
codebooks begin as the parts of the 256 smallest ids and move through four
rounds of assigning and averaging, all in integers.

The nearest entry is found by screening. One float32 matrix product of a block
of parts with the codebook gives every squared distance but for the part's own
norm. A product of d terms in float32 is off by at most g * |x| * |e|, in any
order of summation, where g = n * u / (1 - n * u), u = 2**-24 and n = d + 3
(conversion of both factors counted); so each distance lies in a known
interval. Entries whose interval overlaps that of the best upper end are
evaluated again in int64, and equal distances go to the lower index. Of equal
entries only the first can win, so the others are not looked at.

Every round is one pass over the table; what leaves a task is its sums and
counts (256 entries of each part), added up in two levels. The codebooks, 256
vectors, are the only thing broadcast. Equal labels' errors are summed within
map tasks before they are shuffled; a label with more than a 512th of the rows
is joined from a broadcast of at most 512 rows, so no task receives its rows.

Defined results: rows whose vector is null, or holds null, NaN or infinite
components, are dropped, and so are vectors of another length than the most
frequent one that four divides (the shorter of ties); integers saturate at
2**25, far beyond any embedding; of equal ids the lesser vector comes first,
null ids come last; repeated rows count each; fewer than 256 vectors make as
many entries; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from weftline.llm import sums
from weftline.session import bounded_batches, checkpointed, table

PARTS, ENTRIES, ROUNDS, SCALE, EDGE = 4, 256, 4, 1024, 1 << 25
#: Vectors screened at once, and labels that are joined from a broadcast.
BLOCK, HOT = 1024, 512
UNIT = 2.0**-24


def integers(column: pa.Array, length: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (row numbers, integer vectors)} of the vectors that take part; of one length only, if given."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~np.isfinite(flat), out=bad[1:])
    size = np.diff(ends)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]) & (size > 0) & (size % PARTS == 0)
    out = {}
    for n in [length] if length else np.unique(size[ok]).tolist():
        at = np.flatnonzero(ok & (size == n))
        x = flat[ends[at][:, None] + np.arange(n)]
        out[n] = at, np.clip(np.floor(x * SCALE), -EDGE, EDGE).astype(np.int64)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (lower of ties) and the squared distance for each row of x; all integers."""
    own = np.sort(np.unique(book, axis=0, return_index=True)[1])
    e = book[own]
    e32, norm2 = e.T.astype(np.float32), (e.astype(np.float64) ** 2).sum(axis=1)
    norm = np.sqrt(norm2)
    n = x.shape[1] + 3
    wide = 2 * n * UNIT / (1 - n * UNIT) * (1 + 1e-9)
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        dots = (part.astype(np.float32) @ e32).astype(np.float64)
        score = norm2 - 2 * dots
        radius = wide * np.sqrt((part.astype(np.float64) ** 2).sum(axis=1))[:, None] * norm + (norm2 + 2 * np.abs(dots)) * 2.0**-48
        row, col = np.nonzero(score - radius <= (score + radius).min(axis=1)[:, None])
        exact = ((part[row] - e[col]) ** 2).sum(axis=1)
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(exact, begin)
        tied = np.flatnonzero(exact == least[row])
        first = tied[np.append(True, row[tied][1:] != row[tied][:-1])]
        index[lo : lo + BLOCK], error[lo : lo + BLOCK] = own[col[first]], least
    return index, error


def halves(x: np.ndarray) -> list[np.ndarray]:
    """The parts of vectors."""
    return np.split(x, PARTS, axis=1)


def vectors(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(vec_id, vector of floats, further columns)."""
    kind = df.schema[vector_col].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")).alias("vector"), *more)


def start(spark: SparkSession, source: DataFrame) -> np.ndarray:
    """The integer vectors of the smallest ids, of the prevailing length."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list]] = {}
        for b in batches:
            ids = b.column(0).to_pylist()
            for n, (at, x) in integers(b.column(1)).items():
                count, rows = held.get(n, (0, []))
                rows += [(ids[i] is None, ids[i] or 0, v) for i, v in zip(at.tolist(), x.tolist())]
                held[n] = count + len(at), sorted(rows)[:ENTRIES]
        for n, (count, rows) in held.items():
            yield pa.record_batch([pa.array([n] * len(rows), pa.int64()), pa.array([count if k == 0 else 0 for k in range(len(rows))], pa.int64()), pa.array([None if r[0] else r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["length", "n", "vec_id", "x"])

    found = checkpointed(spark, source.mapInArrow(least, "length long, n long, vec_id long, x array<long>"))
    top = found.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").first()
    if top is None:
        return np.zeros((0, PARTS), np.int64)
    first = found.filter(F.col("length") == top.length).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    return np.array([r.x for r in first], np.int64)


def fit(spark: SparkSession, source: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook (entries by components, integers) for each part of vectors (vec_id, vector)."""
    books = halves(start(spark, source))
    for _ in range(rounds if len(books[0]) else 0):
        shared = spark.sparkContext.broadcast(books)

        def tally(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            k, d = now[0].shape
            total = np.zeros((PARTS, k, d + 1), np.int64)  # the counts stand behind the components
            for b in batches:
                for _, x in integers(b.column(1), PARTS * d).values():
                    for p, part in enumerate(halves(x)):
                        for lo in range(0, len(part), 1 << 16):  # sums of so many integers are exact in float64
                            own = part[lo : lo + (1 << 16)]
                            at, _ = nearest(own, now[p])
                            total[p, :, d] += np.bincount(at, minlength=k)
                            for j in range(d):
                                total[p, :, j] += np.bincount(at, own[:, j], k).astype(np.int64)
            flat = {str(p): np.pad(t.ravel(), (0, -t.size % sums.SLICE)) for p, t in enumerate(total)}
            yield from sums.send(flat)

        found, (k, d) = sums.collect(source.mapInArrow(tally, sums.SCHEMA)), books[0].shape
        for p in range(PARTS):
            t = np.pad(found[str(p)], (0, max(0, k * (d + 1) - len(found[str(p)]))))[: k * (d + 1)].reshape(k, d + 1)
            used = t[:, d] > 0
            books[p] = np.where(used[:, None], t[:, :d] // np.maximum(t[:, d:], 1), books[p])
        shared.unpersist()
    return books


def assign(spark: SparkSession, source: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of the vectors that take part."""
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        length = PARTS * now[0].shape[1]
        for b in batches:
            at, x = integers(b.column(1), length)[length]
            if not len(at) or not len(now[0]):
                continue
            found = [nearest(part, book) for part, book in zip(halves(x), now)]
            code = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            rows = pa.array(at)
            yield pa.record_batch([b.column(0).take(rows), b.column(2).take(rows), pa.array([c.tobytes().hex() for c in code]), pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    schema = source.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return source.mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector that takes part: vec_id, code, error, label_error, codebooks_sha256."""
    bounded_batches(spark, 8192)
    source = vectors(df, id_col, vector_col, F.col(label_col).alias("label"))
    books = fit(spark, source.select("vec_id", "vector"))
    coded = checkpointed(spark, assign(spark, source, books))
    total = checkpointed(spark, coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    limit = max(64, (total.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot, rest = F.broadcast(total.filter(F.col("n") > limit).drop("n")), total.filter(F.col("n") <= limit).drop("n")
    same = lambda other: coded.label.eqNullSafe(other.label)
    out = coded.join(hot, same(hot)).drop(hot.label)
    if not rest.isEmpty():
        out = out.unionByName(coded.join(hot, same(hot), "left_anti").join(rest, same(rest)).drop(rest.label))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark, table(spark, sf_dir, "embeddings"))
