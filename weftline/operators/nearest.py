"""Exact nearest neighbours of many queries: tiles of vectors against tiles of queries.

A batch of vectors meets a tile of queries in one matrix product. Of each query
only what can still be among its best stays in the task, so no row of a losing
pair leaves it. What the tasks keep is merged in two steps, first within a
``MERGE``-th of the tasks.

Queries whose counted bytes stay under a bound are sent to every task as they
are. More of them stay a table: both sides are packed into tiles, and each tile
of vectors is sent to each tile of queries, which is what an exact search of so
many takes; use an index where that is too much.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import bounded_batches, buckets, checkpointed

#: Bytes of queries sent to every task, rows of a tile, and groups of tasks merged first.
MOST_BYTES, TILE, MERGE = 32 << 20, 4096, 64
#: Matrix products differ in their last digits; what is this near the last place is kept and measured again.
MARGIN = 1e-9


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors (zero for a zero vector) of the rows of that length without nulls."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) == dim) & (bad[ends[1:]] == bad[ends[:-1]])
    at = np.flatnonzero(ok)
    return at, unit(flat[ends[at][:, None] + np.arange(dim)])


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


class Best:
    """The pairs of one task that may be among their query's best: the cosine times a row's weight is known up to a factor between 1 and ``slack``."""

    def __init__(self, queries: np.ndarray, limit: int, slack: float):
        self.queries, self.limit, self.slack = queries, limit, slack
        self.least = np.full(len(queries), -np.inf)  # limit scores of at least this are known
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]] = []
        self.size = 0

    def bounds(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        more = score * self.slack
        return np.minimum(score, more), np.maximum(score, more)

    def add(self, x: np.ndarray, weight: np.ndarray, rows: pa.RecordBatch) -> None:
        for lo in range(0, len(self.queries), 512):
            q = self.queries[lo : lo + 512]
            cosine = x @ q.T
            low, high = self.bounds(cosine * weight[:, None])
            if len(x) >= self.limit:
                own = np.partition(low, len(x) - self.limit, axis=0)[len(x) - self.limit]
                self.least[lo : lo + 512] = np.maximum(self.least[lo : lo + 512], own)
            i, j = np.nonzero(high >= self.least[lo : lo + 512] - MARGIN)
            exact = (x[i] * q[j]).sum(axis=1)
            self.held.append((j + lo, exact, exact * weight[i], rows.take(pa.array(i))))
            self.size += len(i)
        if self.size > 4 * self.limit * len(self.queries) + TILE:
            self.compact()

    def compact(self) -> None:
        j, cosine, score = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        rows = pa.Table.from_batches([h[3] for h in self.held])
        low, high = self.bounds(score)
        at = np.lexsort((-low, j))
        begin = np.searchsorted(j[at], np.arange(len(self.queries) + 1))
        full = np.flatnonzero(np.diff(begin) >= self.limit)
        self.least[full] = np.maximum(self.least[full], low[at[begin[full] + self.limit - 1]])
        keep = np.flatnonzero(high >= self.least[j] - MARGIN)
        batch = rows.take(pa.array(keep)).combine_chunks().to_batches()
        self.held = [(j[keep], cosine[keep], score[keep], batch[0] if batch else rows.schema.empty_table().to_batches()[0])] if len(keep) else []
        self.size = len(keep)

    def out(self) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch] | None:
        if self.held:
            self.compact()
        return (self.held[0][0], self.held[0][1], self.held[0][3]) if self.held else None


def top_pairs(vectors: DataFrame, queries: DataFrame, limit: int, weight: str | None = None, slack: float = 1.0, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(query_id, the vectors' other columns, similarity): of each query (query_id, qvec) at least all pairs that can be among its ``limit`` best.

    The score that counts is the cosine times ``weight`` (a column, positive)
    times a factor between 1 and ``slack`` that only the caller knows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, TILE)
    asked = checkpointed(spark, queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).filter("qvec is not null"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("dim")).first()
    kept = [c for c in vectors.columns if c not in ("vec", weight)]
    schema = asked.select("query_id").schema
    for f in vectors.select(*kept).schema:
        schema = schema.add(f)
    schema = schema.add("similarity", "double")
    if not size.n:
        return spark.createDataFrame([], schema)
    source = vectors.select(*kept, F.lit(1.0).alias("_w") if weight is None else F.col(weight).cast("double").alias("_w"), F.col("vec").cast("array<double>").alias("vec"))
    dim, n = size.dim, len(kept)
    few = size.n * dim * 8 <= most_bytes

    def tile(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
        at, x = matrix(b.column(n + 1), dim)
        rows = b.take(pa.array(at))
        return x, rows.column(n).to_numpy(zero_copy_only=False), rows.select(kept)

    def given(best: Best, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if found := best.out():
            j, cosine, rows = found
            yield pa.record_batch([ids.take(pa.array(j)), *rows.columns, pa.array(cosine)], ["query_id", *kept, "similarity"])

    if few:
        rows = asked.toArrow().combine_chunks()
        at, q = matrix(rows.column("qvec").chunk(0), dim)
        shared = spark.sparkContext.broadcast((rows.column("query_id").chunk(0).take(pa.array(at)), q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(q, limit, slack)
            for b in batches:
                best.add(*tile(b))
            yield from given(best, ids)

        return source.mapInArrow(run, schema)

    tiles = -(-size.n * dim * 8 // most_bytes)
    asked = asked.withColumn("_tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"))
    sent = source.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("_part", F.spark_partition_id() % MERGE)
    left = sent.select("_tile", "_part", F.struct(*kept, "_w", "vec").alias("v"), F.lit(None).cast(asked.select(F.struct("query_id", "qvec").alias("q")).schema[0].dataType).alias("q"))
    right = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(MERGE - 1)))).select("_tile", "_part", F.lit(None).cast(left.schema["v"].dataType).alias("v"), F.struct("query_id", "qvec").alias("q"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each (tile, part): its queries first, then vectors."""
        at, ids, held, best = None, [], [], None
        for b in batches:
            t, p, v, q = b.columns
            key = np.stack([t.to_numpy(), p.to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if (now := tuple(key[lo].tolist())) != at:
                    if best is not None:
                        yield from given(best, ids)
                    at, ids, held, best = now, None, [], None
                asking = q.slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)
                if asking.any():
                    own = q.slice(lo, hi - lo).take(pa.array(np.flatnonzero(asking)))
                    held.append(pa.Table.from_batches([pa.RecordBatch.from_struct_array(own)]))
                if not asking.all():
                    if best is None:
                        if not held:
                            continue
                        rows = pa.concat_tables(held).combine_chunks()
                        which, m = matrix(rows.column("qvec").chunk(0), dim)
                        ids, best = rows.column("query_id").chunk(0).take(pa.array(which)), Best(m, limit, slack)
                    own = v.slice(lo, hi - lo).take(pa.array(np.flatnonzero(~asking)))
                    best.add(*tile(pa.RecordBatch.from_struct_array(own)))
        if best is not None:
            yield from given(best, ids)

    met = left.unionByName(right).repartition(buckets(spark, 4), "_tile", "_part").sortWithinPartitions("_tile", "_part", F.col("q").isNull())
    return met.mapInArrow(stream, schema)


def merged(pairs: DataFrame, limit: int, score: str = "score", key: str = "id") -> DataFrame:
    """The ``limit`` best of each query with their rank, first within groups of tasks."""
    from weftline.operators.retrieval import top

    some = pairs.withColumn("_group", F.spark_partition_id() % MERGE)
    first = top(some, limit, by=["query_id", "_group"], score=score, key=key).drop("rank", "_group")
    return top(first, limit, score=score, key=key)
