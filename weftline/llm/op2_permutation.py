"""Approximate nearest neighbours by a permutation index.

Pivots stand for the space: a vector is its ``prefix`` nearest pivots in order.
The index is dealt by a hash of the vector's id into shards of about ``SHARD``
vectors. A shard has an inverted file for each pivot that holds the (vector,
place) pairs of the vectors near it, and the vectors themselves aside. A query
reads the files of its own pivots and adds up, per vector, what each shared
pivot takes from the footrule distance: with a missing pivot counting as just
beyond the prefix of m, the distance is m(m + 1) less 2(m - max(place in the
query, place in the vector)) for each pivot that both have. Over all files of a
shard that is the whole footrule distance; the shard's part of the best
``candidates`` vectors (ties included) is ranked again by exact cosine in double
precision on the original vectors, and the shards' bests are merged.

Candidates are 4 n^0.6 of n vectors (256 at least), so the share that is scored
exactly falls as the table grows. Pivots grow with the square root of the rows
from 512 to ``MOST`` (which bounds what is broadcast and sampled); postings that
a query reads are a fixed multiple of the rows up to there. Queries go to every
shard in blocks. Equal vectors are one posting in effect: only the k + 1
smallest ids of a vector can be among anyone's k nearest, so no others are
posted, and equal queries search once.

Measured recall at 5 against brute force, with the share of rows scored, is in
the README.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor those of another length than most (of equally
frequent lengths the longest); a query never finds itself but finds its
copies; of rows that repeat an id with different vectors the least vector
counts; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import units
from weftline.llm.repeats import groups, names, rows
from weftline.session import buckets, checkpointed, table

K, EVERY, PREFIX, MOST, SHARD, BLOCK = 5, 50, 64, 4096, 8192, 256
POST, ASK = 0, 1
SCHEMA = "b int, kind tinyint, doc long, data binary"


def usable(emb: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    kind = "array<float>" if dict(emb.dtypes)[vec_col] == "array<float>" else "array<double>"
    ok = f"{vec_col} is not null and forall({vec_col}, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists({vec_col}, x -> x <> 0)"
    good = emb.filter(F.expr(ok)).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return good.filter(F.size("v") == (size[0].d if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows in the precision they are stored in."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def permutations(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first."""
    near = unit(v).astype(np.float32) @ pivots.T
    m = min(prefix, near.shape[1])
    some = np.argpartition(-near, m - 1, axis=1)[:, :m]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def sizes(n: int) -> tuple[int, int, int]:
    """Pivots, shards and candidates for n vectors."""
    pivots = min(MOST, max(512, 1 << round(math.log2(4 * math.sqrt(max(1, n))))), max(1, n // 2))
    return pivots, max(1, -(-n // SHARD)), max(256, math.ceil(4 * n**0.6))


def footrule(query: np.ndarray, posted: np.ndarray, n_pivots: int) -> np.ndarray:
    """Distances of one query's order to many posted orders."""
    m = len(query)
    place = np.full(n_pivots, m, np.int32)
    place[query] = np.arange(m)
    at = place[posted]
    return np.abs(at - np.arange(posted.shape[1], dtype=np.int32)).sum(axis=1) + m * (m + 1) // 2 - np.where(at < m, m - at, 0).sum(axis=1)


def cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine in double precision, row by row, so that equal vectors get equal scores."""
    v, q = v.astype(np.float64), q.astype(np.float64)
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * math.sqrt((q * q).sum()))


def shortlist(u: np.ndarray, near: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``near`` of unit vectors, those that may be among the k of greatest cosine: single precision, with room for its rounding."""
    if len(near) <= k:
        return near
    score = (u if len(near) == len(u) else u[near]) @ unit(q[None])[0].astype(np.float32)
    room = 4 * (u.shape[1] + 4) * 2.0**-24
    return near[score >= np.partition(score, -k)[-k] - np.float32(room)]


class Files:
    """One shard: pivot -> (vectors near it, m less their place), and the vectors."""

    def __init__(self, blobs: list[bytes], n_pivots: int):
        self.ids, order, self.v = load(blobs)
        self.unit = unit(self.v).astype(np.float32)
        self.m = order.shape[1]
        pivot = order.ravel()
        at = np.argsort(pivot, kind="stable")
        self.row, place = np.divmod(at, self.m)
        self.left = self.m - place
        self.cut = np.searchsorted(pivot[at], np.arange(n_pivots + 1))

    def shared(self, query: np.ndarray) -> np.ndarray:
        """For each vector, half of what its shared pivots take from the footrule distance to the query."""
        lo, hi = self.cut[query], self.cut[query + 1]
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist())])
        gain = np.minimum(self.left[at], np.repeat(self.m - np.arange(len(query)), hi - lo))
        return np.bincount(self.row[at], gain, minlength=len(self.ids))

    def nearest(self, query: np.ndarray, q: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and cosines of the k nearest among the vectors of least footrule distance, and how many those were."""
        near = np.arange(len(self.ids))
        if len(near) > max(k, candidates):
            gain = self.shared(query)
            near = np.flatnonzero(gain >= max(1.0, np.partition(gain, -candidates)[-candidates]))
            near = near if len(near) >= k else np.argsort(-gain, kind="stable")[:candidates]
        scored = len(near)
        near = shortlist(self.unit, near, q, k)
        score = cosines(self.v[near], q)
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near[best]], score[best], scored


def pack(ids: np.ndarray, order: np.ndarray, v: np.ndarray) -> bytes:
    return np.array([len(ids), order.shape[1], v.shape[1], v.itemsize], np.int64).tobytes() + ids.astype(np.int64).tobytes() + order.astype(np.int16).tobytes() + v.tobytes()


def load(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, order, v = [], [], []
    for x in blobs:
        n, m, d, width = np.frombuffer(x, np.int64, 4).tolist()
        ids.append(np.frombuffer(x, np.int64, n, 32))
        order.append(np.frombuffer(x, np.int16, n * m, 32 + 8 * n).reshape(n, m))
        v.append(np.frombuffer(x, f"f{width}", n * d, 32 + 8 * n + 2 * n * m).reshape(n, d))
    return np.concatenate(ids), np.concatenate(order).astype(np.intp), np.concatenate(v)


def choose_pivots(good: DataFrame, n: int, n_pivots: int) -> np.ndarray:
    """Distinct vectors of the least hashes; about twice as many as wanted reach the driver."""
    near = good if n <= 2 * n_pivots else good.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int((1 << 40) * 2 * n_pivots / n))
    sample = sorted(near.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v").collect())
    v = np.array([r.v for r in sample], np.float64)
    _, first = np.unique(v, axis=0, return_index=True)
    return unit(v[np.sort(first)[:n_pivots]]).astype(np.float32)


def search(spark: SparkSession, emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY, prefix: int = PREFIX, candidates: int | None = None) -> DataFrame:
    """Per query (ids divisible by ``every``) its k nearest found: query_id, rank, vec_id, score."""
    return ranked(spark, *_found(spark, emb, id_col, vec_col, k, every, prefix, candidates), k)


def work(spark: SparkSession, emb: DataFrame, **settings: int) -> float:
    """The mean share of the posted vectors that a query scores exactly."""
    names_ = {"id_col": "vec_id", "vec_col": "embedding", "k": K, "every": EVERY, "prefix": PREFIX, "candidates": None, **settings}
    good, _, _, hits = _found(spark, emb, **names_)
    scored = hits.groupBy("asked").agg(F.sum("scored").alias("n")).agg(F.avg("n")).first()[0]
    return scored / good.count()


def _found(spark: SparkSession, emb: DataFrame, id_col: str, vec_col: str, k: int, every: int, prefix: int, candidates: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    good = checkpointed(spark, usable(emb, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")))
    few = Window.partitionBy("v").orderBy("vec_id")
    posted = good.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1).drop("r")
    queries = good.filter(F.col("vec_id") % every == 0)
    asked = queries.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v")
    n = good.count()
    n_pivots, shards, most = sizes(n)
    most = candidates or most
    if not n:
        return good, queries, asked, spark.createDataFrame([], "asked long, vec_id long, score double, scored long")
    pivots = spark.sparkContext.broadcast(choose_pivots(good, n, n_pivots))
    n_pivots, parts = len(pivots.value), min(buckets(spark), shards)

    def send(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name = names(parts)
            for whole in batches:
                for at in range(0, whole.num_rows, 4096 if kind == POST else BLOCK):
                    x = whole.slice(at, 4096 if kind == POST else BLOCK)
                    ids, v = x.column(0).to_numpy(), matrix(x.column(1))
                    order = permutations(v, pivots.value, prefix)
                    if kind == ASK:
                        data = pack(ids, order, v)
                        for f in range(shards):
                            yield rows([int(name[f % parts])], ASK, [f], [data])
                        continue
                    own = (units.mix(ids.astype(np.uint64) * units._ODD) % np.uint64(shards)).astype(np.int64)
                    for f in np.unique(own).tolist():
                        i = np.flatnonzero(own == f)
                        yield rows([int(name[f % parts])], POST, [f], [pack(ids[i], order[i], v[i])])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (b, shard, kind): a shard's postings, then the queries in blocks."""
        shard, blobs, files = None, [], None
        for _, own in groups(batches):
            for kind, f, data in own:
                if f != shard:
                    shard, blobs, files = f, [], None
                if kind == POST:
                    blobs.append(data)
                    continue
                if not blobs:
                    continue
                files = files or Files(blobs, n_pivots)
                share = -(-most * len(files.ids) // n)
                found = [(q, *files.nearest(o, x, k + 1, share)) for q, o, x in zip(*load([data]))]
                size = [len(i) for _, i, _, _ in found]
                scored = np.zeros(sum(size), np.int64)  # a query's count stands at its first row
                scored[np.cumsum([0, *size[:-1]])] = [x for _, _, _, x in found]
                yield pa.record_batch([pa.array(np.repeat([q for q, *_ in found], size)), pa.array(np.concatenate([i for _, i, _, _ in found])), pa.array(np.concatenate([s for _, _, s, _ in found])), pa.array(scored)], ["asked", "vec_id", "score", "scored"])

    sent = posted.mapInArrow(send(POST), SCHEMA).unionAll(asked.mapInArrow(send(ASK), SCHEMA))
    hits = sent.repartition(parts, "b").sortWithinPartitions("b", "doc", "kind").mapInArrow(meet, "asked long, vec_id long, score double, scored long")
    return good, queries, asked, hits


def ranked(spark: SparkSession, good: DataFrame, queries: DataFrame, asked: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Merges the shards' bests and hands each query its vector's."""
    # copies of a vector that weren't posted can't be among the k nearest; k + 1 found leave k without the query itself
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    top = hits.drop("scored").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    same = queries.join(asked.withColumnRenamed("vec_id", "asked"), "v").select(F.col("vec_id").alias("query_id"), "asked")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return same.join(top, "asked").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"))


def brute(vectors: dict[int, list[float]], k: int = K, every: int = EVERY) -> dict[int, list[tuple[int, float]]]:
    """Exact nearest; for tests and recall."""
    ids = np.array(sorted(vectors))
    v = np.array([vectors[i] for i in ids.tolist()], np.float64)
    out = {}
    for i, q in zip(ids.tolist(), v):
        if i % every == 0:
            s = cosines(v, q)
            at = [j for j in np.lexsort((ids, -s)).tolist() if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in at]
    return out
