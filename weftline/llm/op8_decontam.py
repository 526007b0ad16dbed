"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every window of ``length`` words. Two
equal windows keep the same hash, so joining the kept hashes meets every shared
span of at least ``length`` words; a hit is then extended word by word, left
and right, on the words themselves, and counts if it reaches ``length``. Items
with fewer words are one window each and are met by the hash of all their words.

The index of a benchmark of at most ``BLOCK`` bytes of text is broadcast (a
checked size) and the documents pass by once. Of a larger one the hashes are
joined by a shuffle, salted for hashes that many documents share: documents pass
once and send the kept hashes that a bitmap of fixed size has, each (document,
item) that shares a hash is one pair, and only the texts in pairs meet the words
of their items, a block of items at a time. Documents outside of all pairs don't
travel.

Defined results: null and empty texts have no words and no hits; an item
without words never occurs; equal item_ids count once; an item with a null id
marks words and counts as the id ''; rows that repeat give one result each;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.llm import bitmap, units
from weftline.llm.repeats import is_in, row_key, text_slices
from weftline.session import bounded_batches, buckets, checkpointed, table

LENGTH, GRAM, BLOCK = 10, 5, 8 << 20
SALTS = 16
SCHEMA = "doc_id long, n_words long, starts array<int>, stops array<int>, items array<string>"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def kept_grams(u: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that winnowing keeps; ties keep all."""
    h = units.gram_hashes(u, gram)
    w = length - gram + 1
    least = units.window_min(h, w)
    n = np.maximum(np.diff(ends) - length + 1, 0)
    if not len(least) or not n.sum():
        return np.zeros(0, np.int64), h[:0]
    own = np.zeros(len(least), bool)  # windows within one text
    own[np.repeat(ends[:-1], n) + units.ramp(n)] = True
    pad = np.zeros(w - 1, np.uint64)
    most = ~units.window_min(~np.concatenate([pad, np.where(own, least, 0), pad]), w)
    at = np.flatnonzero(h == most)
    return at, h[at]


class Index:
    """Items of one block: hash -> (item, place) of kept grams; short items by length and hash of all words."""

    def __init__(self, items: list[tuple[str, bytes]], length: int, gram: int):
        self.length, self.gram = length, gram
        self.ids, self.words, self.long, self.short = [], [], {}, {}
        texts = [t.translate(units.LOWER) for _, t in items]
        buf, starts, stops, first = units.word_bounds(texts, units.NON_ALNUM)
        u, raw = units.word_hashes(buf, starts, stops), buf.tobytes()
        for k, (name, _) in enumerate(items):
            a, b = int(first[k]), int(first[k + 1])
            if a == b:
                continue
            item = len(self.ids)
            self.ids.append(name)
            self.words.append([raw[i:j] for i, j in zip(starts[a:b].tolist(), stops[a:b].tolist())])
            if b - a < length:
                self.short.setdefault(b - a, {}).setdefault(int(units.gram_hashes(u[a:b], b - a)[0]), []).append(item)
            else:
                at, h = kept_grams(u[a:b], np.array([0, b - a]), length, gram)
                for p, x in zip(at.tolist(), h.tolist()):
                    self.long.setdefault(x, []).append((item, p))
        as_table = lambda d: np.sort(np.array(list(d), np.uint64))
        self.table, self.tables = as_table(self.long), {n: as_table(d) for n, d in self.short.items()}

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """For each text its number of words, which words are hit (empty: none), and the items found."""
        buf, starts, stops, first = units.word_bounds([t.translate(units.LOWER) for t in texts], units.NON_ALNUM)
        u = units.word_hashes(buf, starts, stops)
        hits: dict[int, list] = {}

        def note(at: np.ndarray, h: np.ndarray, length: int) -> None:
            doc = np.searchsorted(first, at, "right") - 1
            ok = at + abs(length) <= first[doc + 1]
            for d, p, x in zip(doc[ok].tolist(), at[ok].tolist(), h[ok].tolist()):
                hits.setdefault(d, []).append((p, x, length))

        if len(self.table):
            at, h = kept_grams(u, first, self.length, self.gram)
            if len(at):
                ok = is_in(h, self.table)
                note(at[ok], h[ok], self.gram)
        for n, known in self.tables.items():
            h = units.gram_hashes(u, n)
            if len(h):
                at = np.flatnonzero(is_in(h, known))
                note(at, h[at], -n)
        for k in range(len(texts)):
            a, b = int(first[k]), int(first[k + 1])
            yield b - a, *(self._extend(hits[k], a, b, buf, starts, stops) if k in hits else (np.zeros(0, bool), []))

    def _extend(self, hits: list, a: int, b: int, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[str]]:
        raw = buf[starts[a] : stops[b - 1]].tobytes()
        words = [raw[i:j] for i, j in zip((starts[a:b] - starts[a]).tolist(), (stops[a:b] - starts[a]).tolist())]
        hit, found, done = np.zeros(b - a, bool), set(), {}
        for p, x, length in hits:
            p -= a
            if length < 0:
                for item in self.short[-length][x]:
                    if words[p : p - length] == self.words[item]:
                        hit[p : p - length] = True
                        found.add(self.ids[item])
                continue
            for item, q in self.long[x]:
                if done.get((item, p - q), -1) >= p + length:
                    continue
                own = self.words[item]
                if words[p : p + length] != own[q : q + length]:
                    continue
                i, j = 0, length
                while i < p and i < q and words[p - i - 1] == own[q - i - 1]:
                    i += 1
                while p + j < len(words) and q + j < len(own) and words[p + j] == own[q + j]:
                    j += 1
                done[item, p - q] = p + j
                if i + j >= self.length:
                    hit[p - i : p + j] = True
                    found.add(self.ids[item])
        return hit, sorted(found)


def spans(hit: np.ndarray) -> tuple[list[int], list[int]]:
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()


def scanned(source: DataFrame, index: Broadcast, schema: StructType) -> DataFrame:
    """Every row of (doc_id, text, more) with its words and hits; more columns are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1):
            out: list[list] = [[] for _ in ARROW]
            for i, (n, hit, items) in zip(part.column(0).to_pylist(), index.value.scan(texts)):
                for k, v in enumerate((i, n, *spans(hit), items)):
                    out[k].append(v)
            yield pa.record_batch([*(pa.array(v, f.type) for v, f in zip(out, ARROW)), *part.columns[2:]], schema.names)

    return source.mapInArrow(run, schema)


def hashes(texts: DataFrame, name: str, length: int, gram: int, short: list[int], known: np.ndarray | None = None) -> DataFrame:
    """(h, n, name): kept grams of texts (name, text) with n = 0, and hashes of n words; of items all their words, of documents (known given) those in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in text_slices(batches, 1):
            buf, starts, stops, first = units.word_bounds([t.translate(units.LOWER) for t in own], units.NON_ALNUM)
            u = units.word_hashes(buf, starts, stops)
            size = np.diff(first)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), 0)]
            at, h = kept_grams(u, first, length, gram)
            owner = np.searchsorted(first, at, "right") - 1
            ok = at + gram <= first[owner + 1]
            found.append((owner[ok], h[ok], 0))
            for n in short if known is not None else range(1, length):
                h = units.gram_hashes(u, n)
                if known is None:
                    owner = np.flatnonzero(size == n)
                    at = first[owner]
                else:
                    at = np.arange(len(h))
                    owner = np.searchsorted(first, at, "right") - 1
                    owner, at = (x[at + n <= first[owner + 1]] for x in (owner, at))
                if len(at):
                    found.append((owner, h[at], n))
            owner, h, n = (np.concatenate(x) for x in zip(*((o, h, np.full(len(o), n)) for o, h, n in found)))
            if known is not None:
                ok = bitmap.has(known, (h % np.uint64(bitmap.BITS)).astype(np.int64))
                owner, h, n = owner[ok], h[ok], n[ok]
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int32()), part.column(0).take(pa.array(owner))], ["h", "n", name])

    return texts.mapInArrow(run, f"h long, n int, {name} string").distinct()


def by_shuffle(spark: SparkSession, source: DataFrame, bench: DataFrame, id_col: str, text_col: str, length: int, gram: int, block: int, schema: StructType) -> DataFrame:
    """The same result by joins, for a benchmark of any size."""
    text = F.col(text_col).cast("binary")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    items = checkpointed(spark, bench.select(F.concat_ws(":", name, F.hex(F.xxhash64(text)), F.octet_length(text)).alias("item"), text.alias("text"), name.alias("name")).filter("text is not null").dropDuplicates(["item"]))
    grams = checkpointed(spark, hashes(items.select("item", "text"), "item", length, gram, []))
    short = sorted(r.n for r in grams.filter("n > 0").select("n").distinct().collect())
    known = spark.sparkContext.broadcast(bitmap.collect(grams.select(bitmap.bit(F.col("h")).alias("bit"))))
    rows = source.withColumn("key", row_key("doc_id", "text"))
    sent = hashes(rows.select("key", "text"), "key", length, gram, short, known.value)
    every = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = checkpointed(spark, sent.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(every, ["h", "n", "salt"]).select("key", "item").distinct())
    bit = bitmap.bit(F.xxhash64("key"))
    paired = spark.sparkContext.broadcast(bitmap.collect(pairs.select(bit.alias("bit"))))

    def side(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                own = bitmap.has(paired.value, x.column(x.num_columns - 1).to_numpy())
                yield x.take(pa.array(np.flatnonzero(own == inside)))

        return run

    wide = rows.withColumn("bit", bit)
    inside, outside = (wide.mapInArrow(side(x), wide.schema).drop("bit") for x in (True, False))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, kind): a text, then its items."""
        at, words, hit, found, held, size = None, b"", np.zeros(0, bool), set(), [], 0

        def settle() -> None:
            nonlocal hit, held, size
            if held:
                _, more, names = next(Index(held, length, gram).scan([words]))
                if names:
                    hit = more if not len(hit) else hit | more
                    found.update(names)
            held, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            settle()
            if found:
                yield pa.record_batch([pa.array([at]), *(pa.array([v], t) for v, t in zip((*spans(hit), sorted(found)), (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))))], ["key", "starts", "stops", "items"])

        for x in batches:
            for key, kind, name_, t in zip(*(x.column(k).to_pylist() for k in range(4))):
                if key != at:
                    if at is not None:
                        yield from done()
                    at, hit, found = key, np.zeros(0, bool), set()
                if kind == 0:
                    words = t or b""
                else:
                    held.append((name_, t))
                    size += len(t)
                    if size >= block:
                        settle()
        if at is not None:
            yield from done()

    texts = inside.select("key", F.lit(0).alias("kind"), F.lit("").alias("name"), "text").join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    met = texts.unionByName(pairs.join(items, "item").select("key", F.lit(1).alias("kind"), "name", "text"))
    hits = met.repartition(buckets(spark), "key").sortWithinPartitions("key", "kind").mapInArrow(verify, "key string, starts array<int>, stops array<int>, items array<string>")
    none = spark.sparkContext.broadcast(Index([], length, gram))
    kept = schema.names[len(ARROW) :]
    counted = scanned(inside.select("doc_id", "text", *kept, "key"), none, StructType([*schema.fields, StructField("key", StringType())])).drop("starts", "stops", "items").join(hits, "key", "left")
    empty = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("starts", "array<int>"), ("stops", "array<int>"), ("items", "array<string>"))]
    return counted.select("doc_id", "n_words", *empty, *kept).unionByName(scanned(outside.select("doc_id", "text", *kept), none, schema))


def find(spark: SparkSession, docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, hit spans of words (starts, stops), the items found, and the columns to carry."""
    bounded_batches(spark)
    names = [f"carry_{k}" for k in range(len(carry))]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    schema = StructType([*StructType.fromDDL(SCHEMA).fields, *(f for f in source.schema.fields if f.name in names)])
    size = bench.agg(F.sum(F.octet_length(F.col(item_text).cast("binary")) + 64)).first()[0] or 0
    if size <= block:
        rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text).cast("binary").alias("t")).filter("t is not null").collect()
        found = scanned(source, spark.sparkContext.broadcast(Index([(r.i, bytes(r.t)) for r in rows], length, gram)), schema)
    else:
        found = by_shuffle(spark, source, bench, item_col, item_text, length, gram, block, schema)
    return found.select(*ARROW.names, *(F.col(n).alias(c) for n, c in zip(names, carry)))


def summary(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("stops", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute(docs: list[tuple[int, bytes]], items: list[tuple[int, bytes]], length: int = LENGTH) -> list[tuple]:
    """Every window against every text; for tests."""

    def words(t: bytes) -> list[bytes]:
        return bytes(32 if units.NON_ALNUM[c] else c for c in t.translate(units.LOWER)).split()

    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = words(t)
        n = min(length, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    sizes = sorted({len(x) for x in windows})
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[p : p + n]))) is not None:
                    hit[p : p + n] = [True] * n
                    found |= x
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return out
