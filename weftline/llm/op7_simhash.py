"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has bit i set if over half of its shingles' hashes have.
Fingerprints link at ``distance`` or fewer differing bits; a text's component
is the smallest doc_id reachable over links.

Only distinct fingerprints are compared, and all that is compared comes from
their pivot table: the Hamming distances to reference fingerprints. The
references are zero and, for each of ``distance + 2`` blocks of bits, as many
others within the block as it has bits (65 in all). A distance less the
distance to zero depends on one block alone, and the block's differences
together name its bits. Two fingerprints that link agree in two blocks at
least, hence in two blocks' coordinates: each pair of blocks' coordinates is a
key under which they meet (bands of single coordinates would not do: a
coordinate of random fingerprints differs by 3 or less in 46 of 100 pairs).
Under a key, a pair whose rows of the table differ by more than ``distance``
anywhere is discarded, and the survivors are verified bit by bit. Small groups
yield their links, large ones a spanning forest of them (found by search among
what is not yet reached). Groups beyond ``LARGE`` are dealt out again, by
references within blocks of the bits in which they differ, until none is left.
No pair is lost and none is capped.

Components are found by alternating large-star and small-star steps over the
link table, checkpointed in the shared folder. Each step deals the links out by
a node and every task replaces what it got by stars that join the same; the
leaves of a node that many links lead to stay with their own tasks, which are
told that node's parent instead.

``near_copies`` is the same for texts that differ in more than a few bits: a
link is a cosine of at least ``similarity`` between the sets of shingles. Its
fingerprints have 256 bits and a pivot table like the above: zero and, for each
of many samples of bits (they may overlap, as blocks that fill the bits can't
agree at so wide a radius), as many references within the sample as it has
bits. A sample's coordinates are a key under which fingerprints meet; there are
enough samples that ``RECALL`` of the pairs just at the threshold do. These
references tell fingerprints of one key apart no further, so every group has a
second pivot table, the distances to some of its own fingerprints: pairs whose
rows differ by more than the radius are discarded, the others verified bit by
bit. What these candidates join stands in one task, each text's set once, and
there all pairs pass a pivot table, the bits and at last the sets. So links are
all verified, and what travels grows with the texts and not with their pairs.
What is found below a recall of 1 is measured in the README.

Defined results: null and empty texts have fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; repeated rows are rows of
one component; a null doc_id never names a component unless no other id is in
it; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bitmap, units
from weftline.llm.repeats import CHECK, HOLD, KNOWN, SCHEMA, bucket_of, by_bucket, groups, pack, row_key, rows, text_slices, unpack, words_of
from weftline.session import bounded_batches, buckets, checkpointed, table

U64 = np.uint64
SHINGLE, SEED, DISTANCE = 3, 42, 3
SMALL, LARGE = 16, 8192
CHUNK = 1 << 16
#: Rows of one fingerprint beyond a share of 1 / HOT are dealt over SALTS tasks.
HOT, SALTS = 512, 64
#: Links that lead to one node before its leaves stay where they are; at most HOT nodes are such.
HUB = 256
#: Near copies: words of a fingerprint, recall at the threshold, links of one text in a group.
WIDE, RECALL, FAN = 4, 0.95, 64
#: Near copies: fingerprints that share a key on average, references of a group.
SHARE, REFERENCES = 256, 4
#: Near copies: bytes of sets that are compared in one task.
BLOCK = 64 << 20


def shingle_hashes(text: bytes, k: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = words_of(text.translate(units.LOWER))
    h = xxhash.xxh64_intdigest
    if not words:
        return []
    if len(words) <= k:
        return [h(b" ".join(words), seed)]
    if k == 3:
        return [h(b"%b %b %b" % x, seed) for x in zip(words, words[1:], words[2:])]
    return [h(b" ".join(words[i : i + k]), seed) for i in range(len(words) - k + 1)]


def fold(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints of many texts at once."""
    out = np.zeros(len(hashes), U64)
    size = np.array([len(x) for x in hashes], np.int64)
    at = np.flatnonzero(size)
    if not len(at):
        return out
    flat = np.fromiter((x for y in hashes for x in y), U64, int(size.sum()))
    ones = np.zeros((len(at), 64), np.int64)
    owner = np.repeat(np.arange(len(at)), size[at])
    for lo in range(0, len(flat), CHUNK):
        part, own = flat[lo : lo + CHUNK], owner[lo : lo + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    set_ = (2 * ones > size[at][:, None]).astype(np.uint8)
    out[at] = np.packbits(set_, axis=1, bitorder="little").view(U64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns to carry: one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 256):
                part = x.slice(lo, 256)
                fp = fold([shingle_hashes(t.as_py() or b"", k, seed) for t in part.column(1)])
                yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *carry])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *carry)
    schema = rows.select("doc_id", F.col("doc_id").alias("fp"), *carry).schema
    return rows.mapInArrow(run, schema)


class Pivots:
    """Reference fingerprints within blocks of the given bit places, and what their distances tell."""

    def __init__(self, places: np.ndarray, n_blocks: int):
        self.blocks = [x for x in np.array_split(places, n_blocks) if len(x)]
        own = []
        for x in self.blocks:
            for j in range(len(x)):  # the j-th has bit j and some before it, so the distances name the bits one after the other
                some = int(units.mix(np.array([int(x[j]) * 64 + j + 1], U64))[0])
                own.append(sum(1 << int(b) for i, b in enumerate(x[: j + 1]) if i == j or some >> i & 1))
        self.references = np.array([0, *own], U64)
        self.cuts = np.cumsum([1, *map(len, self.blocks)])

    def table(self, fp: np.ndarray) -> np.ndarray:
        """Each fingerprint's distances to the references."""
        return np.bitwise_count(fp[:, None] ^ self.references[None, :]).astype(np.int8)

    def names(self, table: np.ndarray) -> np.ndarray:
        """For each block a hash of its coordinates less the distance to zero."""
        rest = (table[:, 1:] - table[:, :1] + 64).astype(U64)
        odd = np.multiply.accumulate(np.full(rest.shape[1], units._ODD))
        return np.stack([units.mix((rest[:, i - 1 : j - 1] * odd[i - 1 : j - 1]).sum(axis=1) + U64(i)) for i, j in zip(self.cuts, self.cuts[1:])], axis=1)


def whole(distance: int) -> Pivots:
    return Pivots(np.arange(64), distance + 2)


def survive(table: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Of the pairs (i, j): discards by the greatest coordinate difference, then verifies."""
    ok = np.arange(len(i))
    for lo in range(0, table.shape[1], 13):  # some coordinates at a time: most pairs part early
        part = table[:, lo : lo + 13]
        ok = ok[np.abs(part[i[ok]] - part[j[ok]]).max(axis=1, initial=0) <= distance]
    return ok[np.bitwise_count(fp[i[ok]] ^ fp[j[ok]]) <= distance]


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints."""
    coords = whole(distance).table(fp)
    at = np.argsort(coords[:, 0], kind="stable")
    fp, coords = fp[at], coords[at]
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            lo, hi = np.searchsorted(coords[rest, 0], [coords[q, 0] - distance, coords[q, 0] + distance + 1])
            near = rest[lo:hi]
            near = near[np.abs(coords[near, 1] - coords[q, 1]) <= distance]
            near = near[survive(coords, fp, near, np.full(len(near), q), distance)]
            if len(near):
                a += [q] * len(near)
                b += near.tolist()
                queue += near.tolist()
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return fp[np.array(a, np.int64)], fp[np.array(b, np.int64)]


def group_links(fp: np.ndarray, key: np.ndarray, distance: int, large: int | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Links among fingerprints of one key, and the groups too large to do here. Rows are distinct."""
    at = np.lexsort((fp, key))
    fp, key = fp[at], key[at]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    mine = np.repeat(size <= SMALL, size) & np.repeat(size > 1, size)
    a, b, later = [], [], []
    small, k = fp[mine], key[mine]
    coords = whole(distance).table(small)
    for lag in range(1, SMALL):
        i = np.flatnonzero(k[lag:] == k[:-lag]) if lag < len(k) else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[survive(coords, small, i, i + lag, distance)]
        a.append(small[i])
        b.append(small[i + lag])
    for g in np.flatnonzero(size > SMALL):
        own = fp[begin[g] : begin[g] + size[g]]
        if large is not None and len(own) > large:
            later.append(own)
        else:
            x, y = forest(own, distance)
            a.append(x)
            b.append(y)
    none = np.zeros(0, U64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), later


def links(spark: SparkSession, distinct: DataFrame, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp long) that have the same components as all links."""
    n = buckets(spark)

    def deal(fp: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from by_bucket(bucket_of(key >> U64(24), n), CHECK, fp=fp, key=key)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = whole(distance)
        for x in batches:
            fp = x.column(0).to_numpy().view(U64)
            name = pivots.names(pivots.table(fp))
            for i, j in combinations(range(name.shape[1]), 2):
                yield from deal(fp, units.mix(name[:, i] * units._ODD + name[:, j]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in groups(batches):
            x = unpack([data for _, _, data in own], fp=U64, key=U64)
            both = np.unique(np.stack([x["key"], x["fp"]], axis=1), axis=0)
            a, b, later = group_links(both[:, 1], both[:, 0], distance, large)
            if len(a):
                yield rows([bucket], KNOWN, [0], [pack(a=a, b=b)])
            for g in later:
                free = np.array([i for i in range(64) if int(np.bitwise_or.reduce(g ^ g[0])) >> i & 1])
                pivots = Pivots(free, min(distance + 1, len(free)))
                for name in pivots.names(pivots.table(g)).T:
                    yield from deal(g, units.mix(name * units._ODD + g[0]))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            e = unpack([y.as_py() for y in x.column(3)], a=np.int64, b=np.int64)
            u, v = stars(e["a"], e["b"])
            if len(u):
                yield pa.record_batch([pa.array(u), pa.array(v)], ["a", "b"])

    found, sent = [], distinct.select("fp").mapInArrow(send, SCHEMA)
    while True:
        met = checkpointed(spark, sent.repartition(n, "b").sortWithinPartitions("b", "kind").mapInArrow(meet, SCHEMA))
        found.append(met.filter(F.col("kind") == KNOWN).mapInArrow(out, "a long, b long"))
        sent = met.filter(F.col("kind") == CHECK)
        if sent.isEmpty():
            return reduce(DataFrame.unionAll, found)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least): for every node of the links but the least of each component, that least one."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(node))
    while True:
        p, q = root[x], root[y]
        apart_ = p != q
        if not apart_.any():
            break
        x, y, p, q = x[apart_], y[apart_], p[apart_], q[apart_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(node)))
    return node[leaf], node[root[leaf]]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): for each node (long) of the edges (a, b) but the roots, the smallest node of its component."""
    n = buckets(spark)

    def joined(more: tuple[np.ndarray, np.ndarray]):
        """Stars that join what the links of a task and some more links join."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for x in batches:
                held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
                size += x.num_rows
                if size >= HOLD:
                    held = [stars(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0]) // 2  # so that what remains is gone through again only when it has doubled
            if held:
                u, v = stars(*map(np.concatenate, zip(*held, more)))
                for lo in range(0, len(u), CHUNK):
                    yield pa.record_batch([pa.array(u[lo : lo + CHUNK]), pa.array(v[lo : lo + CHUNK])], ["u", "v"])

        return run

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    none = np.zeros(0, np.int64)
    # not joined() at once: edges often come from Python, and a second worker for each task would stay with its memory
    now = checkpointed(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"))
    before = mark(now)
    while before[0]:
        hubs = [r.v for r in now.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).orderBy(F.desc("n"), "v").limit(HOT).collect()]
        is_hub = lambda c: F.col(c).isin(hubs) if hubs else F.lit(False)
        up = now.filter(is_hub("u")).groupBy("u").agg(F.min("v")).collect() if hubs else []
        more = (np.array([r[0] for r in up], np.int64), np.array([r[1] for r in up], np.int64))
        both = now.union(now.filter(~is_hub("v")).select("v", "u"))
        large = both.repartition(n, "u").mapInArrow(joined(more), "u long, v long")
        now = checkpointed(spark, large.repartition(n, "u").mapInArrow(joined((none, none)), "u long, v long"))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def labelled(spark: SparkSession, prints: DataFrame, edges: DataFrame, distinct: DataFrame) -> DataFrame:
    """The prints with component_id, the smallest doc_id (least) among the fingerprints (fp, each with its node) that their edges reach, and cluster, one of those nodes."""
    nodes = components(spark, edges)
    of = checkpointed(spark, distinct.join(nodes, "node", "left").select("fp", "least", "n", F.coalesce("root", "node").alias("cluster")))
    names = of.groupBy("cluster").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    # the names of the largest clusters are broadcast, so that these stand in no one task
    top = names.filter(F.col("size") > HUB).orderBy(F.desc("size"), "cluster").limit(HOT).collect()
    large = F.broadcast(spark.createDataFrame(top, names.schema))
    rest = of.filter(~F.col("cluster").isin([r.cluster for r in top])) if top else of
    named = of.join(large, "cluster").select("fp", "component_id", "cluster").union(rest.join(names, "cluster").select("fp", "component_id", "cluster"))
    # a fingerprint that many rows have is dealt over SALTS tasks; there are at most HOT such
    limit = max(64, (distinct.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.col("fp").isin([r.fp for r in distinct.filter(F.col("n") > limit).select("fp").collect()])
    named = named.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    return prints.withColumn("_salt", salt).join(named, ["fp", "_salt"]).drop("_salt")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id, and the columns to carry."""
    bounded_batches(spark)
    prints = checkpointed(spark, fingerprints(docs, id_col, text_col, k, seed, carry))
    distinct = checkpointed(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    named = labelled(spark, prints, links(spark, distinct, distance), distinct.withColumn("node", F.col("fp")))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carry)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of the texts, sorted text by text, and where each text's begin."""
    u, first = units.word_units([t.translate(units.LOWER) for t in texts])
    size = np.diff(first)
    n = np.maximum(size - k + 1, 0)
    owner, h = [np.repeat(np.arange(len(texts)), n)], [units.gram_hashes(u, k)[np.repeat(first[:-1], n) + units.ramp(n)] if n.any() else np.zeros(0, U64)]
    for m in range(1, k):
        short = np.flatnonzero(size == m)
        if len(short):
            owner.append(short)
            h.append(units.gram_hashes(u, m)[first[short]])
    owner, h = np.concatenate(owner), np.concatenate(h)
    at = np.lexsort((h, owner))
    owner, h = owner[at], h[at]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def wide_prints(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of WIDE words each from sets of hashes."""
    out = np.zeros((len(ends) - 1, WIDE), U64)
    size = np.diff(ends)
    at = np.flatnonzero(size)
    ones = np.zeros((len(at), 64 * WIDE), np.int64)
    owner = np.repeat(np.arange(len(at)), size[at])
    for lo in range(0, len(h), CHUNK // WIDE):
        part, own = h[lo : lo + CHUNK // WIDE], owner[lo : lo + CHUNK // WIDE]
        many = np.stack([units.mix(part * U64(2 * w + 3) + U64(w)) for w in range(WIDE)], axis=1)
        bits = np.unpackbits(many.view(np.uint8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    out[at] = np.packbits((2 * ones > size[at][:, None]).astype(np.uint8), axis=1, bitorder="little").view(U64)
    return out


def samples(n: int, similarity: float) -> np.ndarray:
    """Which bits each table of candidates looks at, for n fingerprints: about SHARE share a key, RECALL of the pairs at the similarity meet."""
    agree = 1 - math.acos(similarity) / math.pi
    r = max(8, round(math.log2(max(1, n) / SHARE)))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree**r))
    order = np.random.default_rng(SEED)
    return np.array([order.choice(64 * WIDE, r, replace=False) for _ in range(tables)])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which wide fingerprints differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


class WidePivots:
    """Reference fingerprints of WIDE words within samples of bits, and what their distances tell."""

    def __init__(self, chosen: np.ndarray):
        self.shape = chosen.shape
        bits = np.zeros((1 + chosen.size, 64 * WIDE), np.uint8)
        some = np.random.default_rng(SEED).integers(0, 2, (*chosen.shape, chosen.shape[1]), dtype=np.uint8)
        for t, places in enumerate(chosen):
            for j, own in enumerate(places):  # the j-th has bit j and some before it, so the distances name the bits one after the other
                bits[1 + t * len(places) + j, places[:j]] = some[t, j, :j]
                bits[1 + t * len(places) + j, own] = 1
        self.references = np.packbits(bits, axis=1, bitorder="little").view(U64)

    def table(self, fp: np.ndarray) -> np.ndarray:
        """Each fingerprint's distances to the references."""
        out = np.zeros((len(fp), len(self.references)), np.int16)
        for w in range(WIDE):
            out += np.bitwise_count(fp[:, w, None] ^ self.references[None, :, w])
        return out

    def names(self, table: np.ndarray) -> np.ndarray:
        """For each sample a hash of its coordinates less the distance to zero."""
        tables, r = self.shape
        rest = (table[:, 1:] - table[:, :1] + 64 * WIDE).astype(U64).reshape(len(table), tables, r)
        odd = np.multiply.accumulate(np.full(r, units._ODD))
        return units.mix((rest * odd).sum(axis=2) + np.arange(1, tables + 1, dtype=U64))


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Each wide fingerprint's distances to some of them, every reference as far as can be from those before it."""
    out, far, at = [], None, 0
    for _ in range(REFERENCES):
        out.append(apart(fp, fp[at]))
        far = out[-1] if far is None else np.minimum(far, out[-1])
        at = int(far.argmax())
    return np.stack(out, axis=1)


def meeting(fp: np.ndarray, table: np.ndarray, radius: int, rows: int = 64) -> np.ndarray:
    """The indices of fingerprints that have another within the radius."""
    found = np.zeros(len(fp), bool)
    for lo in range(0, len(fp), rows):
        hi, own = min(len(fp), lo + rows), fp[lo:]
        near = np.ones((hi - lo, len(own)), bool)
        for c in range(table.shape[1]):
            near &= np.abs(table[lo:hi, c, None] - table[None, lo:, c]) <= radius
        if 4 * np.count_nonzero(near) < near.size:
            i, j = np.nonzero(near)
            near[i, j] = apart(own[i], own[j]) <= radius
        else:
            near &= sum(np.bitwise_count(own[: hi - lo, None, w] ^ own[None, :, w]).astype(np.int16) for w in range(fp.shape[1])) <= radius
        near[np.arange(hi - lo), np.arange(hi - lo)] = False
        found[lo:hi] |= near.any(axis=1)
        found[lo:] |= near.any(axis=0)
    return np.flatnonzero(found)


def pairs_of_few(fp: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (indices) within the radius among rows of one key, at most SMALL a key and these side by side: those that pass their group's pivot table are verified bit by bit."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    first, last = np.repeat(begin, size), np.repeat(begin + size - 1, size)
    table = np.stack([apart(fp, fp[np.minimum(first + c, last)]) for c in range(REFERENCES)], axis=1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, SMALL):
        i = np.flatnonzero(key[lag:] == key[:-lag]) if lag < len(key) else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[np.abs(table[i] - table[i + lag]).max(axis=1) <= radius]
        i = i[apart(fp[i], fp[i + lag]) <= radius]
        a.append(i)
        b.append(i + lag)
    return np.concatenate(a), np.concatenate(b)


def tree(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Pairs (indices) that join all that is reachable within the radius, and nothing else; none has more than FAN + 1 partners below it."""
    table, a, b = pivot_table(fp), [], []
    rest = meeting(fp, table, radius)
    while len(rest):
        queue, rest, reached = [rest[0]], rest[1:], []
        while queue and len(rest):
            q = queue.pop()
            near = np.abs(table[rest] - table[q]).max(axis=1) <= radius
            near[near] = apart(fp[rest[near]], fp[q]) <= radius
            if near.any():
                if not reached:
                    reached.append(int(q))
                reached += rest[near].tolist()
                queue += rest[near].tolist()
                rest = rest[~near]
        a += [reached[(k - 1) // FAN] for k in range(1, len(reached))]
        b += reached[1:]
    return a, b


def allowed(similarity: float) -> int:
    """The most bits in which texts of that similarity differ, but for chance."""
    agree = math.acos(similarity) / math.pi
    return math.floor(64 * WIDE * agree + 3 * math.sqrt(64 * WIDE * agree * (1 - agree)))


def candidates(spark: SparkSession, distinct: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that join all wide fingerprints (fp binary, node long; else numbered here) that may be that similar."""
    n, parts = distinct.count(), buckets(spark)
    chosen = samples(n, similarity)
    radius = allowed(similarity)
    words = [f"f{w}" for w in range(WIDE)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = WidePivots(chosen)
        for whole_ in batches:
            for lo in range(0, whole_.num_rows, 4096):
                x = whole_.slice(lo, 4096)
                fp = np.frombuffer(b"".join(x.column(0).to_pylist()), U64).reshape(-1, WIDE)
                key = np.concatenate([pivots.names(pivots.table(fp[i : i + 256])) for i in range(0, len(fp), 256)]).T.ravel()
                every, node = np.tile(fp, (len(chosen), 1)), np.tile(x.column(1).to_numpy(), len(chosen))
                yield from by_bucket(bucket_of(key >> U64(24), parts), CHECK, key=key, node=node, **{w: every[:, k] for k, w in enumerate(words)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groups(batches):
            x = unpack([data for _, _, data in own], key=U64, node=np.int64, **dict.fromkeys(words, U64))
            at = np.lexsort((x["f0"], x["key"]))
            key, node, fp = x["key"][at], x["node"][at], np.stack([x[w][at] for w in words], axis=1)
            del x
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(key)))
            few = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
            i, j = pairs_of_few(fp[few], key[few], radius)
            a, b = [node[few[i]]], [node[few[j]]]
            for g in np.flatnonzero(size > SMALL):
                group = slice(begin[g], begin[g] + size[g])
                i, j = tree(fp[group], radius)
                a.append(node[group][i])
                b.append(node[group][j])
            u, v = stars(np.concatenate(a), np.concatenate(b))
            if len(u):
                yield pa.record_batch([pa.array(u), pa.array(v)], ["a", "b"])

    named = distinct if "node" in distinct.columns else distinct.withColumn("node", F.monotonically_increasing_id())
    sent = named.select("fp", "node").mapInArrow(send, SCHEMA)
    return sent.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(meet, "a long, b long")


def linked(sets: list[np.ndarray], similarity: float, rows: int = 1024, columns: int = 1024, may: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) of a spanning forest over all pairs of sets (that may be links, if it is said which) whose cosine is that high: common members of all pairs by products of 0/1 matrices, in blocks."""
    m, size = len(sets), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[col] > 1  # what one set has alone is common to no pair
    owner, col = owner[shared], np.unique(col[shared], return_inverse=True)[1]
    at = np.argsort(col, kind="stable")
    owner, col = owner[at], col[at]
    near = np.zeros((m, m), bool)
    for lo in range(0, m, rows):
        hi = min(m, lo + rows)
        common = np.zeros((hi - lo, m - lo), np.float32)
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
            i, j = np.searchsorted(col, [c, c + columns])
            mine = owner[i:j] >= lo
            x = np.zeros((m - lo, columns), np.float32)
            x[owner[i:j][mine] - lo, col[i:j][mine] - c] = 1
            common += x[: hi - lo] @ x.T
        near[lo:hi, lo:] = (common > 0) & (common >= similarity * np.sqrt(size[lo:hi, None] * size[None, lo:]))
        near[lo:, lo:hi] |= near[lo:hi, lo:].T
    if may is not None:
        near &= may
    rest, a, b = np.arange(m), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            ok = near[q, rest]
            found, rest = rest[ok], rest[~ok]
            hub = np.full(len(found), q)
            for lo in range(FAN, len(found), FAN):  # so that no text has most links of a component, if others serve as well
                other = found[lo // FAN - 1]
                hub[lo : lo + FAN][near[found[lo : lo + FAN], other]] = other
            a.append(hub)
            b.append(found)
            queue += found.tolist()
    return np.concatenate(a), np.concatenate(b)


def spanning(fp: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many sets: of all pairs those that pass the pivot table and the bits are compared, with one set at a time against all that are not reached yet."""
    size, radius, table = np.array([len(x) for x in sets], np.int64), allowed(similarity), pivot_table(fp)
    ends = np.append(0, np.cumsum(size))
    col = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(col), bool)
    rest, a, b = np.arange(len(sets)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            near = np.abs(table[rest] - table[q]).max(axis=1) <= radius
            near[near] = apart(fp[rest[near]], fp[q]) <= radius
            at = np.flatnonzero(near)
            if not len(at):
                continue
            mark[col[ends[q] : ends[q + 1]]] = True
            common = []
            for lo in range(0, len(at), 1024):
                x = rest[at[lo : lo + 1024]]
                hit = mark[col[np.repeat(ends[x], size[x]) + units.ramp(size[x])]]
                common.append(np.bincount(np.repeat(np.arange(len(x)), size[x]), hit, len(x)))
            mark[col[ends[q] : ends[q + 1]]] = False
            common = np.concatenate(common)
            ok = (common > 0) & (common >= similarity * np.sqrt(size[q] * size[rest[at]]))
            found, rest = rest[at[ok]], np.delete(rest, at[ok])
            a.append(np.full(len(found), q))
            b.append(found)
            queue += found.tolist()
    return np.concatenate(a), np.concatenate(b)


def within(members: DataFrame, sets, similarity: float) -> DataFrame:
    """Links (a, b), a spanning forest of them, among the members (whole, node, fp, row_key, n_shingles) of what candidates join: all pairs of a whole are compared in its task, by sets that are sent there once.

    A whole of more than LARGE texts or BLOCK bytes is looked at in pairs of blocks.
    """
    size = members.groupBy("whole").agg(F.greatest(F.count("*") / LARGE, 4 * F.sum("n_shingles") / BLOCK).alias("parts"))
    beyond = F.broadcast(size.filter("parts > 1").select("whole", F.ceil(2 * F.col("parts")).cast("int").alias("blocks")))  # at most one in LARGE of the texts
    parts = members.join(beyond, "whole", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    x = parts.join(sets(members.select("row_key")), "row_key")
    x = x.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("whole", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "fp", "own")

    radius = allowed(similarity)

    def found(held: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        node, own = np.array([x for x, _, _ in held], np.int64), [np.frombuffer(o, np.uint32) for _, _, o in held]
        if len(held) < 2:
            return node[:0], node[:0]
        fp = np.frombuffer(b"".join(f for _, f, _ in held), U64).reshape(-1, WIDE)
        if len(held) <= FAN:
            table = pivot_table(fp)
            may = np.abs(table[:, None] - table[None]).max(axis=2) <= radius
            i, j = np.nonzero(may)
            may[i, j] = apart(fp[i], fp[j]) <= radius
            a, b = linked(own, similarity, may=may)
        else:
            a, b = spanning(fp, own, similarity)
        return stars(node[a], node[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for y in batches:
            out = []
            for whole_, lo, hi, node, fp, own in zip(*(c.to_pylist() for c in y.columns)):
                if (whole_, lo, hi) != at:
                    out.append(found(held))
                    at, held = (whole_, lo, hi), []
                held.append((node, fp, own))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(v)) for v in zip(*out)], ["a", "b"])
        yield pa.record_batch([pa.array(v) for v in found(held)], ["a", "b"])

    spark = members.sparkSession
    return checkpointed(spark, x.repartition(buckets(spark), "whole", "lo", "hi").sortWithinPartitions("whole", "lo", "hi").mapInArrow(run, "a long, b long"))


def near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row: doc_id, row_key, component_id, cluster. Equal rows have one row_key, made of id and text; a cluster names its component even if no id does.

    Texts whose fingerprints share a sample's coordinates in the pivot table and
    differ in few bits are candidates. All pairs of what these join are compared within one
    task, so that no link depends on which of the candidates were followed.
    """
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("binary").alias("text"))

    def sets(keep: np.ndarray | None):
        """Fingerprints of all rows, or the sets of those whose key's bit is kept."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if keep is not None:
                    x = x.take(pa.array(np.flatnonzero(bitmap.has(keep, x.column(3).to_numpy()))))
                for part, texts in text_slices(iter([x]), 2):
                    h, ends = shingle_sets(texts, k)
                    if keep is None:
                        fp = [r.tobytes() for r in wide_prints(h, ends)]
                        yield pa.record_batch([part.column(0), part.column(1), pa.array(fp, pa.binary()), pa.array(np.diff(ends), pa.int64())], ["doc_id", "row_key", "fp", "n_shingles"])
                    else:
                        small = (h >> U64(31)).astype(np.uint32)
                        own = [np.unique(small[i:j]).tobytes() for i, j in zip(ends, ends[1:])]
                        yield pa.record_batch([part.column(1), pa.array(own, pa.binary())], ["row_key", "own"])

        return run

    prints = checkpointed(spark, source.mapInArrow(sets(None), "doc_id long, row_key string, fp binary, n_shingles long"))
    distinct = checkpointed(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    bit = bitmap.bit(F.xxhash64("row_key"))

    def sets_of(ends: DataFrame) -> DataFrame:
        """(row_key, own) of the row keys given; only their texts are taken apart again."""
        keep = bitmap.collect(ends.select(bit.alias("bit")))
        return source.withColumn("bit", bit).mapInArrow(sets(keep), "row_key string, own binary").join(ends.distinct(), "row_key", "left_semi").dropDuplicates(["row_key"])

    nodes = components(spark, candidates(spark, distinct, similarity))
    wholes = nodes.union(nodes.select("root", "root").distinct()).toDF("node", "whole")
    members = checkpointed(spark, distinct.select("node", "fp", "row_key", "n_shingles").join(wholes, "node").select("whole", "node", "fp", "row_key", "n_shingles"))
    edges = within(members, sets_of, similarity)
    return labelled(spark, prints.select("doc_id", "row_key", "fp"), edges, distinct).select("doc_id", "row_key", "component_id", "cluster")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def brute(texts: list[tuple[int, bytes]], distance: int = DISTANCE) -> list[tuple]:
    """All pairs of all texts; for tests."""
    fp = []
    for _, t in texts:
        h = shingle_hashes(t)
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= distance:
            root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(texts):
        least[top(i)] = min(d, least.get(top(i), d))
    return [(d, f"{fp[i]:016x}", least[top(i)]) for i, (d, _) in enumerate(texts)]


def brute_copies(texts: list[tuple[int, bytes]], k: int = 5, similarity: float = 0.8) -> dict[int, int]:
    """Component of every text by the exact cosine of shingle sets, all pairs; for tests and recall."""
    own = []
    for _, t in texts:
        w = words_of(t.translate(units.LOWER))
        own.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if own[i] == own[j] or 0 < len(own[i] & own[j]) >= similarity * math.sqrt(len(own[i]) * len(own[j])):
            a, b = sorted((top(i), top(j)), key=lambda x: texts[x][0])
            root[b] = a
    return {d: texts[top(i)][0] for i, (d, _) in enumerate(texts)}
