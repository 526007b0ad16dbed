"""Finding what repeats across texts: windows travel by their minimiser.

Common to suffix-array dedup (units are bytes) and substring dedup (units are
words). A window is ``length`` consecutive units of one text; its minimiser is
the least hash of its ``length - w + 1`` grams. Consecutive windows with one
minimiser form a run (a super-k-mer). Equal windows have equal minimisers, so

1. ``heavy``: grams so frequent that they would draw a large share of all runs
   into one bucket are ranked last. At most ``HEAVY`` of them are broadcast
   (512 KB, whatever the input); which grams are ranked last never changes the
   result, only where windows meet.
2. ``sift``: every run's minimiser goes to its bucket as 20 bytes; runs whose
   minimiser occurs nowhere else can't hold a repeated window. Within one map
   task a minimiser is sent once, so a hot one costs a row for each task.
3. ``travel``: the runs left go as one packed string to the bucket of their
   minimiser; equal strings of one map task go once, their earliest occurrence
   standing for them.
4. the caller's ``judge`` decides inside a bucket which windows also start
   earlier; the answers go back to their texts.

Packed rows are (b int, kind tinyint, doc long, data binary): b is the bucket.
Identity of a text is (doc_id, subtag of 64 bits), so rows that repeat whole
count as one text and rows that merely share an id as several; a null id sorts
first. Memory does not grow with the input: a bucket answers for about BUCKET
bytes of text whatever the number of partitions (several take turns in one),
and what one minimiser gathers beyond that is cut anew and judged in parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import units
from weftline.session import bounded_batches, buckets, checkpointed

SCHEMA = "b int, kind tinyint, doc long, data binary"
ARROW = pa.schema([("b", pa.int32()), ("kind", pa.int8()), ("doc", pa.int64()), ("data", pa.binary())])
HEAVY = 65536
NULL_ID = -(1 << 63)
#: Bytes of text that are worked on at once, and runs that a map task holds before it sends them.
BATCH, HOLD = 1 << 19, 1 << 20
#: Bytes of text behind a bucket, and of strings that are judged at once (one minimiser's: eight times that before they are cut anew, DEEPEST times at most).
BUCKET, PART, DEEPEST = 64 << 20, 1 << 19, 4
LONGEST_RUN = 4096
CHECK, KNOWN, TEXT = 0, 1, 2
U64 = np.uint64


class Rule:
    """How texts split into units and what a window is."""

    def __init__(self, words: bool, length: int, gram: int):
        if not 1 <= gram <= length:
            raise ValueError("gram must be between 1 and length")
        self.words, self.length, self.gram = words, length, gram

    def runs(self, texts: list[bytes], heavy: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
        """Runs of windows with one minimiser: text (index), start (first window, in units), n (windows), value; by another order of grams for another seed."""
        u, ends = (units.word_units if self.words else units.byte_units)(texts)
        grams = units.gram_hashes(u, self.gram)
        if seed:
            grams = units.mix(grams ^ U64(seed * int(units._ODD) % (1 << 64))) >> U64(1)
        if len(heavy) and len(grams):
            grams = grams | (is_in(grams, heavy).astype(U64) << U64(63))
        least = units.window_min(grams, self.length - self.gram + 1)
        n = np.maximum(np.diff(ends) - self.length + 1, 0)
        if not n.sum():
            z = np.zeros(0, np.int64)
            return {"text": z, "start": z, "n": z, "value": np.zeros(0, U64), "twin": np.zeros(0, bool), "ends": ends}
        text, start = np.repeat(np.arange(len(texts)), n), units.ramp(n)
        at = ends[text] + start
        value = least[at]
        new = np.empty(len(value), bool)
        new[0] = True
        np.logical_or(value[1:] != value[:-1], text[1:] != text[:-1], out=new[1:])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(value)))
        twin = np.zeros(len(begin), bool)
        twin[np.searchsorted(begin, self._twins(grams, least, at, value), "right") - 1] = True
        if size.max() > LONGEST_RUN:
            parts = -(-size // LONGEST_RUN)
            k = units.ramp(parts)
            begin = np.repeat(begin, parts) + k * LONGEST_RUN
            size = np.minimum(LONGEST_RUN, np.repeat(size, parts) - k * LONGEST_RUN)
            twin = np.repeat(twin, parts)
        return {"text": text[begin], "start": start[begin], "n": size, "value": value[begin], "twin": twin, "ends": ends}

    def _twins(self, grams: np.ndarray, least: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Windows (indices into ``at``) whose run holds its minimiser twice, and so may repeat a window within itself.

        A gram is some window's minimum where it equals the greatest of the
        minima of the windows around it. Between two equal minima of one run
        stands no smaller one, so they are neighbours in the list of minima.
        """
        w = self.length - self.gram + 1
        most = ~units.window_min(~np.concatenate([np.zeros(w - 1, U64), least, np.zeros(w - 1, U64)]), w)
        chosen = np.flatnonzero(grams == most)
        x = grams[chosen]
        pair = np.flatnonzero((x[1:] == x[:-1]) & (np.diff(chosen) <= w))
        k = np.searchsorted(at, chosen[pair], "right") - 1
        ok = (k >= 0) & (value[np.maximum(k, 0)] == x[pair])
        return k[ok]

    def cut(self, texts: list[bytes], ends: np.ndarray, text: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes that each run covers; of words, joined by one blank."""
        stop = start + n + self.length - 1
        if not self.words:
            return [texts[t][a:b] for t, a, b in zip(text.tolist(), start.tolist(), stop.tolist())]
        out, at, split = [], -1, []
        for t, a, b in zip(text.tolist(), start.tolist(), stop.tolist()):
            if t != at:
                at, split = t, words_of(texts[t])
            out.append(b" ".join(split[a:b]))
        return out


_TO_BLANK = bytes(32 if units.SPACE[c] else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return [x for x in text.translate(_TO_BLANK).split(b" ") if x]


def is_in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted table of 63-bit hashes, through a bitmap of their high bits."""
    bits = np.zeros(1 << 20, bool)
    bits[(table >> U64(43)).astype(np.int64)] = True
    out = bits[(h >> U64(43)).astype(np.int64)]
    at = np.flatnonzero(out)
    x = h[at]
    found = np.searchsorted(table, x)
    found[found == len(table)] = 0
    out[at] = table[found] == x
    return out


def order(key: np.ndarray, bits: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Keys of up to ``bits`` bits sorted, and the stable order; one sort of packed integers."""
    n = len(key)
    if n >= 1 << (64 - bits):
        at = np.argsort(key, kind="stable")
        return key[at], at
    packed = np.sort((key << U64(64 - bits)) | np.arange(n, dtype=U64))
    return packed >> U64(64 - bits), (packed & U64((1 << (64 - bits)) - 1)).astype(np.int64)


def place(value: np.ndarray) -> np.ndarray:
    """40 well-mixed bits of a minimiser (minima are small numbers); its bucket is the high part."""
    return units.mix(value) >> U64(24)


@cache
def names(n: int, each: int = 1) -> np.ndarray:
    """For each of n partitions ``each`` integers that Spark's hash partitioning puts there, so that buckets are dealt out evenly."""

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return x << np.uint32(r) | x >> np.uint32(32 - r)

    own: list[list[int]] = [[] for _ in range(n)]
    lo, found = 0, 0
    while found < n * each:
        x = np.arange(lo, lo + 64 * n, dtype=np.uint32)
        k = turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)  # Murmur3 of an int, seed 42
        h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(odd)
        for p, y in zip((h.view(np.int32).astype(np.int64) % n).tolist(), x.tolist()):
            if len(own[p]) < each:
                own[p].append(y)
                found += 1
        lo += 64 * n
    return np.array(own, np.int64).ravel()


class Deal:
    """How buckets are dealt: ``parts`` partitions of ``each`` buckets, one of which is in memory at a time."""

    def __init__(self, parts: int, each: int = 1):
        self.parts, self.each = parts, each

    @staticmethod
    def of(spark: SparkSession, size: int) -> Deal:
        """For so many bytes of text: a bucket answers for about BUCKET of them, however few partitions there are."""
        n = buckets(spark)
        return Deal(n, max(1, -(-size // (n * BUCKET))))

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """The name of the bucket of a 40-bit key."""
        return names(self.parts, self.each)[((key * U64(self.parts * self.each)) >> U64(40)).astype(np.int64)]

    def home(self, doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The bucket to which a text and all answers about it go; texts without an id are dealt by their tags."""
        return self.bucket(units.mix(doc.astype(U64) * units._ODD ^ np.where(doc == NULL_ID, tag, U64(0))) >> U64(24))


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return Deal(n).bucket(key)


def pack(**arrays: np.ndarray) -> bytes:
    """Columns of one length, as bytes; see unpack()."""
    n = len(next(iter(arrays.values())))
    return np.uint32(n).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def unpack(blobs: list[bytes], **kinds: Any) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {k: [] for k in kinds}
    for x in blobs:
        n, at = int(np.frombuffer(x, np.uint32, 1)[0]), 4
        for k, t in kinds.items():
            parts[k].append(np.frombuffer(x, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in parts.items()}


def rows(b: list, kind: int, doc: list, data: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(b, pa.int32()), pa.array([kind] * len(b), pa.int8()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())], schema=ARROW)


def by_bucket(b: np.ndarray, kind: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket present."""
    if not len(b):
        return
    _, at = order(b.astype(U64), 32)
    b = b[at]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    columns = {k: v[at] for k, v in columns.items()}
    stops = np.append(cuts[1:], len(b))
    yield rows(b[cuts].tolist(), kind, [0] * len(cuts), [pack(**{k: v[i:j] for k, v in columns.items()}) for i, j in zip(cuts, stops)])


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Batches of (ids, texts) of about BATCH bytes; null texts are empty."""
    ids, texts, size = [], [], 0
    for x in batches:
        for i, t in zip(x.column(0).to_pylist(), x.column(1)):
            t = t.as_py() or b""
            ids.append(NULL_ID if i is None else i)
            texts.append(t)
            size += len(t)
            if size >= BATCH:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about BATCH bytes of text, with their texts (null: empty)."""
    for x in batches:
        lo, size, held = 0, 0, []
        for hi, t in enumerate(x.column(column), 1):
            held.append(t.as_py() or b"")
            size += len(held[-1])
            if size >= BATCH or hi == x.num_rows:
                yield x.slice(lo, hi - lo), held
                lo, size, held = hi, 0, []


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """From rows sorted by (b, kind): each b with its rows (kind, doc, data), streamed."""

    def flat() -> Iterator[tuple[int, int, int, bytes]]:
        for x in batches:
            yield from zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), (y.as_py() for y in x.column(3)))

    stream = flat()
    held = next(stream, None)

    def of(b: int) -> Iterator[tuple[int, int, bytes]]:
        nonlocal held
        while held is not None and held[0] == b:
            out, held = held[1:], None
            yield out
            held = next(stream, None)

    while held is not None:
        b = held[0]
        own = of(b)
        yield b, own
        for _ in own:  # what the caller left
            pass


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows apart by their id and, within one, by their text."""
    text = F.col(text_col).cast("binary")
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.octet_length(text).cast("string"))


def _source(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    extra = F.to_json(F.struct(*carry)).cast("binary") if carry else F.lit(b"")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("data"), extra.alias("extra"))


def heavy_grams(docs: DataFrame, rule: Rule) -> np.ndarray:
    """The most frequent grams, at most HEAVY of them, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h = np.sort(np.concatenate(held))
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(begin, len(h)))
            keep = n >= 16
            yield pa.record_batch([pa.array(h[begin[keep]].astype(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

        for _, texts in text_batches(batches):
            u, _ = (units.word_units if rule.words else units.byte_units)(texts)
            held.append(units.gram_hashes(u, rule.gram))
            size += len(held[-1])
            if size >= HOLD * 2:
                yield from out()
                held, size = [], 0
        yield from out()

    found = most_frequent(docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 64"), HEAVY)
    return np.sort(np.array([r.h for r in found.select("h").collect()], np.int64)).astype(U64)


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows with the largest n: as many whole classes of counts (eighths of powers of two) as hold at most ``most`` rows.

    Only the classes' sizes and then the chosen rows reach the driver; a
    sorted limit would send it ``most`` rows from every task.
    """
    held = checkpointed(counted.sparkSession, counted.withColumn("_class", F.floor(F.log2("n") * 8).cast("int")))
    total, low = 0, None
    for c, k in sorted(((r["_class"], r["count"]) for r in held.groupBy("_class").count().collect()), reverse=True):
        total += k
        if total > most:
            break
        low = c
    return (held.filter(F.col("_class") >= low) if low is not None else held.filter(F.lit(False))).drop("_class")


def sift(source: DataFrame, rule: Rule, heavy: np.ndarray, deal: Deal) -> DataFrame:
    """Of each text, the starts of runs whose minimiser occurs more than once; packed rows by home bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            value, doc, tag, start, twin = (np.concatenate([x[k] for x in held]) for k in range(5))
            key, at = order(place(value))
            doc, tag, start, twin = doc[at], tag[at], start[at], twin[at]
            first = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(first)
            many = np.diff(np.append(begin, len(key))) > 1
            yield from by_bucket(deal.bucket(key[begin]), CHECK, key=(key[begin] & U64(0xFFFFFFFF)).astype(np.uint32), doc=doc[begin], tag=tag[begin], start=start[begin], many=many)
            known = np.repeat(many, np.diff(np.append(begin, len(key)))) | twin
            yield from by_bucket(deal.home(doc[known], tag[known]), KNOWN, doc=doc[known], tag=tag[known], start=start[known])

        for ids, texts in text_batches(batches):
            r = rule.runs(texts, heavy)
            if len(r["text"]):
                tags = np.array([units.subtag(t) for t in texts], U64)
                held.append((r["value"], np.array(ids, np.int64)[r["text"]], tags[r["text"]], r["start"].astype(np.int32), r["twin"]))
                size += len(r["text"])
            if size >= HOLD:
                yield from out()
                held, size = [], 0
        yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own in groups(batches):
            blobs = []
            for kind, _, data in own:
                if kind == KNOWN:
                    yield rows([b], KNOWN, [0], [data])
                else:
                    blobs.append(data)
            if not blobs:
                continue
            x = unpack(blobs, key=np.uint32, doc=np.int64, tag=U64, start=np.int32, many=bool)
            key, at = order(x["key"].astype(U64), 32)
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            ask = at[np.repeat(size > 1, size)]
            ask = ask[~x["many"][ask]]
            doc = x["doc"][ask]
            yield from by_bucket(deal.home(doc, x["tag"][ask]), KNOWN, doc=doc, tag=x["tag"][ask], start=x["start"][ask])

    sent = source.mapInArrow(send, SCHEMA)
    return sent.repartition(deal.parts, "b").sortWithinPartitions("b", "kind").mapInArrow(meet, SCHEMA)


def texts_home(source: DataFrame, deal: Deal) -> DataFrame:
    """Every text, compressed, at its home bucket; a null id is kept as kind TEXT + 1."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for x in batches:
            for lo in range(0, x.num_rows, 512):
                part = x.slice(lo, 512)
                ids = part.column(0).to_pylist()
                kinds = [TEXT + (i is None) for i in ids]
                ids = [NULL_ID if i is None else i for i in ids]
                extra = (e.as_py() for e in part.column(2))
                data = [squeeze.compress(len(e).to_bytes(4, "little") + e + (t.as_py() or b"")) for t, e in zip(part.column(1), extra)]
                tags = np.array([units.subtag(t.as_py() or b"") if i == NULL_ID else 0 for i, t in zip(ids, part.column(1))], U64)
                b = deal.home(np.array(ids, np.int64), tags)
                yield pa.record_batch([pa.array(b, pa.int32()), pa.array(kinds, pa.int8()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], schema=ARROW)

    return source.mapInArrow(send, SCHEMA)


def at_home(texts: DataFrame, answers: DataFrame, deal: Deal, work: Callable, schema: str) -> DataFrame:
    """Runs ``work(answers, texts)`` for each home bucket: the answers' packed rows and a stream of (ids, texts, nulls, extras)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groups(batches):
            blobs: list[bytes] = []

            def stream(own=own, blobs=blobs) -> Iterator[tuple[list[int], list[bytes], list[bool], list[bytes]]]:
                unzip = zstandard.ZstdDecompressor()
                ids, texts, nulls, extras, size = [], [], [], [], 0
                for kind, doc, data in own:
                    if kind < TEXT:
                        blobs.append(data)
                        continue
                    ids.append(doc)
                    data = unzip.decompress(data)
                    at = 4 + int.from_bytes(data[:4], "little")
                    extras.append(data[4:at])
                    texts.append(data[at:])
                    nulls.append(kind > TEXT)
                    size += len(data)
                    if size >= BATCH:
                        yield ids, texts, nulls, extras
                        ids, texts, nulls, extras, size = [], [], [], [], 0
                if ids:
                    yield ids, texts, nulls, extras

            yield from work(blobs, stream())

    return texts.unionAll(answers).repartition(deal.parts, "b").sortWithinPartitions("b", "kind").mapInArrow(meet, schema)


RUN = {"value": np.uint64, "doc": np.int64, "tag": np.uint64, "start": np.int32, "n": np.int32, "twin": bool, "size": np.int32}


def pack_runs(value: Any, doc: Any, tag: Any, start: Any, n: Any, twin: Any, strings: list[bytes]) -> bytes:
    head = pack(value=value, doc=doc, tag=tag, start=start, n=n, twin=twin, size=np.array([len(s) for s in strings], np.int32))
    return np.uint32(len(head)).tobytes() + head + zstandard.ZstdCompressor(level=1).compress(b"".join(strings))


def unpack_runs(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    unzip, heads, strings = zstandard.ZstdDecompressor(), [], []
    for x in blobs:
        n = int(np.frombuffer(x, np.uint32, 1)[0])
        heads.append(x[4 : 4 + n])
        body, at = unzip.decompress(x[4 + n :]), 0
        for s in unpack(heads[-1:], **RUN)["size"].tolist():
            strings.append(body[at : at + s])
            at += s
    return unpack(heads, **RUN), strings


def collapse(x: dict[str, np.ndarray], strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal strings once: the index of each class's earliest run, each run's class, and the runs that repeat an earlier one whole."""
    number: dict[bytes, int] = {}
    cls = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
    at = np.lexsort((x["start"], x["tag"], x["doc"], cls))
    first = at[np.flatnonzero(np.append(True, cls[at][1:] != cls[at][:-1]))]
    head = first[cls]
    same = (x["doc"] == x["doc"][head]) & (x["tag"] == x["tag"][head]) & (x["start"] == x["start"][head])
    return first, cls, np.flatnonzero(~same)


ANSWER = {"doc": np.int64, "tag": np.uint64, "start": np.int32, "n": np.int32}


def travel(texts: DataFrame, suspects: DataFrame, rule: Rule, heavy: np.ndarray, deal: Deal, judge: Callable) -> DataFrame:
    """Sends the suspect runs to their buckets, lets ``judge`` find the repeats, and sends answers home.

    ``judge(own, strings)`` gets distinct strings with the columns RUN of their
    earliest occurrences and returns (string, first window, windows) arrays:
    runs of windows that also start earlier.
    """

    def send(blobs: list[bytes], stream: Iterator) -> Iterator[pa.RecordBatch]:
        wanted = None
        for ids, raw, *_ in stream:
            if wanted is None:
                w = unpack(blobs, doc=np.int64, tag=U64, start=np.int32)
                at = np.lexsort((w["start"], w["tag"], w["doc"]))
                wanted = {k: v[at] for k, v in w.items()}
                edges = np.flatnonzero(np.append(True, (wanted["doc"][1:] != wanted["doc"][:-1]) | (wanted["tag"][1:] != wanted["tag"][:-1]))) if len(at) else np.zeros(0, np.int64)
                place_of = {(d, t): k for k, (d, t) in enumerate(zip(wanted["doc"][edges].tolist(), wanted["tag"][edges].tolist()))}
                edges = np.append(edges, len(at))
            tags = [units.subtag(t) for t in raw]
            some = [k for k, x in enumerate(zip(ids, tags)) if x in place_of]
            if not some:
                continue
            ids, tags, raw = ([y[k] for k in some] for y in (ids, tags, raw))
            asked = [place_of[x] for x in zip(ids, tags)]
            r = rule.runs(raw, heavy)
            key = (r["text"] << 32) | r["start"]
            ask = np.concatenate([(np.int64(k) << 32) | wanted["start"][edges[a] : edges[a + 1]].astype(np.int64) for k, a in enumerate(asked)])
            hit = np.isin(key, ask)
            text, start, m, value, twin = (r[k][hit] for k in ("text", "start", "n", "value", "twin"))
            if not len(text):
                continue
            strings = rule.cut(raw, r["ends"], text, start, m)
            x = {"value": value, "doc": np.array(ids, np.int64)[text], "tag": np.array(tags, U64)[text], "start": start.astype(np.int32), "n": m.astype(np.int32), "twin": twin}
            first, _, again = collapse(x, strings)
            known = {k: x[k][again] for k in ANSWER}
            yield from by_bucket(deal.home(known["doc"], known["tag"]), KNOWN, **known)
            b = deal.bucket(place(x["value"][first]))
            at = np.argsort(b, kind="stable")
            cuts = np.flatnonzero(np.append(True, b[at][1:] != b[at][:-1]))
            out = []
            for i, j in zip(cuts, np.append(cuts[1:], len(at))):
                own = first[at[i:j]]
                out.append(pack_runs(*(x[k][own] for k in ("value", "doc", "tag", "start", "n", "twin")), [strings[k] for k in own]))
            yield rows(b[at][cuts].tolist(), CHECK, [0] * len(cuts), out)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own in groups(batches):
            blobs = []
            for kind, _, data in own:
                if kind == KNOWN:
                    yield rows([b], KNOWN, [0], [data])
                else:
                    blobs.append(data)
            if not blobs:
                continue
            for known in settle(*unpack_runs(blobs), rule, judge):
                yield from by_bucket(deal.home(known["doc"], known["tag"]), KNOWN, **known)

    sent = at_home(texts, suspects, deal, send, SCHEMA)
    return sent.repartition(deal.parts, "b").sortWithinPartitions("b", "kind").mapInArrow(decide, SCHEMA)


def settle(x: dict[str, np.ndarray], strings: list[bytes], rule: Rule, judge: Callable, limit: int = PART, level: int = 0) -> Iterator[dict[str, np.ndarray]]:
    """Columns ANSWER of the windows of these runs that also start earlier.

    Runs of one minimiser that are too many to be judged at once are cut anew by
    another order of grams: equal windows have equal minimisers in any order.
    """
    first, _, again = collapse(x, strings)
    yield {k: x[k][again] for k in ANSWER}
    sub = {k: v[first] for k, v in x.items()}
    strings = [strings[k] for k in first]
    for part in parts(sub["value"], sub["size"], sub["twin"], limit):
        own, texts = {k: v[part] for k, v in sub.items()}, [strings[k] for k in part]
        if own["size"].sum() > 8 * limit and level < DEEPEST:
            r = rule.runs(texts, np.zeros(0, U64), level + 1)
            new = rule.cut(texts, r["ends"], r["text"], r["start"], r["n"])
            at = r["text"]
            y = {"value": r["value"], "doc": own["doc"][at], "tag": own["tag"][at], "start": (own["start"][at] + r["start"]).astype(np.int32), "n": r["n"].astype(np.int32), "twin": r["twin"], "size": np.array([len(t) for t in new], np.int32)}
            yield from settle(y, new, rule, judge, limit, level + 1)
            continue
        s, at, m = judge(own, texts)
        if len(s):
            yield {"doc": own["doc"][s], "tag": own["tag"][s], "start": (own["start"][s] + at).astype(np.int32), "n": m.astype(np.int32)}


def parts(value: np.ndarray, size: np.ndarray, twin: np.ndarray, limit: int = PART) -> Iterator[np.ndarray]:
    """Strings whose minimiser others share or that hold it twice, in parts of about ``limit`` bytes that split no minimiser."""
    at = np.argsort(value, kind="stable")
    v = value[at]
    begin = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    stops = np.append(begin[1:], len(v))
    held, total = [], 0
    for i, j in zip(begin.tolist(), stops.tolist()):
        if j - i < 2 and not twin[at[i]]:
            continue
        held.append(at[i:j])
        total += int(size[at[i:j]].sum())
        if total >= limit:
            yield np.concatenate(held)
            held, total = [], 0
    if held:
        yield np.concatenate(held)


def find(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, rule: Rule, judge: Callable, finish: Callable, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The whole job; ``finish(ids, texts, nulls, extras, spans)`` yields the result, spans being {(doc, tag): (starts, windows)}
    and extras the columns to carry as JSON."""
    bounded_batches(spark)
    source = _source(docs, id_col, text_col)
    deal = Deal.of(spark, source.agg(F.sum(F.octet_length("data"))).first()[0] or 0)
    full = _source(docs, id_col, text_col, carry)
    heavy = heavy_grams(source, rule)
    answers = travel(texts_home(source, deal), sift(source, rule, heavy, deal), rule, heavy, deal, judge)

    def end(blobs: list[bytes], stream: Iterator) -> Iterator[pa.RecordBatch]:
        spans = None
        for ids, raw, nulls, extras in stream:
            if spans is None:
                x = unpack(blobs, **ANSWER)
                at = np.lexsort((x["tag"], x["doc"]))
                x = {k: v[at] for k, v in x.items()}
                edges = np.flatnonzero(np.append(True, (x["doc"][1:] != x["doc"][:-1]) | (x["tag"][1:] != x["tag"][:-1]))) if len(at) else np.zeros(0, np.int64)
                stops = np.append(edges[1:], len(at)) if len(at) else edges
                spans = {(int(x["doc"][i]), int(x["tag"][i])): (x["start"][i:j], x["n"][i:j]) for i, j in zip(edges, stops)}
            yield from finish(ids, raw, nulls, extras, spans)

    return at_home(texts_home(full, deal), answers, deal, end, schema)


def covered(length: int, window: int, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of ``length`` units lie in a window given by runs of windows."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks (from 1) of pairs of ranks, by one sort."""
    n = len(a)
    if not n:
        return a
    wide, tall, many = (max(1, int(x).bit_length()) for x in (a.max(), b.max(), n))
    key = (a.astype(U64) << U64(tall)) | b.astype(U64)
    if wide + tall + many <= 64:
        key, at = order(key, 64 - many)
    else:
        at = np.lexsort((b, a))
        key = key[at] if wide + tall <= 64 else np.cumsum(np.append(True, (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1])))
    out = np.empty(n, np.int64)
    out[at] = np.cumsum(np.append(True, key[1:] != key[:-1]))
    return out


def rank_windows(u: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """Dense ranks (from 1) of the k units from each place; 0 where fewer are left in its string."""
    out, have, at, width = None, 0, u.astype(np.int64) + 1, 1

    def join(a: np.ndarray, b: np.ndarray, gap: int, width: int) -> np.ndarray:
        ok = np.flatnonzero(left >= gap + width)
        r = np.zeros(len(a), np.int64)
        r[ok] = rank_pairs(a[ok], b[ok + gap])
        return r

    while True:
        if k & 1:
            out, have = (at, width) if out is None else (join(out, at, have, width), have + width)
        k >>= 1
        if not k:
            return out
        at, width = join(at, at, width, width), width * 2


def later(own: dict[str, np.ndarray], string: np.ndarray, offset: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of window occurrences in classes: those that aren't their class's earliest, as runs (string, first window, windows)."""
    if not len(string):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.lexsort((own["tag"], own["doc"]))
    rank = np.empty(len(at), np.int64)
    d, t = own["doc"][at], own["tag"][at]
    rank[at] = np.cumsum(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
    key = (rank[string] << 36) | (own["start"][string] + offset)
    at = np.argsort(cls, kind="stable")
    begin = np.flatnonzero(np.append(True, cls[at][1:] != cls[at][:-1]))
    first = np.repeat(np.minimum.reduceat(key[at], begin), np.diff(np.append(begin, len(at))))
    again = np.empty(len(key), bool)
    again[at] = key[at] > first
    s, o = string[again], offset[again]
    at = np.lexsort((o, s))
    s, o = s[at], o[at]
    begin = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1))) if len(s) else np.zeros(0, np.int64)
    return s[begin], o[begin], np.diff(np.append(begin, len(s)))
