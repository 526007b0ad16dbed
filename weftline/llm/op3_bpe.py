"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

The corpus's frequent words (pre-tokens) are encoded once on the driver and
compiled into a minimal acyclic automaton that shares suffixes as well as
prefixes. Its arcs carry numbers that add up to a word's place in the sorted
lexicon, and the place gives the word's ids. The arrays are one file in the
shared folder, memory-mapped by the workers (read whole where the folder's
store can't be mapped). Any other word is merged exactly by the vocabulary's
ranks, long words with a heap in n log n. Only speed depends on which words the
lexicon holds: ``LEXICON`` of those that occur at least ``OFTEN`` times within
a map task's stretch of text, most frequent first.

Equal to the tokenizers library with add_special_tokens=False and without
truncation and padding; added special tokens in a text become their one id.

Defined results: a null or empty text has no tokens; texts of any length are
encoded whole; repeated rows give one result each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.repeats import most_frequent
from weftline.session import bounded_batches, scratch, table

LEXICON, OFTEN, STRETCH, CACHE, LONG = 1 << 17, 8, 400_000, 300_000, 48
#: The published pre-token pattern of byte-level BPE (a fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts on which re's classes agree with it; SLOW finds the others.
FAST = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SLOW = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def pretokens(text: str) -> list[str]:
    return PATTERN.findall(text) if SLOW.search(text) else FAST.findall(text)


def byte_letters() -> list[str]:
    """Byte-level BPE writes bytes as printable letters: those that print as themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, ranks of merges, and tokens' bytes of a tokenizers file."""

    def __init__(self, text: str | bytes):
        spec = json.loads(text)
        vocab, self.special = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.ranks = {}
        for rank, x in enumerate(spec["model"]["merges"]):
            a, b = x.split(" ") if isinstance(x, str) else x
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.split = re.compile("|".join(self._added(x) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"])))) if self.special else None

    @staticmethod
    def _added(x: dict) -> str:
        """Where an added token stands: lstrip and rstrip take the white space beside it along, single_word wants no letters beside it."""
        own = "(?P<t%d>%s)" % (x["id"], re.escape(x["content"]))
        if x.get("single_word"):
            own = rf"(?<!\w){own}(?!\w)"
        return (r"\s*" if x.get("lstrip") else "") + own + (r"\s*" if x.get("rstrip") else "")

    def parts(self, text: str) -> list[str | int]:
        """Stretches of plain text and ids of added tokens."""
        if self.split is None or not (found := list(self.split.finditer(text))):
            return [text]
        out, at = [], 0
        for m in found:
            out += [text[at : m.start()], int(m.lastgroup[1:])]
            at = m.end()
        return [*out, text[at:]]

    def merge(self, word: bytes) -> list[int]:
        """Applies the merges of least rank, leftmost first, until none is left."""
        ids, ranks = [self.first[b] for b in word], self.ranks
        if len(ids) > LONG:
            return self._merge_long(ids)
        while len(ids) > 1:
            found = [(ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks]
            if not found:
                break
            k = min(found)[1]
            ids[k : k + 2] = [ranks[ids[k], ids[k + 1]][1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = ranks[a, b][1], -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for i, m in ((before[k], k), (k, after[k])):
                if i >= 0 and m >= 0 and (p := (ids[i], ids[m])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], i, *p))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of the words.

    ``arc`` holds, sorted, source state and label of every arc in one number;
    ``add`` is the number of words that precede those behind the arc. Word k of the sorted
    lexicon has ids[at[k]:at[k+1]].
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...))

    def settle(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if (s := register.get(key)) is None:
            s = register[key] = len(states)
            states.append(key)
        return s

    path: list[list] = [[False, [], None]]  # of the last word: final, arcs, label from its parent
    order = sorted(words)
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs, label = path.pop()
            path[-1][1].append((label, settle(final, arcs)))

    for w in order:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        fold(same)
        for c in w[same:]:
            path.append([False, [], c])
        path[-1][0] = True
        last = w
    fold(0)
    root = settle(path[0][0], path[0][1])
    size = [0] * len(states)
    label, target, add, first = [], [], [], [0]
    for s, (final, arcs) in enumerate(states):  # targets stand before their sources
        n = int(final)
        for c, t in arcs:
            label.append(c)
            target.append(t)
            add.append(n)
            n += size[t]
        size[s] = n
        first.append(len(label))
    at = np.zeros(len(order) + 1, np.int64)
    np.cumsum([len(words[w]) for w in order], out=at[1:])
    return {
        "root": np.array([root], np.int32), "arc": np.repeat(np.arange(len(states), dtype=np.int64), np.diff(first)) << 8 | np.array(label, np.int64), "target": np.array(target, np.int32), "add": np.array(add, np.int32),
        "final": np.array([x[0] for x in states], bool), "at": at.astype(np.int32), "ids": np.array([i for w in order for i in words[w]], "<u4"),
    }


def write_lexicon(arrays: dict[str, np.ndarray], folder: str) -> str:
    """Writes the arrays as one file: a JSON head, then each array at a multiple of 64."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = (at, len(v), v.dtype.str)
        at += -(-v.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/lexicon.bin") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for v in arrays.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 64))
    return f"{folder}/lexicon.bin"


def map_lexicon(uri: str) -> dict[str, np.ndarray]:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    buf = pa.memory_map(path).read_buffer() if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path).read_buffer()
    n = int.from_bytes(buf[:8].to_pybytes(), "little")
    head = json.loads(buf[8 : 8 + n].to_pybytes())
    return {k: np.frombuffer(buf, kind, size, 8 + n + at) for k, (at, size, kind) in head.items()}


class Pairs:
    """Pair of ids -> (rank, merged id) for arrays of pairs: an open-addressed table."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], bits: int = 19):
        while len(ranks) * 4 > 1 << bits:
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank, self.new = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32), np.zeros(1 << bits, np.int32)
        keys = np.array([a << 32 | b for a, b in ranks], np.int64)
        for k, h, (rank, new) in zip(keys.tolist(), self._slot(keys).tolist(), ranks.values()):
            while self.key[h] >= 0:
                h = (h + 1) & self.mask
            self.key[h], self.rank[h], self.new[h] = k, rank, new

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NEVER where a pair doesn't merge) and merged ids."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        open_ = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.key[at[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], NEVER), self.new[at]


NEVER = 1 << 30


class Encoder(dict):
    """Pre-token -> its ids as little-endian 32-bit integers; remembers a bounded number.

    New words of a batch are looked up and merged together, array by array.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: dict[str, np.ndarray]):
        self.v, self.pairs, self.bytes_ids = vocabulary, Pairs(vocabulary.ranks), np.array(vocabulary.first, np.int32)
        # the arrays as they are mapped; nothing of the lexicon is copied
        self.ids, self.arc, self.target, self.plus, self.at, self.final = (lexicon[k] for k in ("ids", "arc", "target", "add", "at", "final"))
        self.root = int(lexicon["root"][0])

    def find(self, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places of words (rows of bytes) in the lexicon, or -1: all walk the automaton together."""
        state, place = np.full(len(size), self.root, np.int64), np.zeros(len(size), np.int64)
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero((size > k) & (state >= 0))
            key = state[on] << 8 | letters[on, k]
            arc = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[arc] == key if len(self.arc) else np.zeros(len(on), bool)
            place[on[ok]] += self.plus[arc[ok]]
            state[on[ok]] = self.target[arc[ok]]
            state[on[~ok]] = -1
        done = np.flatnonzero(state >= 0)
        done = done[self.final[state[done]]]
        out = np.full(len(size), -1, np.int64)
        out[done] = place[done]
        return out

    def merge(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids and their lengths: in each row the leftmost pair of least rank merges until none does."""
        n, width = letters.shape
        out, out_size = np.zeros((n, width), np.uint32), size.copy()
        row, ids, size = np.arange(n), self.bytes_ids[letters], size.copy()
        column = np.arange(width)
        rank, new = (x.reshape(n, width - 1) for x in self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())) if width > 1 else (np.full((n, 1), NEVER), np.zeros((n, 1)))
        rank = np.where(column[1:] < size[:, None], rank, NEVER) if width > 1 else rank
        while True:
            k = rank.argmin(axis=1)
            live = rank[np.arange(len(row)), k] < NEVER
            done = ~live
            out[row[done]], out_size[row[done]] = ids[done], size[done]
            if not live.any():
                return out, out_size
            row, ids, size, rank, new, k = row[live], ids[live], size[live] - 1, rank[live], new[live], k[live]
            r = np.arange(len(row))
            ids[r, k] = new[r, k]
            later = np.minimum(column + (column > k[:, None]), width - 1)
            ids = np.take_along_axis(ids, later, 1)
            pair = later[:, : width - 1].clip(max=width - 2)
            rank, new = np.take_along_axis(rank, pair, 1), np.take_along_axis(new, pair, 1)
            rank[:, -1] = NEVER  # no row is full any more
            for at in (k - 1, k):
                some = np.flatnonzero((at >= 0) & (at + 1 < size))
                rank[some, at[some]], new[some, at[some]] = self.pairs.find(ids[some, at[some]], ids[some, at[some] + 1])
            gone = np.flatnonzero((k + 1 >= size) & (k < width - 1))
            rank[gone, k[gone]] = NEVER

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't remembered yet."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        for lo, hi in ((0, 12), (12, LONG)):
            own = np.flatnonzero((size > lo) & (size <= hi))
            for part in (own[i : i + 16384] for i in range(0, len(own), 16384)):
                m, width = size[part], int(size[part].max())
                letters = np.zeros((len(part), width), np.uint8)
                letters[np.arange(width) < m[:, None]] = np.frombuffer(b"".join([raw[k] for k in part.tolist()]), np.uint8)
                place = self.find(letters, m)
                for k, p in zip(part[place >= 0].tolist(), place[place >= 0].tolist()):
                    self[words[k]] = self.ids[self.at[p] : self.at[p + 1]].tobytes()
                rest = place < 0
                if rest.any():
                    ids, n = self.merge(letters[rest], m[rest])
                    flat, step = ids.astype("<u4").tobytes(), 4 * width
                    for i, (k, c) in enumerate(zip(part[rest].tolist(), n.tolist())):
                        self[words[k]] = flat[i * step : i * step + 4 * c]
        for k in np.flatnonzero(size > LONG).tolist():
            self[words[k]] = np.array(self.v.merge(raw[k]), "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        words = [[w for p in self.v.parts(t) for w in ((p,) if isinstance(p, int) else pretokens(p))] for t in texts]
        new = set().union(*words).difference(self)
        if len(self) + len(new) > CACHE:
            self.clear()
            new = set().union(*words)
        added = {w for w in new if isinstance(w, int)}
        for w in added:
            self[w] = np.array([w], "<u4").tobytes()
        self.learn(list(new - added))
        out = [b"".join(map(self.__getitem__, own)) for own in words]
        if len(self) > CACHE:
            self.clear()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(lexicon: str) -> Encoder:
    """One for each worker process, kept over tasks. The vocabulary stands in the same file, so workers need no path but the shared folder's."""
    if lexicon not in _ENCODERS:
        _ENCODERS.clear()
        arrays = map_lexicon(lexicon)
        _ENCODERS[lexicon] = Encoder(Vocabulary(arrays["vocabulary"].tobytes()), arrays)
    return _ENCODERS[lexicon]


def text_batches(x: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about ``size`` characters with their texts (null: empty)."""
    lo, n, held = 0, 0, []
    for hi, t in enumerate(x.column(1), 1):
        held.append(t.as_py() or "")
        n += len(held[-1])
        if n >= size or hi == x.num_rows:
            yield x.slice(lo, hi - lo), held
            lo, n, held = hi, 0, []


def frequent_words(texts: DataFrame, most: int = LEXICON) -> list[str]:
    """The most frequent pre-tokens over all texts; those rare in a whole stretch of text aren't counted there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = {w: n for w, n in seen.items() if n >= OFTEN and len(w) <= 64}
            return pa.record_batch([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

        for x in batches:
            for t in x.column(0):
                seen.update(pretokens(t.as_py() or ""))
                if len(seen) > STRETCH:
                    yield out()
                    seen.clear()
        yield out()

    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in most_frequent(counted, most).select("word").collect()]


def build_lexicon(spark: SparkSession, docs: DataFrame, text_col: str, vocabulary: str) -> str:
    with open(vocabulary, "rb") as f:
        raw = f.read()
    v = Vocabulary(raw)
    words = {w.encode(): v.merge(w.encode()) for w in frequent_words(docs.select(F.col(text_col).cast("string").alias("text")))}
    return write_lexicon(compile_lexicon(words) | {"vocabulary": np.frombuffer(raw, np.uint8)}, scratch(spark, "lexicon"))


def encode(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of ids and of the decoded text; ids and decoded text where with_ids."""
    bounded_batches(spark)
    vocabulary = vocabulary or default_vocabulary()
    lexicon = build_lexicon(spark, docs, text_col, vocabulary)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(lexicon)
        for x in batches:
            for part, texts in text_batches(x):
                out: list[list] = [[] for _ in names[1:]]
                for ids in e.encode_batch(texts):
                    text = e.decode(ids)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), np.frombuffer(ids, "<u4").astype(np.int32), text)
                    for k, v in zip(out, row):
                        k.append(v)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
                yield pa.record_batch([part.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, table(spark, sf_dir, "documents"), with_ids=False)
