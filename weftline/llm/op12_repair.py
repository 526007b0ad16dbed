"""Conversation structure repair: a retained-subsequence DP over turns.

Turns are kept (0), reroled to user or assistant (1), deleted (2) or preceded by
an inserted empty turn (5) until the role initials read ``(s?(ua)+)?``; blank and
repeated turns must go, and a truncated one that stays costs 5 more.

The DP chooses which turns are retained, and as what. Deleting all between two
retained turns costs a difference of prefix sums, so for each role a running
minimum over the retained turns to come prices every gap at once; the pair of
roles tells how many turns must be inserted (none or one; at the end up to
two). Costs are compared first and audits (initials of the edits) next: of
equally cheap continuations that with the longer gap comes first (D before
all), then an insertion (I), then keeping (K), then reroling (R), which is the
order of the strings. Each turn costs a few comparisons, whatever the length.

Ordinary conversations are solved whole. A long one (``talks``) is cut into
parts: repeated turns are found by each part's distinct digests, a part's
cheapest costs from state to state make a 4 x 4 matrix, products of matrices
give each part the price of what follows it, the way through every part from
each state gives its states, and then all parts are repaired at once. Only the
digest of the repaired text is left to one task, which hashes the parts as they
stream by, as SHA-256 has to.

Defined results: a null role or text is one space, and so is a null conv_id or
turn in what is hashed for damage; a null conv_id is a conversation of its own;
rows of one turn follow by role, then by SHA-256 of the text; an initial is the
role's first character, as it is; repeated rows count each; conversations that
lose all their rows are returned; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import talks
from weftline.session import bounded_batches, buckets, checkpointed, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = b" \t\n\v\f\r"
#: States: nothing yet, or the role of the last retained turn. Roles are the states 1 to 3.
E, S, U, A = range(4)
ROLE = {"s": S, "u": U, "a": A}
NAME = {U: "user", A: "assistant"}
#: Insertions between a state and the next retained role, None where that can't follow; and before the end.
GAP = [[None, 0, 0, 1], [None, None, 0, 1], [None, None, 1, 0], [None, None, 0, 1]]
ENDS = [0, 2, 1, 0]
FINISH = [INSERT * n for n in ENDS]
LEGAL = {(S, U), (U, A), (A, U)}
NONE, BLANK, DUPLICATE, CUT = range(4)
#: A choice is one integer: cost, rows left at the next retained turn, no insertion, reroled, role; so the least is the best.
COST, LEFT, STRAIGHT, CHANGED, INFINITE = 44, 8, 4, 3, 1 << 40
LARGEST = (1 << 63) - 1

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): no copies of a dropped row, two of a repeated one."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20
    rows = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), part(role).alias("role"), part(text).alias("text"), kind.alias("kind"))
    now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), now.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def digest(role: str, text: str) -> bytes:
    r = role.encode()
    return xxhash.xxh3_128_digest(b"%d:%b%b" % (len(r), r, text.encode()))


def faults(turns: Sequence[tuple[str, str]], digests: Sequence[bytes], seen: set[bytes]) -> list[int]:
    """Each turn's first fault; ``seen`` gains the turns' digests."""
    out = []
    for (_, text), d in zip(turns, digests):
        t = text.encode().rstrip(SPACES)
        out.append(BLANK if not t else DUPLICATE if d in seen else NONE if t[-1:] in b".!?" else CUT)
        seen.add(d)
    return out


class Ways:
    """The cheapest ways through a run of turns, given the price of what follows from each state."""

    def __init__(self, initials: Sequence[int], fault: Sequence[int], after: Sequence[int]):
        n = self.n = len(initials)
        least = [INFINITE << COST] * 4  # running minimum for each role over the turns to come
        leave = [(min(after[r], INFINITE) + DELETE * n) << COST for r in range(4)]
        self.picks: list[tuple[int, int, int, int] | None] = [None] * n

        def first(state: int) -> int:
            best = leave[state]
            for role, gap in enumerate(GAP[state]):
                if gap is not None and (x := least[role] + (INSERT * gap << COST) - (gap << STRAIGHT)) < best:
                    best = x
            return best

        for k in range(n - 1, -1, -1):
            if fault[k] in (BLANK, DUPLICATE):
                continue
            picks = self.picks[k] = (0, first(S), first(U), first(A))
            own, more = initials[k], (TRUNCATED if fault[k] == CUT else 0) - DELETE
            for role in (S, U, A):
                if own == role or role != S:
                    price = (picks[role] >> COST) + more + (KEEP if own == role else REROLE)
                    x = price << COST | (n - k) << LEFT | 1 << STRAIGHT | (own != role) << CHANGED | role
                    if x < least[role]:
                        least[role] = x
        self.entry = [first(r) for r in range(4)]

    def costs(self) -> list[int]:
        """From each state, the turns and what follows."""
        return [min(x >> COST, INFINITE) for x in self.entry]

    def walk(self, state: int) -> tuple[int, str, list[tuple[int, int, bool]]]:
        """The state left in, the audit, and what is put out: (turn or -1, role, reroled)."""
        at, audit, out, x = 0, [], [], self.entry[state]
        while role := x & 7:
            k, inserted, changed = self.n - (x >> LEFT & (1 << COST - LEFT) - 1), not x >> STRAIGHT & 1, bool(x >> CHANGED & 1)
            audit.append("D" * (k - at) + "I" * inserted + "KR"[changed])
            if inserted:
                out.append((-1, U + A - role, False))
            out.append((k, role, changed))
            state, at, x = role, k + 1, self.picks[k][role]
        audit.append("D" * (self.n - at))
        return state, "".join(audit), out


def written(turns: Sequence[tuple[str, str]], out: list[tuple[int, int, bool]]) -> list[bytes]:
    return [(f"{NAME[role]}:" if k < 0 else f"{NAME[role] if changed else turns[k][0]}:{turns[k][1]}").encode() for k, role, changed in out]


def ending(state: int) -> tuple[str, list[bytes]]:
    """Insertions before the end."""
    return "I" * ENDS[state], [b"user:", b"assistant:"][2 - ENDS[state] :]


def measured(turns: Sequence[int | None], initials: Sequence[int], fault: Sequence[int]) -> dict[str, int]:
    """What sums and borders tell of a run of turns."""
    known = [t for t in turns if t is not None]
    return {
        "n": len(turns),
        **{name: fault.count(f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))},
        "illegal": sum(x not in LEGAL for x in zip(initials, initials[1:])),
        "distinct": len(set(known)),
        "low": min(known, default=0),
        "high": max(known, default=0),
        "first": initials[0] if initials else 0,
        "last": initials[-1] if initials else 0,
    }


def solved(conv: int | None, rows: list[tuple]) -> tuple:
    """The result row of a whole conversation (turn, role, text, copies)."""
    rows = [r for r in rows for _ in range(r[3])]
    turns = [(r[1], r[2]) for r in rows]
    initials = [ROLE.get(role[:1], 0) for role, _ in turns]
    fault = faults(turns, [digest(*t) for t in turns], set())
    m = measured([r[0] for r in rows], initials, fault)
    ways = Ways(initials, fault, FINISH)
    state, audit, out = ways.walk(E)
    more, tail = ending(state)
    gaps = m["high"] - m["low"] + 1 - m["distinct"] if m["distinct"] else 0
    return conv, min(gaps, LARGEST), m["blank"], m["duplicate"], m["truncated"], m["illegal"], ways.costs()[E], audit + more, hashlib.sha256(b"\n".join([*written(turns, out), *tail])).hexdigest()


def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for conv, rows in talks.stream(batches):
        held.append(solved(conv, rows))
        if len(held) == 1024:
            yield result(held)
            held = []
    yield result(held)


def result(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


MEASURES = "conv_id long, at long, initials binary, faults binary, n long, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first long, last long, matrix array<long>"


def examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part (conv_id, at, rows, turns seen in earlier parts): faults, measures, and costs from state to state."""
    for b in batches:
        for conv, at, rows, earlier in zip(*(c.to_pylist() for c in b.columns)):
            turns = [(r["role"], r["text"]) for r in rows]
            initials = [ROLE.get(role[:1], 0) for role, _ in turns]
            fault = faults(turns, [r["digest"] for r in rows], set(earlier or ()))
            m = measured([r["turn"] for r in rows], initials, fault)
            through = [Ways(initials, fault, [0 if r == to else INFINITE for r in range(4)]).costs() for to in range(4)]
            row = {"conv_id": conv, "at": at, "initials": bytes(initials), "faults": bytes(fault), **m, "matrix": [through[to][r] for r in range(4) for to in range(4)]}
            kinds = [pa.list_(pa.int64()) if t == "array<long>" else pa.binary() if t == "binary" else pa.int64() for t in (x.split()[1] for x in MEASURES.split(", "))]
            yield pa.record_batch([pa.array([v], kind) for v, kind in zip(row.values(), kinds)], list(row))


def priced(parts: pd.DataFrame) -> pd.DataFrame:
    """For each part of one conversation the price, from each state, of what follows it; totals on the first part's row."""
    parts = parts.sort_values("at")
    after, rows = np.array(FINISH, np.int64), []
    for at, matrix in zip(parts["at"][::-1], parts["matrix"][::-1]):
        rows.append((at, after.tolist()))
        after = np.minimum((np.asarray(matrix, np.int64).reshape(4, 4) + after).min(axis=1), INFINITE)
    full = parts[parts["n"] > 0]
    borders = zip(full["last"][:-1], full["first"][1:])
    illegal = int(full["illegal"].sum()) + sum((int(x), int(y)) not in LEGAL for x, y in borders)
    some = full[full["distinct"] > 0]
    shared = sum(int(x) == int(y) for x, y in zip(some["high"][:-1], some["low"][1:]))
    gaps = int(some["high"].max()) - int(some["low"].min()) + 1 - int(some["distinct"].sum()) + shared if len(some) else 0
    totals = [min(gaps, LARGEST), *(int(full[c].sum()) for c in ("blank", "duplicate", "truncated")), illegal, int(after[E])]
    out = pd.DataFrame(rows[::-1], columns=["at", "after"])
    out.insert(0, "conv_id", parts["conv_id"].iloc[0])
    out["totals"] = [totals, *[None] * (len(out) - 1)]
    return out


def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each part is left, for each state in which it is entered."""
    for b in batches:
        conv, at, initials, fault, after = (c.to_pylist() for c in b.columns)
        exits = [[w.walk(r)[0] for r in range(4)] for w in (Ways(i, f, v) for i, f, v in zip(initials, fault, after))]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(exits, pa.list_(pa.int64()))], ["conv_id", "at", "exits"])


def entered(parts: pd.DataFrame) -> pd.DataFrame:
    """The state in which each part of one conversation is entered."""
    parts, state, out = parts.sort_values("at"), E, []
    for exits in parts["exits"]:
        out.append(state)
        state = int(exits[state])
    return pd.DataFrame({"at": parts["at"], "state": out})


def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's audit and repaired turns (joined by newlines; null: none), and the state left in."""
    for b in batches:
        for conv, at, rows, initials, fault, after, totals, state in zip(*(c.to_pylist() for c in b.columns)):
            left, audit, out = Ways(initials, fault, after).walk(state)
            lines = written([(r["role"], r["text"]) for r in rows], out)
            yield pa.record_batch([pa.array([conv], pa.int64()), pa.array([at], pa.int64()), pa.array([totals], pa.list_(pa.int64())), pa.array([left], pa.int64()), pa.array([audit]), pa.array([b"\n".join(lines) if lines else None], pa.binary())], ["conv_id", "at", "totals", "state", "audit", "repaired"])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its parts in order, hashed as they pass."""
    now: dict = {}

    def done() -> pa.RecordBatch:
        more, tail = ending(now["state"])
        for line in tail:
            put(line)
        return result([(now["conv"], *now["totals"], "".join(now["audit"]) + more, now["sha"].hexdigest())])

    def put(data: bytes) -> None:
        now["sha"].update(b"\n" * now["some"] + data)
        now["some"] = True

    for b in batches:
        for conv, _, totals, state, audit, repaired in zip(*(c.to_pylist() for c in b.columns)):
            if not now or conv != now["conv"]:
                if now:
                    yield done()
                now.update(conv=conv, totals=totals, audit=[], sha=hashlib.sha256(), some=False)
            now["state"] = state
            now["audit"].append(audit)
            if repaired is not None:
                put(repaired)
    if now:
        yield done()


def unrolled(rows: list[tuple]) -> list[dict]:
    return [{"turn": turn, "role": role, "text": text, "digest": digest(role, text)} for turn, role, text, copies in rows for _ in range(copies)]


def long_ones(spark: SparkSession, rows: DataFrame, long: int) -> DataFrame:
    n = buckets(spark)
    parts = talks.parts(spark, rows, unrolled, "turn:long, role:string, text:string, digest:binary", long)
    own = parts.select("conv_id", "at", F.explode(F.array_distinct("rows.digest")).alias("digest"))
    first = own.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = own.conv_id.eqNullSafe(first.conv_id) & (own.digest == first.digest) & (own["at"] > first["first"])
    earlier = own.join(first, same, "left_semi").groupBy("at").agg(F.collect_list("digest").alias("earlier"))
    codes = checkpointed(spark, parts.join(earlier, "at", "left").select("conv_id", "at", "rows", "earlier").mapInArrow(examined, MEASURES))
    prices = checkpointed(spark, codes.drop("initials", "faults").groupBy("conv_id").applyInPandas(priced, "conv_id long, at long, after array<long>, totals array<long>"))
    coded = codes.select("at", "initials", "faults").join(prices, "at")
    states = coded.select("conv_id", "at", "initials", "faults", "after").mapInArrow(crossed, "conv_id long, at long, exits array<long>").groupBy("conv_id").applyInPandas(entered, "at long, state long")
    known = coded.join(states, "at").drop("conv_id")
    pieces = parts.join(known, "at").select("conv_id", "at", "rows", "initials", "faults", "after", "totals", "state").mapInArrow(mended, "conv_id long, at long, totals array<long>, state long, audit string, repaired binary")
    return pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(joined, RESULT)


def repair(spark: SparkSession, rows: DataFrame, long: int = talks.LONG) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies), as ``damaged`` gives them (copies 1: a row as it is)."""
    bounded_batches(spark)
    few, many = talks.divide(spark, rows, long)
    out = talks.dealt(spark, few).mapInArrow(ordinary, RESULT)
    return out if many is None else out.union(long_ones(spark, many, long))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark, damaged(table(spark, sf_dir, "conversations")))
