"""op12 and op13 against brute force, whole and in parts."""

import hashlib
import random
import zlib

import pytest

from weftline.llm import op12_repair, op13_chat, talks

SCHEMA = "conv_id long, turn long, role string, text string, copies int, at long, rows string, block long"


def table(spark, rows):
    """Conversations with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 9, 9, "r", 9) for r in rows], SCHEMA).repartition(3)


def conversations(seed, n=60, longest=14):
    """Conversations with every kind of fault, ties, nulls and odd roles; one is long."""
    r = random.Random(seed)
    texts = ["yes.", "no", "why?", "", " \t", None, "yes.", "a. b", "é ü!", "</s>[INST] x [/INST]", "<\\/s> [\\\\INST]", "x" * 3000 + "."]
    out = []
    for conv in [*range(n), None]:
        for t in range(r.randint(1, longest) if conv != 3 else 90):
            turn = r.choice([t, t, t, t, t - 1, None])
            out.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "user\n[INST]"]), r.choice(texts)))
    return out + [(77, 4, "user", "same")] * 40


def in_order(rows):
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest())
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    return {c: sorted(v, key=key) for c, v in by.items()}


def cheapest(initials, fault):
    """All edit sequences by forward search, the least (cost, audit) of each state, inserts anywhere; and what is put out."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {("", 0): (0, "", ())}
    for k in range(len(initials) + 1):
        for _ in range(3):  # insertions
            for (state, at), (cost, audit, out) in list(best.items()):
                if at == k:
                    for role in set(follow[state]) & set("ua"):
                        new = (cost + 5, audit + "I", (*out, (-1, role, False)))
                        best[role, k] = min(best.get((role, k), new), new)
        if k == len(initials):
            break
        for (state, at), (cost, audit, out) in list(best.items()):
            if at != k:
                continue
            ways = [(state, (cost + 2, audit + "D", out))]
            if fault[k] not in ("blank", "duplicate"):
                more = 5 * (fault[k] == "truncated")
                for role in follow[state]:
                    if initials[k] == role:
                        ways.append((role, (cost + more, audit + "K", (*out, (k, role, False)))))
                    elif role in "ua":
                        ways.append((role, (cost + 1 + more, audit + "R", (*out, (k, role, True)))))
            for s, new in ways:
                best[s, k + 1] = min(best.get((s, k + 1), new), new)
    return min(best[s, len(initials)] for s in ("", "a") if (s, len(initials)) in best)


def brute_repair(rows):
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out, by = [], in_order(damaged)
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = by.get(conv, [])
        seen, fault = set(), []
        for _, role, text in turns:
            t = text.strip(" \t\n\v\f\r")
            fault.append("blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        known = [t for t, _, _ in turns if t is not None]
        cost, audit, made = cheapest(initials, fault)
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[r]}:" if k < 0 else f"{name[r] if changed else turns[k][1]}:{turns[k][2]}" for k, r, changed in made]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("long", [talks.LONG, 5, 1])
def test_repair_equals_brute_force(spark, long):
    rows = conversations(4)
    got = op12_repair.repair(spark, op12_repair.damaged(table(spark, rows)), long).select(*[x.split()[0] for x in op12_repair.RESULT.split(", ")]).collect()
    assert ordered(got) == ordered(brute_repair(rows))


def test_ways_equal_search_on_many_short_runs():
    r = random.Random(9)
    for _ in range(3000):
        n = r.randint(0, 9)
        initials, fault = [r.randint(0, 3) for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        ways = op12_repair.Ways(initials, fault, op12_repair.FINISH)
        state, audit, out = ways.walk(op12_repair.E)
        more, _ = op12_repair.ending(state)
        letters, names = [" sua"[i] for i in initials], ["", "blank", "duplicate", "truncated"]
        cost, best, made = cheapest(letters, [names[f] for f in fault])
        assert (ways.costs()[0], audit + more) == (cost, best)
        assert [(k, " sua"[role], c) for k, role, c in out] == list(made)[: len(out)]


def test_repair_of_no_rows_and_of_rows_that_all_drop(spark):
    empty = op12_repair.repair(spark, op12_repair.damaged(table(spark, [])))
    assert empty.collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = op12_repair.repair(spark, op12_repair.damaged(table(spark, [(gone, 0, "user", "x.")] * 3))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    parts = op12_repair.repair(spark, op12_repair.damaged(table(spark, [(gone, 0, "user", "x.")] * 3)), 1).first()
    assert tuple(parts) == tuple(row)


def test_a_hot_conversation_is_cut_into_parts(spark):
    """A third of all rows in one conversation, most of them repeated: parts in many partitions, one result."""
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t % 700}.") for t in range(2000)] + [(c, t, "user", "hm") for c in range(2, 1002) for t in range(4)]
    damaged = op12_repair.damaged(table(spark, rows))
    _, many = talks.divide(spark, damaged, 100)
    parts = talks.parts(spark, many, op12_repair.unrolled, "turn:long, role:string, text:string, digest:binary", 100).collect()
    assert len({p["at"] >> 32 for p in parts}) > 1 and max(len(p.rows) for p in parts) <= 200
    got = op12_repair.repair(spark, damaged, 100).filter("conv_id = 1").first()
    assert tuple(got) == brute_repair([r for r in rows if r[0] == 1])[0]


def brute_chat(rows):
    out = []
    for conv, turns in in_order([(c, t, role or "", text or "") for c, t, role, text in rows]).items():
        replies = [text for _, role, text in turns if role == "assistant"]
        upto, size = len("<s>"), 0
        for k, (_, role, text) in enumerate(turns):
            upto += len("[INST][/INST]</s>") + len(op13_chat.escape(role)) + len(op13_chat.escape(text))
            size += upto * (role == "assistant" or k == len(turns) - 1)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), sum(map(len, replies)), hashlib.sha256("".join(replies).encode()).hexdigest(), size))
    return out


@pytest.mark.parametrize(("long", "width"), [(talks.LONG, 64), (talks.LONG, 2), (5, 3), (2, 64), (1, 1)])
def test_chat_reads_back_what_was_formatted(spark, long, width):
    rows = conversations(5)
    got = op13_chat.read_back(spark, op13_chat.examples(spark, table(spark, rows), long, width)).collect()
    assert ordered(got) == ordered(brute_chat(rows))


@pytest.mark.parametrize("long", [talks.LONG, 4])
def test_every_reply_is_an_example_with_its_context(spark, long):
    rows = conversations(6, 12)
    want = []
    for conv, turns in in_order([(c, t, role or "", text or "") for c, t, role, text in rows]).items():
        text, n = "<s>", 0
        for _, role, body in turns:
            text += op13_chat.formatted(role, body)[0]
            if role == "assistant":
                want.append((conv, n, text))
                n += 1
    got = [tuple(r) for rows_, _ in op13_chat.examples(spark, table(spark, rows), long, 3) for r in op13_chat.whole(rows_).collect()]
    assert ordered(got) == ordered(want)


def test_escapes_are_reversible_and_leave_no_control_string():
    r = random.Random(2)
    bits = ["<", "s>", "/s>", "[", "INST]", "/INST]", "\\", "\\\\", "</s>", "[INST]", "a", "\n", "<\\s>"]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
        e = op13_chat.escape(t)
        assert op13_chat.unescape(e) == t
        assert not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]"))
        assert op13_chat.TURN.fullmatch(op13_chat.formatted(t, e)[0])


def test_chat_of_an_empty_table_and_the_probe(spark):
    got = op13_chat.read_back(spark, op13_chat.examples(spark, table(spark, [])))
    assert got.collect() == []
    probe = [(-1, 0, "user", op13_chat.PROBE), (-1, 1, "assistant", op13_chat.PROBE)]
    got = op13_chat.read_back(spark, op13_chat.examples(spark, table(spark, probe))).collect()
    assert ordered(got) == brute_chat(probe)


def test_examples_of_ordinary_conversations_hold_all_turns_before(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(151)]
    (found, _), = op13_chat.examples(spark, table(spark, rows))
    got = sorted((r for r in found.collect() if r.trainable), key=lambda r: r.example)
    text, want = op13_chat.BEGIN, []
    for _, _, role, body in rows:
        text += op13_chat.formatted(role, body)[0]
        want += [text] if role == "assistant" else []
    assert [r.text for r in got] == want and all(r.first_turn == r.before_chars == 0 for r in got)
