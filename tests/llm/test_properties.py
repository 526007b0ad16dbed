"""Properties of the operators' kernels for any input."""

import html

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import op2_permutation, op4_suffix, op6_substring, op7_simhash, op8_decontam, op10_html, repeats, units


@given(st.lists(st.binary(max_size=40), max_size=6))
def test_word_hashes_follow_words(texts):
    buf, starts, stops, first = units.word_bounds(texts, units.SPACE)
    u, words = units.word_hashes(buf, starts, stops), [w for t in texts for w in repeats.words_of(t)]
    assert [buf[a:b].tobytes() for a, b in zip(starts, stops)] == words
    assert np.diff(first).tolist() == [len(repeats.words_of(t)) for t in texts]
    same = {w: h for w, h in zip(words, u.tolist())}
    assert [same[w] for w in words] == u.tolist() and len(set(same.values())) == len(same)


@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 20))
def test_window_minimum(values, w):
    a = np.array(values, np.uint64)
    assert units.window_min(a, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_ranks_order_windows(values, k):
    a = np.array(values)
    rank = repeats.rank_windows(a, len(a) - np.arange(len(a)), k)
    full = [(tuple(values[i : i + k]), int(rank[i])) for i in range(len(values) - k + 1)]
    assert all(r == 0 for r in rank[len(full) :])
    assert all((x < y) == (r < s) and (x == y) == (r == s) for x, r in full for y, s in full)


def _judged(judge, texts, n, cut):
    own = {"value": np.zeros(len(texts), np.uint64), "doc": np.arange(len(texts)), "tag": np.zeros(len(texts), np.uint32), "start": np.zeros(len(texts), np.int32), "n": np.array(n, np.int32), "twin": np.ones(len(texts), bool), "size": np.array([len(t) for t in texts])}
    s, a, m = judge(own, texts)
    return {(int(i), int(j)) for i, b, c in zip(s, a, m) for j in range(b, b + c)}


def _expected(units_of, n, length):
    seen, out = set(), set()
    for i, u in enumerate(units_of):
        for p in range(n[i]):
            x = tuple(u[p : p + length])
            if x in seen:
                out.add((i, p))
            seen.add(x)
    return out


@given(st.lists(st.text(alphabet="ab", min_size=10, max_size=60), min_size=1, max_size=8, unique=True), st.sampled_from([5, 10]))
@settings(max_examples=60)
def test_interleaved_transforms_find_all_repeats(texts, length):
    raw = [t.encode() for t in texts]
    n = [len(t) - length + 1 for t in raw]
    assert _judged(op4_suffix.judge(length), raw, n, None) == _expected(raw, n, length)


@given(st.lists(st.lists(st.sampled_from("xyz"), min_size=3, max_size=30), min_size=1, max_size=6))
@settings(max_examples=60)
def test_sorted_windows_find_all_repeats(words):
    strings = list(dict.fromkeys(" ".join(w).encode() for w in words))
    split = [s.split(b" ") for s in strings]
    n = [len(w) - 2 for w in split]
    assert _judged(op6_substring.judge(3), strings, n, None) == _expected(split, n, 3)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40, unique=True))
def test_pivots_never_discard_a_link(fps):
    fps += [x ^ 1 << (x % 64) for x in fps]
    fp = np.unique(np.array(fps, np.uint64))
    i, j = np.triu_indices(len(fp), 1)
    kept = op7_simhash.survive(op7_simhash.whole(3).table(fp), fp, i, j, 3)
    assert set(kept.tolist()) == set(np.flatnonzero(np.bitwise_count(fp[i] ^ fp[j]) <= 3).tolist())


@given(st.lists(st.sampled_from(["al", "be", "ga", "de"]), min_size=10, max_size=60), st.integers(0, 50))
@settings(max_examples=60)
def test_winnowing_meets_every_shared_span(words, at):
    item = words[at % max(1, len(words) - 9) :][:12]
    text = " ".join(["zz", *words, "qq"]).encode()
    index = op8_decontam.Index([("1", " ".join(item).encode())], 10, 5)
    (_, hit, found), = index.scan([text])
    want = op8_decontam.brute([(0, text)], [(1, " ".join(item).encode())])[0]
    assert int(hit.sum()) == want[2] and (found == ["1"]) == want[5]


@given(st.permutations(range(8)), st.permutations(range(8)))
def test_footrule_is_the_sum_of_moves(a, b):
    d = op2_permutation.footrule(np.array(a), np.array([b]), 8)[0]
    assert d == sum(abs(a.index(x) - b.index(x)) for x in range(8))


@given(st.lists(st.text(max_size=20), max_size=5))
def test_extraction_keeps_plain_paragraphs(parts):
    page = "<article>" + "".join(f"<p>{html.escape(x)}</p>" for x in parts) + "</article>"
    lines = [" ".join(html.unescape(html.escape(x)).split()) for x in parts]
    model = op10_html.Model([])
    model.weights = {"article": -5.0, "/article": -5.0, "p": -0.05, "/p": -0.05}
    assert op10_html.extract(page, model).split("\n") == ([x for x in lines if x] or [""])
