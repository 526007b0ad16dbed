"""op11 against brute force in plain integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import op11_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, n long"


def brute(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label)."""
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % 4 == 0]
    sizes = Counter(len(v) for _, v, _ in good)
    if not sizes:
        return []
    n = min(sizes, key=lambda k: (-sizes[k], k))
    good = sorted((r for r in good if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = n // 4
    cut = lambda v: [v[k * d : (k + 1) * d] for k in range(4)]
    books = [[cut(v)[k] for _, v, _ in good[:entries]] for k in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            own = {}
            for _, v, _ in good:
                own.setdefault(near(cut(v)[k], books[k])[1], []).append(cut(v)[k])
            books[k] = [[sum(c) // len(own[j]) for c in zip(*own[j])] if j in own else e for j, e in enumerate(books[k])]
    found = [(i, [near(cut(v)[k], books[k]) for k in range(4)], y) for i, v, y in good]
    total = Counter()
    for _, f, y in found:
        total[y] += sum(e for e, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in f), sum(e for e, _ in f), total[y], sha) for i, f, y in found]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "c", 5, 5) for r in rows], SCHEMA).repartition(3)
    return op11_codes.compress(spark, df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()


def test_codes_equal_brute_force_on_awkward_vectors(spark):
    r = random.Random(3)
    vector = lambda d=8: [r.choice([r.gauss(0, 0.3), -0.5, 0.25]) for _ in range(d)]
    rows = [(i, vector(), r.choice([0, 0, 0, 1, None])) for i in range(400)]
    rows += [(i, list(rows[3][1]), 2) for i in range(400, 480)]  # copies
    rows += [(5, vector(), 1), (None, vector(), 1), (None, vector(), None), (7, None, 1), (8, [], 1), (9, [0.1, None] * 4, 1), (10, [math.nan] * 8, 1), (11, [math.inf] * 8, 1), (12, [0.5] * 4, 1), (13, [0.5] * 7, 1), (14, [0.0] * 8, 1)]
    assert ordered(run(spark, rows)) == ordered(brute(rows))


def test_few_vectors_no_vectors_and_rare_labels(spark):
    rows = [(i, [float(i % 3), 0.5, -0.001, 1.0], i) for i in range(20)]
    assert ordered(run(spark, rows)) == ordered(brute(rows))
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [math.nan] * 4, 1)]) == []


@pytest.mark.parametrize("size", [3, 600, 1 << 20, op11_codes.EDGE])
def test_screening_is_exact_where_float32_is_not(size):
    """Entries a few units apart, far from zero: float32 cannot tell them, the intervals keep them."""
    g = np.random.default_rng(size)
    base = g.integers(-size, size + 1, (1, 16))
    book = np.clip(base + g.integers(-2, 3, (256, 16)), -op11_codes.EDGE, op11_codes.EDGE)
    book[100:140] = book[7]
    x = np.clip(base + g.integers(-3, 4, (2500, 16)), -op11_codes.EDGE, op11_codes.EDGE)
    exact = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    at, error = op11_codes.nearest(x, book)
    assert (at == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()


def test_components_saturate(spark):
    rows = [(1, [3.0e38, 0.0, 0.0, 0.0], 1), (2, [-3.0e38, 0.0, 0.0, 0.0], 1)]
    got = run(spark, rows)
    assert sorted(r.vec_id for r in got) == [1, 2] and all(r.error == 0 for r in got)


def test_vectors_of_doubles_and_of_integers(spark):
    rows = [(i, [i * 0.125, 1.0 - i, 0.0, 2.0]) for i in range(30)]
    doubles = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id int, embedding array<double>, label string").withColumn("label", F.lit(None).cast("string"))
    assert ordered(r[:5] for r in op11_codes.compress(spark, doubles).collect()) == ordered(brute([(i, v, None) for i, v in rows]))
    whole = spark.createDataFrame([(i, [i, 0, 1, 2], 1) for i in range(9)], "vec_id int, embedding array<int>, label int")
    assert ordered(r[:5] for r in op11_codes.compress(spark, whole).collect()) == ordered(brute([(i, [i, 0, 1, 2], 1) for i in range(9)]))
