"""Histograms, alerts that must hold and the expiring cache, against brute force, cut into batches, and killed."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import versions
from weftline.streaming import alerts, cache
from weftline.streaming import histograms as h

BOUNDS = (-1.0, 0.0, 0.5, 2.0, 10.0)
VALUES = "g string, shard int, value double"


def files_in_order(df, at, order, n):
    """The rows in n files, one a trigger, by time."""
    rows = df.orderBy(order).collect()
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{at}/in/{i:03d}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")


def by_hand(values, q):
    """The quantile by a walk over the buckets."""
    seen = [v for v in values if v is not None]
    counts = [sum(v <= b for v in seen) for b in BOUNDS] + [len(seen)]
    if not seen:
        return counts, None
    for i, (c, up) in enumerate(zip(counts, BOUNDS)):
        if c and c >= q * len(seen):
            lo, before = (BOUNDS[i - 1], counts[i - 1]) if i else (min(0.0, up), 0)
            return counts, lo + (up - lo) * (q * len(seen) - before) / (c - before)
    return counts, BOUNDS[-1]


def test_histograms_merge_and_interpolate(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(4), rng.choice([rng.uniform(-3, 20), rng.uniform(0, 1), 0.0, 0.5, 10.0, math.inf, -math.inf, math.nan, None])) for _ in range(600)]
    rows += [("nulls", 0, None), ("high", 0, 99.0), ("low", 1, -5.0), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, VALUES)
    qs = (0.0, 0.25, 0.5, 0.95, 1.0)
    whole = h.quantiles(h.observe(df, BOUNDS, "g"), BOUNDS, qs).collect()
    merged = h.quantiles(h.merge(h.observe(df, BOUNDS, "g", "shard"), BOUNDS, "g"), BOUNDS, qs).collect()
    assert len(whole) == 7
    for got in (whole, merged):
        for r in got:
            values = [v for g, _, v in rows if g == r.g]
            for q in qs:
                counts, want = by_hand(values, q)
                assert r.buckets == counts and r.n == counts[-1]
                assert r[f"p{q * 100:g}"] == (None if want is None else pytest.approx(want, abs=1e-12)), (r.g, q)


def test_histograms_without_rows_and_wrong_arguments(spark):
    empty = spark.createDataFrame([], VALUES)
    assert h.quantiles(h.observe(empty, BOUNDS, "g"), BOUNDS).collect() == []
    assert h.observe(empty, BOUNDS).first().buckets == [0] * 6
    assert h.quantiles(h.observe(empty, BOUNDS), BOUNDS).first().p50 is None
    for wrong in ((), (1.0, 1.0), (2.0, 1.0), (1.0, math.inf)):
        with pytest.raises(ValueError):
            h.observe(empty, wrong)
    with pytest.raises(ValueError):
        h.quantile(F.col("buckets"), BOUNDS, 1.5)


def test_a_stream_of_histograms_keeps_the_open_windows_and_survives_a_kill(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(1_700_000_000 + rng.randrange(20_000), rng.choice("ab"), rng.uniform(0, 12)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s long, g string, value double").select(F.timestamp_seconds("s").alias("ts"), "g", "value")
    stream = h.windowed(files_in_order(df, tmp_path, "ts", 3), BOUNDS, "1 hour", None, "g", late="10 minutes")
    at, calls = str(tmp_path / "out"), []

    def die(name):
        calls.append(name)
        if len(calls) == 4:  # the second batch, before its version counts
            raise RuntimeError("killed")

    monkeypatch.setattr(versions, "step", die)
    run = lambda: h.follow(stream, at, "start", "g").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    key = lambda d: sorted((r.start, r.g, r.buckets) for r in d.collect())
    assert key(versions.read(spark, at)) == key(h.windowed(df, BOUNDS, "1 hour", None, "g"))


def dense(rows, rule):
    """Every step evaluated: [label, pending, firing, resolved]."""
    out, last = [], max(t for _, t in rows) + rule.short + 2 * rule.step
    for label in sorted({x for x, _ in rows}, key=str):
        ends = [t // rule.step * rule.step + rule.step for x, t in rows if x == label]
        n = lambda lo, hi: sum(lo < e <= hi for e in ends)
        since = None
        for t in range(min(ends) // rule.step * rule.step, last, rule.step):
            past = t - rule.offset
            on = n(t - rule.short, t) > 0 and n(-math.inf, past) > 0 and n(t - rule.short, t) * rule.long > rule.factor * n(past - rule.long, past) * rule.short
            if on and since is None:
                since = t
            elif not on and since is not None:
                out.append((label, since, since + rule.hold if t > since + rule.hold else None, t))
                since = None
    return out


RULE = alerts.Rule(short=180, long=600, offset=600, factor=2.0, hold=120)


def bursts(seed, n=250, span=9000):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        label, at = rng.choice(["a", "b", "c", None]), rng.randrange(span)
        out += [(label, 1_700_000_000 + at + rng.randrange(90)) for _ in range(rng.choice([1, 1, 1, 6]))]
    return out


def timed(spark, rows):
    return spark.createDataFrame(rows, "event_type string, s long").select("event_type", F.timestamp_seconds("s").alias("ts"), F.lit("other").alias("label"), F.lit(1).alias("tick"))


def spans(df):
    seconds = [F.unix_seconds(c).alias(c) for c in ("pending", "firing", "resolved")]
    return sorted(((r[0], r[1], r[2], r[3]) for r in df.select("event_type", *seconds).collect()), key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_sustained_alerts_equal_the_dense_evaluation(spark, seed):
    rows = bursts(seed, 60 if seed == 3 else 250)
    want = sorted(dense(rows, RULE), key=str)
    assert any(f for _, _, f, _ in want) and any(f is None for _, _, f, _ in want)
    assert spans(alerts.sustained(timed(spark, rows + [("a", None)]), RULE)) == want


def test_an_alert_fires_after_the_hold_and_not_before(spark):
    rule = alerts.Rule()
    t0 = 1_700_000_400 // 60 * 60
    calm = [("x", t0 + 60 * i) for i in range(60)]  # one a minute, an hour long
    burst = lambda minutes: [("x", t0 + 7200 + 60 * m + s) for m in range(minutes) for s in range(30)]
    for minutes, fires in ((5, False), (9, True)):
        got = spans(alerts.sustained(timed(spark, calm + burst(minutes)), rule))
        assert got == sorted(dense(calm + burst(minutes), rule), key=str)
        assert any(f for _, _, f, _ in got) == fires
    assert alerts.sustained(timed(spark, []), rule).collect() == []
    for wrong in ({"short": 90}, {"step": 0}, {"long": 0}, {"hold": -60}):
        with pytest.raises(ValueError):
            alerts.Rule(**wrong)


@pytest.mark.parametrize("seed", range(20))
def test_a_label_advanced_in_any_cuts_gives_the_same_transitions(seed):
    rng = random.Random(seed)
    rows = [(label or "a", t) for label, t in bursts(seed, 40) if label in ("a", None)]
    want = []
    for _, pending, firing, resolved in dense(rows, RULE):
        want += [(pending, "pending")] + ([(firing, "firing"), (resolved, "resolved")] if firing else [(resolved, "cancelled")])
    end = max(t for _, t in rows) + 4000
    cuts = sorted(rng.sample(range(min(t for _, t in rows), end), 12)) + [end]
    state, got, wake, ticks = ([], [], None, -(2**62), None, False), [], None, {}
    for _, t in rows:
        ticks[t // 60 * 60 + 60] = ticks.get(t // 60 * 60 + 60, 0) + 1
    for cut in cuts:
        new = [t for t in ticks if state[3] < t <= cut]
        if state[2] is None and not new:
            continue
        if not new and (wake is None or wake > cut):
            continue  # its timer would not ring
        first = min(new) if state[2] is None else state[2]
        out, state, wake = alerts.advance(RULE, (state[0] + new, state[1] + [ticks[t] for t in new], first, *state[3:]), cut)
        got += out
        assert all(t > cut - RULE.offset - RULE.long for t in state[0])
    assert got == want


def test_a_stream_of_alerts_equals_the_batch_up_to_its_watermark(spark, tmp_path):
    rows = bursts(5)
    df = timed(spark, rows)
    out = alerts.watch(files_in_order(df, tmp_path, "ts", 4), RULE, late="5 minutes")
    at = str(tmp_path / "out")
    out.writeStream.format("parquet").option("path", at).option("checkpointLocation", at + "-state").trigger(availableNow=True).start().awaitTermination()
    key = lambda d: sorted(((r.event_type, r.at, r.state) for r in d.collect()), key=str)
    mark = max(t for _, t in rows) - 300
    want = key(alerts.transitions(alerts.sustained(df, RULE)).filter(F.unix_seconds("at") <= mark))
    assert {s for _, _, s in want} == {"pending", "firing", "resolved", "cancelled"}
    assert key(spark.read.parquet(at)) == want


REQUESTS = "key string, op string, s long, seq long, value string, ttl long"


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUESTS).select("key", "op", F.timestamp_seconds("s").alias("ts"), "seq", "value", "ttl", F.lit("x").alias("write"), F.lit(0).alias("slice"))


def calls(seed, n=800):
    """A third of all requests name one key."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", *"abcd"]), rng.choice(["get", "get", "get", "set", "delete"]), 1_700_000_000 + rng.randrange(30_000), i, f"v{i}" if i % 7 else None, rng.choice([None, None, 60, 5000, 0])) for i in range(n)]


def simulated(rows, ttl):
    held, out = {}, []
    for key, op, t, seq, value, own in sorted(rows, key=lambda r: (r[2], r[3])):
        if op == "set":
            held[key] = (value, t + (ttl if own is None else own))
        elif op == "delete":
            held.pop(key, None)
        else:
            hit = key in held and t < held[key][1]
            out.append((seq, key, hit, held[key][0] if hit else None))
    return sorted(out)


def answered(df):
    return sorted((r.seq, r.key, r.hit, r.value) for r in df.collect())


@pytest.mark.parametrize("seconds", [10, 900, 10**6])
def test_lookups_equal_a_simulation_whatever_the_slice(spark, seconds):
    rows = calls(6)
    want = simulated(rows, 1000)
    assert {hit for _, _, hit, _ in want} == {True, False}
    odd = [("a", "touch", 1_700_000_001, 9001, "?", None), (None, "get", 1_700_000_001, 9002, None, None), ("a", "set", None, 9003, "?", None), ("a", None, 1_700_000_002, 9004, "?", None)]
    assert answered(cache.lookups(requests(spark, rows + odd), 1000, seconds=seconds)) == want


def test_cache_statistics_and_keys(spark):
    rows = calls(7, 60)
    want = simulated(rows, 1000)
    s = cache.stats(cache.lookups(requests(spark, rows), 1000)).first()
    hits = sum(h for _, _, h, _ in want)
    assert (s.hits, s.misses, s.hit_rate) == (hits, len(want) - hits, round(100 * hits / len(want), 2))
    none = cache.stats(cache.lookups(requests(spark, []))).first()
    assert (none.hits, none.misses, none.hit_rate) == (0, 0, 0.0)
    assert spark.range(1).select(cache.key("p", F.lit("a"), F.lit("b"))).first()[0] == "p:" + hashlib.md5(b"a:b").hexdigest()


@pytest.mark.parametrize("dies", [None, 3, 6, 7])
def test_a_served_stream_equals_the_simulation_and_survives_kills(spark, tmp_path, monkeypatch, dies):
    rows = calls(8, 300)
    stream, count = files_in_order(requests(spark, rows), tmp_path, ["ts", "seq"], 3), []

    def die(name):
        count.append(name)
        if len(count) == dies:
            raise RuntimeError("killed")

    monkeypatch.setattr(versions, "step", die)
    at, held = str(tmp_path / "answers"), str(tmp_path / "entries")
    run = lambda: cache.serve(stream, at, held, 1000).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    if dies:
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert answered(versions.read(spark, at)) == simulated(rows, 1000)
    assert {r.key for r in versions.read(spark, held).collect()} <= {r[0] for r in rows}


def test_expired_entries_are_dropped(spark, tmp_path):
    old = [(f"k{i}", "set", 1_700_000_000, i, "v", 60) for i in range(50)]
    new = [(f"n{i}", "set", 1_700_009_000, 100 + i, "v", 60) for i in range(50)]
    stream = files_in_order(requests(spark, old + new), tmp_path, ["ts", "seq"], 2)
    cache.serve(stream, str(tmp_path / "a"), str(tmp_path / "e")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    left = {r.key for r in versions.read(spark, str(tmp_path / "e")).collect()}
    assert {f"n{i}" for i in range(50)} <= left and not any(k.startswith("k") for k in left)
