"""Alerts that must hold: a rate against the same rate some time before, pending until it lasted, then firing.

At a time t that is a multiple of ``step``, with n(a, b] the events whose step
ended in (a, b]: the condition is n(t - short, t] / short > factor * n(t -
offset - long, t - offset] / long. A label that had no event by t - offset has
no past to compare with and never meets it; one that had, but none in the long
window, meets it with any event.

Both counts only change where a step of events enters or leaves a window, so a
step becomes four changes, running sums over the changes give the counts, and
nothing is evaluated in between. A label has four rows a step at most, however
many events it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """All in seconds and multiples of ``step``, but the factor."""

    short: int = 300
    long: int = 3600
    offset: int = 3600
    factor: float = 5.0
    hold: int = 600
    step: int = 60

    def __post_init__(self):
        spans = (self.short, self.long, self.offset, self.hold)
        if self.step <= 0 or min(spans) < 0 or not (self.short and self.long) or any(s % self.step for s in spans):
            raise ValueError("windows, offset and hold must be multiples of a positive step")


def _tick(rule: Rule):
    return (F.floor(F.unix_seconds("ts") / rule.step) * rule.step + rule.step).cast("long").alias("tick")


def steps(events: DataFrame, rule: Rule, label: str) -> DataFrame:
    """Events of each label and step: ``tick``, the step's end in seconds, and ``n``. A null time counts nowhere."""
    return events.filter("ts IS NOT NULL").groupBy(F.col(label).cast("string").alias("label"), _tick(rule)).agg(F.count("*").alias("n"))


def sustained(events: DataFrame, rule: Rule = Rule(), label: str = "event_type") -> DataFrame:
    """One row for each time the condition began: ``pending``, ``firing`` (null if it ended before) and ``resolved``, with both counts at the beginning."""
    x, n, no = steps(events, rule, label), F.col("n"), F.lit(0)
    moves = [(0, n, no, no), (rule.short, -n, no, no), (rule.offset, no, n, n), (rule.offset + rule.long, no, -n, no)]
    change = F.explode(F.array(*[F.struct((F.col("tick") + F.lit(d)).alias("at"), a.cast("long").alias("now"), b.cast("long").alias("base"), c.cast("long").alias("seen")) for d, a, b, c in moves]))
    at = x.select("label", change.alias("c")).select("label", "c.*").groupBy("label", "at").agg(*[F.sum(c).alias(c) for c in ("now", "base", "seen")])
    by = Window.partitionBy("label").orderBy("at")
    run = at.select("label", "at", *[F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("now", "base", "seen")])
    on = (F.col("now") > 0) & (F.col("seen") > 0) & (F.col("now") * rule.long > F.col("base") * rule.short * F.lit(float(rule.factor)))
    edges = run.withColumn("on", on).withColumn("was", F.lag("on", 1, False).over(by)).filter("on != was")
    spans = edges.withColumn("resolved", F.lead("at").over(by)).filter("on")
    began = F.col("at")
    return spans.select(
        F.col("label").alias(label),
        F.timestamp_seconds(began).alias("pending"),
        F.when(F.col("resolved") > began + rule.hold, F.timestamp_seconds(began + rule.hold)).alias("firing"),
        F.timestamp_seconds("resolved").alias("resolved"),
        "now",
        "base",
    )


def transitions(alerts: DataFrame, label: str = "event_type") -> DataFrame:
    """What a pager would see: (label, at, state) with state pending, firing, then resolved, or cancelled if it never fired."""
    end = F.when(F.col("firing").isNull(), "cancelled").otherwise("resolved")
    moves = F.array(F.struct(F.col("pending").alias("at"), F.lit("pending").alias("state")), F.struct(F.col("firing").alias("at"), F.lit("firing").alias("state")), F.struct(F.col("resolved").alias("at"), end.alias("state")))
    return alerts.select(label, F.explode(moves).alias("m")).select(label, "m.*").filter("at IS NOT NULL")


STATE = "ticks array<long>, counts array<long>, first long, done long, since long, fired boolean"


def _counts(ticks: np.ndarray, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Events of ticks in (lo, hi]."""
    return sums[np.searchsorted(ticks, hi, "right")] - sums[np.searchsorted(ticks, lo, "right")]


def advance(rule: Rule, state: tuple, upto: int) -> tuple[list[tuple[int, str]], tuple, int | None]:
    """Evaluates a label up to a time: its transitions, its next state, and when it has to be evaluated next without new events."""
    ticks, counts, first, done, since, fired = state
    order = np.argsort(np.asarray(ticks, "int64"), kind="stable")
    ticks, counts = np.asarray(ticks, "int64")[order], np.asarray(counts, "int64")[order]
    sums = np.concatenate([[0], np.cumsum(counts)])
    points = np.unique(np.concatenate([ticks + d for d in (0, rule.short, rule.offset, rule.offset + rule.long)]))
    due, later = points[(points > done) & (points <= upto)], points[points > max(done, upto)]
    now = _counts(ticks, sums, due - rule.short, due)
    base = _counts(ticks, sums, due - rule.offset - rule.long, due - rule.offset)
    met = (now > 0) & (first <= due - rule.offset) & (now * rule.long > base * rule.short * float(rule.factor))
    out = []
    for at, on in zip(due.tolist(), met.tolist()):
        if since is not None and not fired and since + rule.hold < at + on:  # at a tie the condition has to hold at that time too
            out.append((since + rule.hold, "firing"))
            fired = True
        if on and since is None:
            out.append((at, "pending"))
            since, fired = at, False
            if rule.hold == 0:
                out.append((at, "firing"))
                fired = True
        elif not on and since is not None:
            out.append((at, "resolved" if fired else "cancelled"))
            since, fired = None, False
    if since is not None and not fired and since + rule.hold <= upto:
        out.append((since + rule.hold, "firing"))
        fired = True
    done = max(done, upto)
    kept = ticks > done - rule.offset - rule.long
    wake = later[:1].tolist() + ([since + rule.hold] if since is not None and not fired else [])
    return out, (ticks[kept].tolist(), counts[kept].tolist(), first, done, since, fired), min(wake, default=None)


def _partial(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts within a batch of rows, before they are sent to their label's task."""
    for pdf in pdfs:
        yield pdf.groupby(["label", "tick"], dropna=False, sort=False).agg(us=("us", "max"), n=("us", "size")).reset_index()


def _watcher(rule: Rule):
    def handle(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ticks, counts, first, done, since, fired = state.get if state.exists else ([], [], None, -(2**62), None, False)
        held = dict(zip(ticks, counts))
        for pdf in pdfs if not state.hasTimedOut else ():
            for tick, n in zip(pdf["tick"].tolist(), pdf["n"].tolist()):
                held[tick] = held.get(tick, 0) + n
        first = min(held) if first is None else first
        mark = state.getCurrentWatermarkMs()
        out, kept, wake = advance(rule, (list(held), list(held.values()), first, done, since, fired), mark // 1000)
        state.update(kept)
        if wake is not None:
            state.setTimeoutTimestamp(max(wake * 1000 - 1, mark + 1))
        if out:
            yield pd.DataFrame({"label": [key[0]] * len(out), "at": [t for t, _ in out], "state": [s for _, s in out]})

    return handle


def watch(stream: DataFrame, rule: Rule = Rule(), label: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """``transitions`` of a stream, each sent once the watermark has passed its time; events later than that are not counted.

    Rows are counted by label and step within their own task first (an
    aggregation with state can't stand before this operator in append mode), so
    a frequent label sends counts and not events. The state holds the steps of
    the last offset + long, and wakes by an event-time timer when a count
    changes or a pending alert is due, so alerts fire and resolve without new
    events of the label. A label that was seen once keeps a state of a few
    numbers.
    """
    rows = stream.filter("ts IS NOT NULL").select(F.col(label).cast("string").alias("label"), _tick(rule), F.unix_micros("ts").alias("us"))
    counted = rows.mapInPandas(_partial, "label string, tick long, us long, n long").select("label", "tick", "n", F.timestamp_micros("us").alias("seen_at"))
    own = counted.withWatermark("seen_at", late).groupBy("label").applyInPandasWithState(_watcher(rule), "label string, at long, state string", STATE, "append", "EventTimeTimeout")
    return own.select(F.col("label").alias(label), F.timestamp_seconds("at").alias("at"), "state")
