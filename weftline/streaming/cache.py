"""A cache whose entries expire, as tables: every get answered, hits counted, and kept up over a stream.

A request has a ``key``, an ``op`` (set, get or delete; others are ignored), a
time ``ts``, a ``seq`` that orders equal times, a ``value`` and a ``ttl`` in
seconds (null: the default). A get hits if the last write of its key before it
is a set that is younger than its time to live. Requests without a key or a
time are ignored.

A key may have most of the rows, so its history is cut into slices of time:
the last write of each slice is found first, carried to the key's next slices,
and each slice is then answered by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources import versions

TTL = 3600
SLICE = 3600
WRITE = "struct<op string, at timestamp, seq bigint, value string, ttl bigint>"


def key(prefix: str, *args: str | Column) -> Column:
    """``prefix:`` and the MD5 of the arguments joined by colons; a null argument counts as left out."""
    return F.concat(F.lit(prefix + ":"), F.md5(F.concat_ws(":", *args)))


def _requests(rows: DataFrame, ttl: int, seconds: int) -> DataFrame:
    write = F.struct("op", F.col("ts").alias("at"), "seq", F.col("value").cast("string").alias("value"), F.coalesce(F.col("ttl"), F.lit(ttl)).cast("long").alias("ttl")).cast(WRITE)
    own = rows.filter(F.col("op").isin("set", "get", "delete") & F.col("key").isNotNull() & F.col("ts").isNotNull())
    return own.select("key", "op", "ts", F.col("seq").cast("long").alias("seq"), F.floor(F.unix_seconds("ts") / seconds).cast("long").alias("slice"), F.when(F.col("op") != "get", write).alias("write"))


def _last(write: str = "write") -> Column:
    order = F.struct(F.col(f"{write}.at"), F.col(f"{write}.seq"))
    return F.max_by(write, F.when(F.col(write).isNotNull(), order))


def lookups(requests: DataFrame, ttl: int = TTL, entries: DataFrame | None = None, seconds: int = SLICE) -> DataFrame:
    """One row for each get: key, ts, seq, ``hit`` and the ``value`` found. ``entries`` (key, write) are what the cache held before."""
    r = _requests(requests, ttl, seconds)
    slices = r.groupBy("key", "slice").agg(_last().alias("write"))
    if entries is not None:
        held = entries.select("key", F.lit(-(2**62)).alias("slice"), F.col("write").cast(WRITE).alias("write"))
        slices = slices.unionByName(held)
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("key", "slice", F.last("write", True).over(before).alias("write")).filter("write IS NOT NULL")
    rows = r.unionByName(carried, allowMissingColumns=True)
    # a carried write has no time of its own, so it comes first
    past = Window.partitionBy("key", "slice").orderBy(F.col("ts").asc_nulls_first(), F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("found", F.last("write", True).over(past)).filter("op = 'get'")
    alive = F.col("ts") < F.col("found.at") + F.make_dt_interval(secs=F.col("found.ttl").cast("decimal(18,6)"))
    hit = F.coalesce((F.col("found.op") == "set") & alive, F.lit(False))
    return found.select("key", "ts", "seq", hit.alias("hit"), F.when(hit, F.col("found.value")).alias("value"))


def entries(requests: DataFrame, ttl: int = TTL) -> DataFrame:
    """The last write of each key, merged in slices first: (key, write)."""
    r = _requests(requests, ttl, SLICE).filter("write IS NOT NULL")
    return r.groupBy("key", "slice").agg(_last().alias("write")).groupBy("key").agg(_last().alias("write"))


def alive(at: Column) -> Column:
    """Whether an entry can still be hit at a time."""
    return (F.col("write.op") == "set") & (at < F.col("write.at") + F.make_dt_interval(secs=F.col("write.ttl").cast("decimal(18,6)")))


def stats(answers: DataFrame, *by: str | Column) -> DataFrame:
    """Hits, misses and the hit rate in percent with two decimals, 0 without gets."""
    n = answers.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return n.withColumn("hit_rate", F.when(total == 0, 0.0).otherwise(F.round(F.try_divide(F.col("hits"), total) * 100, 2)))


def serve(requests: DataFrame, answers_at: str, entries_at: str, ttl: int = TTL):
    """A query that answers a stream of requests into one table and keeps the cache's entries in another, both kept by version.

    Each batch is answered as a whole against the entries left by the ones
    before, so a key with most of a batch's rows is cut into slices there too.
    Entries that had expired by the newest request of the batch are dropped when
    their bucket is rewritten. A batch that is repeated after a failure at any
    step changes nothing: its answers are written first, by its number, and the
    entries it would answer from then are used by nobody. Start it with ``.start()``.
    """

    def answer(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            held = versions.read(batch.sparkSession, entries_at, f"key string, write {WRITE}")
            held = held.join(batch.select("key").distinct(), "key", "left_semi")
            versions.append(lookups(batch, ttl, held), answers_at, ["key", "seq"], ("cache", number))
            newest = batch.agg(F.max("ts")).first()[0]
            if newest is not None:
                last = entries(batch, ttl).join(held.withColumnRenamed("write", "old"), "key", "left")
                last = last.filter(F.col("old").isNull() | (F.struct("write.at", "write.seq") >= F.struct("old.at", "old.seq")))
                versions.upsert(last.select("key", "write"), entries_at, "key", ("cache", number), keep=alive(F.lit(newest)))
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(answer)
