"""Conversations as ordered streams: ordinary ones whole within a task, long ones in parts.

A conversation of at most ``LONG`` rows is dealt by its id and streamed in
order. One with more, be it a third of the table, is dealt by ranges of
(turn, role, digest of the text) and cut into parts of at most ``LONG`` rows,
which carry a number that follows the order. Rows that are equal in everything
are spread too, as it does not matter which comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import buckets, checkpointed

LONG = 4096
#: Bytes of text after which a part ends too.
HEAVY = 1 << 22


def order() -> list:
    """Rows of a conversation: by turn (nulls first), then role, then SHA-256 of the text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.sha2("text", 256)]


def divide(spark: SparkSession, rows: DataFrame, long: int = LONG) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary conversations, and those of long ones (None: there are none)."""
    over = checkpointed(spark, rows.groupBy("conv_id").count().filter(F.col("count") > long).select(F.col("conv_id").alias("_long")))
    if over.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return rows.join(over, same, "left_anti"), rows.join(over, same, "left_semi")


def dealt(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Ordinary conversations, each whole and in order within a partition."""
    return rows.repartition(buckets(spark), "conv_id").sortWithinPartitions("conv_id", *order())


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, its rows without the id) of partitions as ``dealt`` makes them."""
    at, held = None, None
    for b in batches:
        for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
            if held is None or conv != at:
                if held is not None:
                    yield at, held
                at, held = conv, []
            held.append(tuple(row))
    if held is not None:
        yield at, held


def parts(spark: SparkSession, rows: DataFrame, each: Callable[[list[tuple]], list[dict]], struct: str, long: int = LONG) -> DataFrame:
    """Long conversations' rows as parts (conv_id, at, rows): ``at`` is unique and follows the order; ``each`` makes structs of some rows."""
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col("conv_id").asc_nulls_first(), *order(), F.col("_tie")]
    ordered = keyed.repartitionByRange(buckets(spark), *by).sortWithinPartitions(*by).drop("_tie")
    kind = pa.list_(struct_type(struct))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, conv, held, size = TaskContext.get().partitionId() << 32, 0, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([conv], pa.int64()), pa.array([base + k], pa.int64()), pa.array([each(held)], kind)], ["conv_id", "at", "rows"])

        for b in batches:
            for own, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (own != conv or len(held) >= long or size > HEAVY):
                    yield out()
                    k, held, size = k + 1, [], 0
                conv = own
                held.append(tuple(row))
                size += len(row[2] or "")
        if held:
            yield out()

    return checkpointed(spark, ordered.mapInArrow(cut, f"conv_id long, at long, rows array<struct<{struct}>>"))


def struct_type(struct: str) -> pa.DataType:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.struct([(n, kinds[t]) for n, t in (x.strip().split(":") for x in struct.split(","))])
