"""Tables kept by version: a write is a new folder, and one small file, created once, makes it count.

Under a table's path, ``data/<write>/bucket=<k>/`` holds Parquet files and
``log/<version>`` a line of JSON: for each bucket the writes that make it up,
the table's schema, and the last transaction of each writer. Readers take the
highest complete line, so they see a write whole or not at all, whenever a job
dies; what a dead job left behind is never named by a line. The log file is
created without overwriting, so of two writers one fails, sees the other's
version and merges again.

Rows are dealt to buckets by their key. An append adds its write to the buckets
that its rows touch. An upsert writes its rows once, compares those buckets with
it, a few at a time, and rewrites of a bucket only the older rows that stay; a
bucket whose rows all stand already is left as it is, and its new files go. A
writer that gives a transaction (its name and a number that grows, such as the
batch id of ``foreachBatch``) and repeats it after a failure changes nothing.

Nothing shuffled here is read twice, so shuffle files are dropped with the job
that wrote them. Disk holds the table, the new rows and one shuffle at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.session import buckets as parts

BUCKETS, TRIES = 16, 8
#: Bytes of files whose buckets are compared in one job.
AT_ONCE = 1 << 27
EMPTY = {"version": 0, "schema": None, "key": None, "n_buckets": 0, "buckets": {}, "writers": {}, "unique": True}


class SchemaMismatch(ValueError):
    """The rows' columns are not the table's."""


class _Files:
    """The few file operations that are needed, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        at = self._path(name)
        size, stream = self.fs.getFileStatus(at).getLen(), self.fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode() if size else ""
        finally:
            stream.close()

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self._path(folder)).getLength()

    def delete(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)

    def create(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        try:
            out = self.fs.create(self._path(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True


def step(name: str) -> None:
    """Called before each step of a commit; tests make it fail."""


def current(spark: SparkSession, path: str) -> dict:
    """The state of the highest complete version."""
    return _state(_Files(spark, path))[0]


def _state(files: _Files) -> tuple[dict, int]:
    """The state, and the number after the highest log file, complete or not."""
    names = [n for n in files.names("log") if n.isdigit()]
    for n in reversed(names):
        line = files.read(f"log/{n}")
        if line.endswith("\n"):
            return json.loads(line), int(names[-1]) + 1
    return dict(EMPTY), int(names[-1]) + 1 if names else 1


def _load(spark: SparkSession, path: str, state: dict, buckets: Iterable[str]) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    paths = sorted({f"{path.rstrip('/')}/data/{w}/bucket={b}" for b in buckets for w in state["buckets"].get(b, [])})
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The table as of now; empty with the given schema if nothing was written yet."""
    state = current(spark, path)
    if state["schema"] is None:
        if schema is None:
            raise ValueError(f"no table at {path}")
        return spark.createDataFrame([], schema)
    return _load(spark, path, state, state["buckets"])


def _bucket(key: list[str], n: int):
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _checked(rows: DataFrame, state: dict, key: list[str]) -> DataFrame:
    """The rows with the table's columns in its order; anything missing, further or of another type is an error."""
    if state["schema"] is None:
        return rows
    want = StructType.fromJson(state["schema"])
    have = {f.name: f.dataType for f in rows.schema}
    wrong = [f.name for f in want if f.name not in have or have[f.name] != f.dataType] + [n for n in have if n not in want.names]
    if wrong:
        raise SchemaMismatch(f"columns differ from the table's: {', '.join(sorted(wrong))}")
    if state["key"] != key:
        raise SchemaMismatch(f"the table is keyed by {state['key']}")
    return rows.select(want.names)


def _nullable(schema: StructType) -> dict:
    out = schema.jsonValue()
    for f in out["fields"]:
        f["nullable"] = True
    return out


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs started meanwhile drop their shuffle files when they end, and not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _buckets_of(files: _Files, write: str) -> set[str]:
    return {x.split("=")[1] for x in files.names(f"data/{write}") if x.startswith("bucket=")}


def _write(dealt: DataFrame, path: str, key: list[str], write: str) -> None:
    """Rows by key, so that neighbours share their beginnings and files are small."""
    dealt.sortWithinPartitions("bucket", *key).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/data/{write}")


def _stage(rows: DataFrame, path: str, key: list[str], n: int, replace: bool) -> str:
    """Writes the rows to the folders of their buckets; each bucket is dealt over several tasks, so that none holds a whole one."""
    write, slices = uuid.uuid4().hex, max(1, parts(rows.sparkSession, 4) // n)
    dealt = rows.withColumn("bucket", _bucket(key, n) * slices + F.pmod(F.hash(*key), F.lit(slices))).repartition("bucket")
    if replace:
        dealt = dealt.dropDuplicates(["bucket", *key])  # within the slices they are written by: dealt once
    _write(dealt.withColumn("bucket", F.floor(F.col("bucket") / slices).cast("int")), path, key, write)
    return write


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def _merge(spark: SparkSession, files: _Files, state: dict, write: str, key: list[str], keep: Column | None) -> dict[str, list[str]]:
    """For each bucket of a staged write that has older rows, the writes that make it up from now on."""
    new, n = {b: [write] for b in _buckets_of(files, write)}, state["n_buckets"]
    out, left = {}, sorted((b for b in new if state["buckets"].get(b)), key=int)
    columns = StructType.fromJson(state["schema"]).names if left else []
    kinds = json.dumps(state["schema"])
    comparable = state.get("unique", False) and not any(k in kinds for k in ('"map"', '"variant"'))  # after appends a key may have several rows
    while left:
        group, size = [], 0
        while left and (not group or size < AT_ONCE):
            group.append(left.pop(0))
            size += sum(files.size(f"data/{w}/bucket={group[-1]}") for w in [write, *state["buckets"][group[-1]]])
        differ = set(group)
        if comparable:
            a, b = _load(spark, files.root, state | {"buckets": new}, group), _load(spark, files.root, state, group)
            other = a.join(b, _same(a, b, columns), "left_anti")
            differ = {str(r.bucket) for r in other.select(_bucket(key, n).alias("bucket")).distinct().collect()}  # at most as many as buckets
        out |= {b: state["buckets"][b] for b in group if b not in differ}
        if differ:
            a, b = _load(spark, files.root, state, differ), _load(spark, files.root, state | {"buckets": new}, differ).select(key)
            stay, rest = a.join(b, _same(a, b, key), "left_anti"), uuid.uuid4().hex
            stay = stay if keep is None else stay.filter(keep)
            _write(stay.withColumn("bucket", _bucket(key, n)), files.root, key, rest)
            some = _buckets_of(files, rest)
            out |= {b: [write, rest] if b in some else [write] for b in differ}
    return out


def _commit(rows: DataFrame, path: str, key: list[str], writer: tuple[str, int] | None, replace: bool, n_buckets: int, keep: Column | None = None) -> int:
    spark, path = rows.sparkSession, path.rstrip("/")
    files, write, dealt_to = _Files(spark, path), None, None
    for _ in range(TRIES):
        state, number = _state(files)
        if writer and state["writers"].get(writer[0], -1) >= writer[1]:
            return state["version"]
        own = _checked(rows, state, key)
        n = state["n_buckets"] or n_buckets
        step("write")
        with _shuffles_dropped(spark):
            if dealt_to != (n, own.columns):  # else written by a try before this one
                write, dealt_to = _stage(own, path, key, n, replace), (n, own.columns)
            written = _buckets_of(files, write)
            merged = _merge(spark, files, state, write, key, keep) if replace else {}
        buckets = {b: list(w) for b, w in state["buckets"].items()}
        for b in written:
            buckets[b] = merged[b] if b in merged else ([] if replace else buckets.get(b, [])) + [write]
        new = {"version": number, "schema": state["schema"] or _nullable(rows.schema), "key": key, "n_buckets": n, "buckets": buckets, "writers": state["writers"] | ({writer[0]: writer[1]} if writer else {}), "unique": replace and state.get("unique", False)}
        step("commit")
        if files.create(f"log/{number:012d}", json.dumps(new) + "\n"):
            for b in written:
                if write not in buckets[b]:
                    files.delete(f"data/{write}/bucket={b}")  # no line has named it
            return number
    raise RuntimeError(f"other writers kept changing {path}")


def upsert(rows: DataFrame, path: str, key: str | list[str], writer: tuple[str, int] | None = None, n_buckets: int = BUCKETS, keep: Column | None = None) -> int:
    """Inserts or replaces rows by key; returns the version. Of rows of one key any one stays. Rows that the table has already, equal in all columns, change nothing.

    Older rows that do not meet ``keep`` are dropped from the buckets that are rewritten anyway.
    """
    return _commit(rows, path, [key] if isinstance(key, str) else list(key), writer, True, n_buckets, keep)


def append(rows: DataFrame, path: str, key: str | list[str], writer: tuple[str, int] | None = None, n_buckets: int = BUCKETS) -> int:
    """Adds rows; the key only deals them to buckets."""
    return _commit(rows, path, [key] if isinstance(key, str) else list(key), writer, False, n_buckets)
