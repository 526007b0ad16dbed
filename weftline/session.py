"""Session factory and the one shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "weftline", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for.

    On a cluster pass your own session; nothing here is required but a UTC
    session time zone and adaptive execution, which is Spark's default.
    """
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests) a temporary folder is made and set as checkpoint folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(at)
        return at
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; unique, so that runs never collide."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so that a lost executor costs no more than a reread."""
    shared_dir(spark)
    return df.checkpoint()


def buckets(spark: SparkSession, each: int = 1) -> int:
    """Shuffle parts follow the session's setting, hence the cluster and the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * each


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Fewer rows in an Arrow batch than Spark's 10000, for tables whose rows are whole texts; a setting already lower stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
