"""Session helpers: a tuned builder and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGES: dict[str, list[str]] = {}


def build_session(app_name: str = "veracol", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps, exact header names and Arrow transfer."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.caseSensitive": "true",  # headers that differ by case are different columns
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own, because a machine-local path is useless to remote executors.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="veracol-checkpoint-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared scratch folder and read them back.

    Later jobs read a columnar table instead of repeating the shuffles before it, and a lost
    executor costs them nothing but the tasks it was running.
    """
    spark = df.sparkSession
    if any(part in df.schema.simpleString() for part in ("void", "interval", "variant")):
        scratch_root(spark)
        return df.checkpoint(eager=True)  # types a Parquet table cannot hold
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession) -> int:
    """Delete the tables ``cut_lineage`` wrote in this application; frames built on them end with it."""
    paths = _STAGES.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
