"""Session helpers: a local session for tests, and fault-tolerant materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_fallback_dir: str | None = None


def local_session(cores: int | str = "*", app: str = "tabkit", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set (tests)."""
    global _fallback_dir
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if configured:
        return configured
    already_set = spark.sparkContext.getCheckpointDir()
    if already_set:
        return already_set
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="tabkit-")
    return _fallback_dir


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage so that a lost executor re-reads files instead of running
    the step again (which matters for steps that are not repeatable, such as a
    model call), and gives the planner real sizes to pick join strategies from.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tabkit", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the step folders that ``tables`` read; nothing may read them afterwards. Other files are left alone."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark._jvm.org.apache.hadoop.fs.Path
        steps = jvm(os.path.join(checkpoint_dir(spark), "tabkit"))
        files = steps.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if files.makeQualified(jvm(folder)).getParent().equals(files.makeQualified(steps)):
                files.delete(jvm(folder), True)
