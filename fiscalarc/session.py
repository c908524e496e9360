"""Spark session and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "fiscalarc", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job relies on; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        current = context._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="fiscalarc-", dir="/tmp")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is written yet."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df):
    """Reliable checkpoint, so that loops neither grow the plan nor lose work with an executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, label: str):
    """``df`` written as Parquet to the shared folder and read again: computed once, compressed."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark drops the shuffles of an execution when it ends
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freed(df, label: str):
    """``stored`` for large steps: in a tighter coding, and the shuffles behind it go as soon as it is written,
    not when the driver next collects its garbage."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, label)
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def dropped(*frames) -> None:
    """The files of ``freed`` frames that nothing reads any more are deleted."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
