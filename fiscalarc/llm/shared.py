"""Tables and files between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, lineage cut."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(spark: SparkSession, label: str) -> tuple[str, str]:
    """A fresh folder for raw files: its address for Spark, and its path on every machine.

    Tasks write raw files there with ``open``, so the shared folder must be mounted (``file:``).
    """
    uri = work_dir(spark, label)
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"raw files need spark.checkpoint.dir on a mounted folder, not {uri}")
    return uri, unquote(parts.path)


#: rows of whole texts that a worker gets at once; more only costs memory
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read in small batches by workers that can import this package."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A join side of narrow rows: broadcast if it has at most ``rows`` of them, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df
