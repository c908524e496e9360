"""Readers, writers and checks between source files and governed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import pick
from .rules import ZONES
from .schemas import landed


def read_canonical(spark: SparkSession, path: str, table: str,
                   columns: list[str] | None = None) -> DataFrame:
    """Scan one governed table with its explicit schema, reading only the named columns."""
    df = spark.read.schema(landed(table)).parquet(f"{path.rstrip('/')}/{table}.parquet")
    return df.select(*columns) if columns else df


def import_tabular(spark: SparkSession, path: str, mapping: dict[str, tuple[str, str]],
                   rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Import CSV files: detect columns, map and cast them, split valid from rejected rows.

    ``mapping`` is source column -> (canonical name, type); a value that does not cast is rejected,
    and so is a row with more or fewer fields than the header. Rejected rows keep their source line
    in ``_line``, so they can be corrected and imported again with ``replay``.
    """
    header = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path).columns
    missing = [c for c in mapping if c not in header]
    if missing:
        raise ValueError(f"columns not found in the file: {missing}")
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_ragged").schema(_fields(header)).csv(path))
    return _typed(raw, mapping, rules)


def replay(rejected: DataFrame, header: list[str], mapping: dict[str, tuple[str, str]],
           rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Import corrected source lines (column ``_line``, fields in the order of ``header``)."""
    parsed = F.from_csv("_line", _fields(header).toDDL(), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_ragged"})
    return _typed(rejected.select(parsed.alias("_r")).select("_r.*"), mapping, rules)


def _fields(header: list[str]) -> T.StructType:
    """Text fields, and one for the line of a row whose field count is wrong."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_ragged"]])


def _typed(raw: DataFrame, mapping: dict[str, tuple[str, str]], rules: dict[str, Column]
           ) -> tuple[DataFrame, DataFrame]:
    from ..operators.filters import quarantine

    fields = [c for c in raw.columns if c != "_ragged"]
    line = F.coalesce("_ragged", F.to_csv(F.struct(*[F.col(f"`{c}`") for c in fields])))
    typed = raw.select(*[
        F.expr(f"try_cast(`{src}` AS {kind})").alias(name) for src, (name, kind) in mapping.items()],
        F.array_compact(F.array(*[
            F.when(F.col(f"`{src}`").isNotNull() & F.expr(f"try_cast(`{src}` AS {kind})").isNull(),
                   F.lit(f"{name}: not {kind}")) for src, (name, kind) in mapping.items()]))
        .alias("_cast"), F.col("_ragged").isNotNull().alias("_count"), line.alias("_line"))
    ok, bad = quarantine(typed, {"wrong number of fields": F.col("_count"),
                                 "unreadable value": F.size("_cast") > 0, **rules})
    return ok.drop("_cast", "_count", "_line"), bad.drop("_count")


def preview(df: DataFrame, rows: int = 20) -> list:
    """The first rows of an import, shown before it is accepted."""
    return df.limit(rows).collect()


def import_api_payload(payloads: DataFrame, column: str, schema: str) -> DataFrame:
    """Landed JSON payloads to typed rows; an unreadable payload keeps its row with nulls."""
    return payloads.withColumn("_p", F.from_json(column, schema)).select(
        *[c for c in payloads.columns if c != column], "_p.*")


def apply_cdc(base: DataFrame, changes: DataFrame, keys: list[str], order: str,
              op: str = "op") -> DataFrame:
    """Apply an insert / update / delete feed: the last change per key wins, deletes are removed."""
    columns = base.columns
    start = base.withColumn(op, F.lit("I")).withColumn(order, F.lit(None).cast(
        changes.schema[order].dataType))
    feed = start.unionByName(changes.select(*columns, op, order))
    ranked = feed.withColumn("_at", F.struct(F.col(order).isNotNull(), F.col(order)))
    last = pick(ranked, keys, F.col("_at"))
    return last.filter(F.col(op) != "D").select(*columns)


def read_events(spark: SparkSession, path: str, schema: str | None = None,
                servers: str | None = None) -> DataFrame:
    """Event stream from files, or from a broker topic when ``servers`` is given (see ``decode_events``)."""
    if servers:
        raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
               .option("subscribe", path).load())
        return decode_events(raw, schema or landed("events"))
    reader = spark.readStream.schema(schema or landed("events"))
    if not _is_folder(spark, path):  # a stream source watches folders: watch the file's own
        folder, _, name = path.rpartition("/")
        reader, path = reader.option("pathGlobFilter", name), folder
    stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def decode_events(raw: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Events from broker records (``value``: JSON in bytes) with the columns of ``schema``, ``ts`` as a
    timestamp, and ``malformed``: the text of a record that is not such an event, null for the others.
    A malformed record has nulls in all other columns and is never dropped."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = T.StructType([*fields.fields, T.StructField("malformed", T.StringType())])
    text = F.col("value").cast("string")
    event = F.from_json(text, wanted, {"columnNameOfCorruptRecord": "malformed", "mode": "PERMISSIVE"})
    rows = raw.select(event.alias("e"), text.alias("_text")).select("e.*", "_text")
    bad = F.coalesce("malformed", F.when(F.col("_text").isNull() | (F.trim("_text") == ""), F.coalesce("_text", F.lit(""))))
    return rows.select(*[F.when(bad.isNull(), F.col(f.name).cast("timestamp") if f.name == "ts" else F.col(f.name))
                         .alias(f.name) for f in fields], bad.alias("malformed"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(target).isDirectory()


def read_documents(df: DataFrame, text: str, key: str) -> DataFrame:
    """Document rows with content hash and size."""
    return df.withColumnRenamed(key, "document_id").withColumn(
        "hash", F.sha2(F.col(text), 256)).withColumn("n_bytes", F.octet_length(text))


def read_document_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Text files as documents: one row per file with path, time, size and hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"),
                        F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("hash"),
                        F.col("content").cast("string").alias("text"))


def promote_zone(df: DataFrame, root: str, dataset: str, zone: str,
                 partition_cols: list[str]) -> str:
    """Write a dataset into a zone. The raw zone only grows; later zones are rebuilt from it."""
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone}")
    target = f"{root.rstrip('/')}/{zone.lower()}/{dataset}"
    mode = "append" if zone in ("LANDING", "RAW") else "overwrite"
    df.write.mode(mode).partitionBy(*partition_cols).parquet(target)
    return target


def export_dataset(df: DataFrame, fmt: str, path: str, validated: Column,
                   rows_per_file: int = 5_000_000, partition_cols: list[str] = ()) -> str:
    """Export validated rows as csv, json or parquet in files of bounded length."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {fmt}")
    writer = df.filter(validated).write.mode("errorifexists").option(
        "maxRecordsPerFile", rows_per_file)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.format(fmt).save(path)
    return path


def backfill_year(df: DataFrame, year: int, path: str) -> None:
    """Load one past fiscal year; running it again replaces that year and nothing else."""
    (df.filter(F.col("fiscal_year") == year).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("fiscal_year").parquet(path))


def check_contract(df: DataFrame, contract: dict) -> DataFrame:
    """One verdict row per clause: schema, quality, freshness, version. One pass over the data.

    ``contract``: columns {name: type}, not_null [names], fresh (column, earliest newest date),
    version (column, expected).
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = sorted(n for n, k in contract["columns"].items() if actual.get(n) != k)
    fresh_col, fresh_min = contract["fresh"]
    version_col, version = contract["version"]
    facts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in contract["not_null"]],
        F.max(fresh_col).cast("date").alias("_newest"),
        F.count_if(~(F.col(version_col) == F.lit(version))).alias("_other"))
    def clause(name, passed, observed):
        return F.struct(F.lit(name).alias("clause"), passed.alias("passed"),
                        observed.cast("string").alias("observed"))
    rows = [clause("schema", F.lit(not wrong), F.lit(",".join(wrong))),
            *[clause(f"not_null:{c}", F.col(f"_null_{c}") == 0, F.col(f"_null_{c}"))
              for c in contract["not_null"]],
            clause("freshness", F.col("_newest") >= F.lit(fresh_min).cast("date"),
                   F.col("_newest")),
            clause("version", F.col("_other") == 0, F.col("_other"))]
    return facts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def check_metadata(catalog: DataFrame, asset: str,
                   required: tuple[str, ...] = ("source", "owner", "schema", "classification",
                                                "retention")) -> DataFrame:
    """Assets that lack required metadata, with the missing parts."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return (catalog.select(asset, missing.alias("_m")).filter(F.size("_m") > 0)
            .select(asset, F.array_join("_m", ",").alias("missing")))


def snapshot_as_of(history: DataFrame, when: str) -> DataFrame:
    """The table as it stood at a past date."""
    from ..functions.columns import holds_at
    return history.filter(holds_at(F.lit(when).cast("date")))


def dataset_fingerprint(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Row count and order-free content hash; equal rows in any order give equal hashes.

    Every value is written with its length in front, a null as a minus sign, so no two different
    rows read the same.
    """
    row = F.concat(*[F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"),
                                         F.col(c).cast("string")), F.lit("-")) for c in columns])
    part = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.sum(part).cast("string").alias("fingerprint"))


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append"
                  ) -> None:
    """Drain what a stream has now into Parquet files, then stop."""
    (stream.writeStream.format("parquet").outputMode(mode).option("path", target)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())
