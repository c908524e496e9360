"""The corpus pipeline: five stages over ``documents``, each on what the one before it kept.

All but the last return the columns of their input. A document is a ``doc_id``: rows that share one
are kept or go together, and rows without one are never rejected. Null and empty texts pass the
filters as their operators state. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalarc.llm import fmindex, jaccard, nnpu, packing, resampling
from fiscalarc.llm.queries import tokenizer_path
from fiscalarc.llm.shared import lookup, stored, table
from fiscalarc.scale import pick


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``doc_id`` is in ``rejected``."""
    ids = stored(rejected.select(F.col("doc_id").alias("rejected_id")).distinct(), "rejected")
    return docs.join(lookup(ids), docs["doc_id"] == ids["rejected_id"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    found = resampling.resample(docs, table(spark, sf_dir, "labels"))
    return _without(docs, found.filter("not kept"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    model = nnpu.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = nnpu.score(docs, model, F.col("doc_id").cast("long").alias("doc_id"))
    return _without(docs, scored.filter("predicted = 1"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest ``doc_id`` of every group of near copies, once: of rows that share it the first by
    text, language, source and length."""
    found, _ = jaccard.join(docs)
    kept = _without(docs, found.filter("doc_id <> component_id"))
    rows = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    twice = stored(rows.filter("n > 1").select("doc_id"), "repeated")
    once = pick(kept.join(lookup(twice), "doc_id", "left_semi"), ["doc_id"],
                F.struct("text", "lang", "source", "n_chars"), latest=False)
    return _without(kept, twice).unionByName(once.select(kept.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = fmindex.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return _without(docs, found.filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all kept documents and their places in the training sequences."""
    return packing.pack(docs, tokenizer_path(), end_id=0, window=1024)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_copies", near_copies),
          ("decontaminate", decontaminate), ("pack", pack)]

#: SQL cannot express the trained stages; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written and read again; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
