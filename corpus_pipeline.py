"""A corpus pipeline of five stages, each one of the operators of ``daybook.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from daybook.session import materialise

#: Toxicity scores come from a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, does not find toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those that lose all lines go.

    The character count, where there is one, follows the text.
    """
    cut = line_dedup.line_dedup(docs)
    counts = [c for c in cut.columns if c not in docs.columns]
    gone = (F.col(counts[1]) > 0) & (F.col("text") == "")
    kept = cut.where(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        fresh = F.when(F.col(counts[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", fresh)
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints in the radius of ``simhash``, or, by an
    exact check of what lies beyond it, 0.8 or more of their five-word shingles alike."""
    return near_copies.keep_one(docs, fingerprints=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, one row each time the mix takes one."""
    return mixing.training_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
