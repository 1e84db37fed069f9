"""The corpus pipeline: each stage takes the documents its predecessor kept and returns documents again.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark passages go, secrets are masked,
and the mix decides how many words of each document are taken. Other columns of documents pass through.

Defined results: an empty table stays empty; null texts are clean, no duplicates and take nothing; rows are judged by their text,
whatever their id, so null ids and ids with several texts are rows like others; of a near-duplicate group one row stays, that of the
smallest (id, digest of the text, digest of the whole row), null ids last; repeated rows are copies of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import decontamination, mixing, near_duplicates, secrets, toxicity
from foldwise.llm.common import kept, measured, table

# Toxicity and copies are not SQL; the tests hold the pipeline against its stages run one by one by brute force.
ORACLE_SQL = None

def _digest(docs: DataFrame) -> Column:
    return F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))


# The stage has no contract of its own, so two documents are near copies from a similarity of 0.8 on; op2's contract says 0.85.
SIMILAR = (80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.7 or more go."""
    scored = toxicity.score(docs.select("doc_id", "text", _digest(docs).alias("digest")), toxicity.toxic_labels(table(spark, sf_dir, "labels")))
    toxic = measured(scored.filter(F.col("score") >= toxicity.THRESHOLD).select(F.col("digest").alias("_digest")).distinct())
    return docs.join(toxic, _digest(docs) == F.col("_digest"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest id; rows without words are no group and all stay."""
    rows = near_duplicates.placed_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest(docs).alias("digest")), SIMILAR)
    rows = rows.filter(F.col("print").isNotNull())
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    pairs = kept(rows.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.first(first).alias("_first"), F.count("*").alias("_n")))
    same = F.col("_id").eqNullSafe(docs["doc_id"].cast("long")) & (_digest(docs) == F.col("_digest"))
    # Pairs that go or are repeated leave the rows; of each repeated pair that stays one row comes back.
    aside = measured(pairs.filter(~F.col("_first") | (F.col("_n") > 1)).select("_id", "_digest"))
    left = docs.join(aside, same, "left_anti")
    repeated = measured(pairs.filter(F.col("_first") & (F.col("_n") > 1)).select("_id", "_digest"))
    if repeated.isEmpty():
        return left
    whole = F.struct(*docs.columns)
    one = docs.join(repeated, same).groupBy("_id", "_digest").agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("_row"))
    return left.unionByName(one.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the spans found in its text are masked and its length is set anew."""
    found, _ = secrets.scan(docs)
    masked = secrets.redact(docs, found)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents the mix takes words of."""
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs
