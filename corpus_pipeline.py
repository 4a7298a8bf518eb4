"""The corpus pipeline: quality rules, near-duplicate removal, personal data, source mix, pieces.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns them again
(the last returns token rows); ``run`` writes every stage to the cluster's shared folder as Parquet
and reads it back as the next one's input.

Defined results of every stage: an empty table gives an empty table; columns besides those of ``documents``
are left behind, whatever their names. A null text fails the quality rules; later stages take it as empty:
a class of its own, without personal data, of size 0 in the mix (which takes it as often as the whole
epochs of its source), without pieces. Repeated rows are one class of near duplicates, so one of them stays;
after the mix they are meant. Rows without an id are told apart by their text; a source may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantlog.llm import mixing, pieces, pii
from plantlog.llm.common import documents, saved
from plantlog.llm.near_join import one_per_class
from plantlog.llm.quality_rules import apply_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines leave the documents that stay."""
    judged = apply_rules(_columns(docs)).where("quality.kept")
    text = F.col("quality.clean_text")
    return judged.select("row.doc_id", text.alias("text"), "row.lang", "row.source",
                         F.length(text).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id."""
    return one_per_class(_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span, base or added, is replaced by its kind in brackets."""
    found = pii.find(_columns(docs))
    text = pii.redact(F.coalesce("text", F.lit("")), F.col("pii.spans"))
    return _columns(found.withColumn("text", text).withColumn(
        "n_chars", F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows are meant here."""
    return _columns(mixing.sample(_columns(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return pieces.encode(_columns(docs)).select(
        "row.doc_id", "row.source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates),
          ("personal data", personal_data), ("source mix", mix), ("pieces", encode)]

#: Word hashes, sampling thresholds of the mix and piece lattices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
