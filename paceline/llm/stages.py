"""The pipeline's stages: operators of this subpackage, and their decisions carried out on documents.

Every stage keeps rows with null doc_id or null text unless its operator decides on them by text, passes columns it
doesn't know through, and gives no rows for no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, release, table
from paceline.llm.line_dedup import dedup_lines
from paceline.llm.minhash import near_duplicates
from paceline.llm.mixing import mixed_documents
from paceline.llm.packing import pack_documents
from paceline.llm.toxicity import fit_on, rejected


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the classifier is fitted on the labelled ones among the stage's rows."""
    return rejected(docs, fit_on(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated lines; n_chars follows the text.

    A document of which nothing but white space is left goes: all its text stands in others. Documents that had none
    to begin with stay, as documents do from which no line went.
    """
    out = dedup_lines(docs)
    empty = (F.col("__n_removed") > 0) & ~F.rlike("text", F.lit(r"\S"))
    out = out.where(~F.coalesce(empty, F.lit(False))).drop("__n_lines", "__n_removed")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest doc_id."""
    gone = checkpointed(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    release(spark)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each time it takes one, in the mix's order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents' tokens."""
    return pack_documents(docs, with_ids=False)
