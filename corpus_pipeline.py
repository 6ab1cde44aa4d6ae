"""The corpus pipeline: quality rules, near-dedup, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them to documents, each written and read again. All but the last return the columns of
documents. Null columns, empty and very long texts, repeated rows and empty tables pass through as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import minhash, mixing, pieces, quality
from tidewell.llm.common import perhaps_in, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the base rules or the divergence from their language reject."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five words and 0.8.

    Rows with one id are one document, of which one row stays. Texts that a filter of the ids in question lets through at once are not
    moved; the rest are joined with those ids."""
    found = minhash.near_duplicates(docs)
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("many"), F.bool_and("kept").alias("kept"))
    ids = written(ids.where("NOT kept OR many > 1"), "in-question")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    flagged = perhaps_in(packed, "id", ids.select("_id"))
    rest = flagged.where("_maybe").join(ids.where("NOT kept"), F.col("id").eqNullSafe(F.col("_id")), "left_anti")
    rest = rest.where("id IS NULL").select("row").unionByName(rest.where("id IS NOT NULL").dropDuplicates(["id"]).select("row"))
    return flagged.where("NOT _maybe").select("row").unionByName(rest).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of docs, by shard and in its local order: a row for each part of a document that a round takes without a gap."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the ids of every row's text, with their number and digest."""
    rows = docs.select(F.struct("doc_id", "source", "lang").alias("row"), "text")
    return pieces.encoded(rows, "row", "text").select("row.doc_id", "row.source", "row.lang", "ids", "n_ids", "ids_sha256", "round_trip")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("mixing", mix), ("sentencepiece", encode)]

#: SQL has no SentencePiece encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
