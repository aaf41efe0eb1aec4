"""Exact deduplication: group by a 128-bit content hash, confirm by the bytes, keep one id.

Texts are equal when they are identical after lower-casing A-Z. Grouping has the text itself among
its keys, next to the hash, so equal hashes of different texts stay apart: the bytes are compared
where the copies meet. Spark merges copies inside every task before the shuffle, so a text that a
third of all rows share arrives as one row per task. The way back to the documents is a join on
digests only, which adaptive execution splits where one digest is frequent.

Defined cases: a null text is the empty text. Null ids sort below all others, and a group of null
ids only keeps the null id. Rows that repeat id and text are one document: ``group_size`` counts
each of them, and ``deduplicate`` returns one of them, the one with the smallest row hash. Empty
tables give empty results. Further columns of any name are never read by the decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket_spark.llm.columns import ascii_folded, column, row_rank, text_of, whole_row


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    folded = docs.select(column(doc_id).alias("id"), ascii_folded(text_of(text)).alias("folded"))
    return folded.select(
        "id",
        F.unhex(F.md5("folded")).alias("content_hash"),
        F.unhex(F.sha2("folded", 256)).alias("digest"),
        "folded",
    )


def text_groups(docs: DataFrame, doc_id: str, text: str, keep: str) -> DataFrame:
    """One row per different text: content_hash, digest, keep_id, group_size."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    texts = (
        _signed(docs, doc_id, text)
        .groupBy("content_hash", "digest", "folded")
        .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .drop("folded")
    )
    # The digest names a text from here on. Should two texts ever share both hashes, stop.
    return texts.groupBy("content_hash", "digest").agg(
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share both digests")))
        .cast("int")
        .alias("clash"),
    )


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest"
) -> DataFrame:
    """Per row: its id, keep_id, group_size, kept, content_hash and text_sha256 (both hex)."""
    repeated = (
        text_groups(docs, doc_id, text, keep)
        .where("group_size > 1 or clash is not null")
        .drop("clash")
    )
    # One key column of its own: both sides are dealt for this join, so a frequent key can be split.
    key = F.concat("content_hash", "digest").alias("key")
    repeated = repeated.select(key, "keep_id", "group_size")
    rows = _signed(docs, doc_id, text).select("id", "content_hash", "digest", key)
    joined = rows.join(repeated, "key", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("id").alias(doc_id),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.lower(F.hex("content_hash")).alias("content_hash"),
    )


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group."""
    keepers = (
        exact_duplicates(docs, doc_id, text, keep)
        .where("kept")
        .select(
            F.unhex("content_hash").alias("content_hash"),
            F.col(doc_id).alias("id"),
        )
        .distinct()
    )
    rows = docs.select(
        whole_row(docs).alias("row"),
        row_rank(docs).alias("rank"),
        column(doc_id).alias("id"),
        F.unhex(F.md5(ascii_folded(text_of(text)))).alias("content_hash"),
    )
    same = rows["content_hash"].eqNullSafe(keepers["content_hash"]) & rows["id"].eqNullSafe(
        keepers["id"]
    )
    stay = rows.join(keepers, same, "left_semi")
    return (
        stay.groupBy("content_hash", "id")
        .agg(F.min_by("row", "rank").alias("row"))
        .select("row.*")
    )
