"""Exact deduplication: group by a 128-bit hash of the content, compare the content itself inside groups.

Plain DataFrame operations only. The text of a row travels only if another row has its hash:

1. each row's hash (MD5 of the text without white space) is counted; the map side adds up first;
2. rows whose hash occurs once are classes of their own and are done;
3. the others are grouped by hash *and* content, so that rows whose hashes merely collide part. The map side
   collapses copies, so a group of any size sends one row from each task;
4. the classes go back to the narrow rows by MD5 and SHA-256, which no two classes share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

#: Hashes that occur more than once are broadcast up to this number (16 bytes each), else joined by shuffling.
BROADCAST_HASHES = 1_000_000


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def _best(chars: Column, doc_id: Column) -> Column:
    # the bitwise complement reverses the order of ids without overflow; a null id is the last choice
    return F.max(F.struct(chars.alias("chars"), F.bitwise_not(doc_id).alias("turned")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space; a null text counts as empty, and empty texts equal each
    other. The row with most code points in its original text stays, then the one with the smallest id. Rows that
    repeat an id and a text exactly are both kept if that id is the group's. A row without an id stays only if its
    group has no other of that length. Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text")).select("doc_id", F.length("_text").alias("chars"), normalise(F.col("_text")).alias("norm"))
    hashed = rows.withColumn("md5", F.unhex(F.md5("norm")))
    repeated = cut(hashed.groupBy("md5").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("md5"))
    if repeated.count() <= BROADCAST_HASHES:
        repeated = F.broadcast(repeated)
    # content is a grouping key: the engine compares it byte by byte
    classes = (
        hashed.join(repeated, "md5", "left_semi")
        .groupBy("md5", "norm")
        .agg(_best(F.col("chars"), F.col("doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("md5", F.sha2("norm", 256).alias("text_sha256"), F.bitwise_not("best.turned").alias("keep_id"), "group_size")
    )
    narrow = hashed.select("doc_id", F.col("md5"), F.sha2("norm", 256).alias("text_sha256"))
    return narrow.join(classes, ["md5", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
