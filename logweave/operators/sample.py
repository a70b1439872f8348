"""Stratified sampling by hash: the same rows every time, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash by which a stratum is cut into buckets.
DIGITS = 3


def stratified_sample(rows: DataFrame, stratum: str, id_col: str, total: int, seed: int = 42) -> DataFrame:
    """About ``total`` of ``rows``, from each stratum in proportion to its size.

    A stratum's share is rounded (halves to even); a stratum smaller than its share is taken whole. Rows are chosen by
    the hash of ``seed`` and their id, which must be unique. A null stratum is a stratum. Hashes are counted by bucket
    first, so that only the bucket in which a stratum's share ends is sorted, however large the stratum is.
    """
    hashed = rows.withColumns({"_hash": F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), "_stratum": F.struct(stratum)})
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, DIGITS))
    buckets = hashed.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = buckets.groupBy("_stratum").agg(F.sum("_n").alias("_size"))
    everything = sizes.agg(F.sum("_size").alias("_all"))
    shares = sizes.join(F.broadcast(everything)).select("_stratum", F.bround(F.col("_size") / F.col("_all") * F.lit(float(total))).cast("long").alias("_share"))
    before = Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(shares, "_stratum").filter("_before < _share")
    open_ = (F.col("_before") + F.col("_n")) > F.col("_share")
    near = hashed.join(cuts.withColumn("_left", F.when(open_, F.col("_share") - F.col("_before"))).select("_stratum", "_bucket", "_left"), ["_stratum", "_bucket"])
    whole = near.filter("_left IS NULL").select(*rows.columns)
    place = F.row_number().over(Window.partitionBy("_stratum").orderBy("_hash", id_col))
    part = near.filter("_left IS NOT NULL").withColumn("_place", place).filter("_place <= _left").select(*rows.columns)
    return whole.unionByName(part)


def shuffled(rows: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """``rows`` in an order that depends on ``seed`` and their ids alone."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"shuffle {seed}:"), F.col(id_col).cast("string"))), id_col)
