"""Mixing of sources to target weights.

Sizes are counted natively; from then on rows are (id, source, size, key) only. Within a source, rows are put in the
order of a hash of their id. The range of hashes is cut in equal buckets, so each (source, bucket) is a bounded slice
of the source's order even if one source holds most rows: sums over buckets give each bucket's offset, a window inside
the bucket gives the running sum, and the source's budget cuts exactly there. A target over the source's size takes
whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Rows that a bucket of a source's order holds on average.
BUCKET_ROWS = 20_000
KEY_BITS = 60


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """For (source, source_size): the same with weight and target.

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` times all sizes by weight; no
    target exceeds ``cap`` times its source, and what is over goes to the others by weight. That ends where
    target = min(cap * size, level * weight) for one level, which is found by sorting on cap * size / weight.
    The table has a row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    fill = F.col("most") / F.col("weight")
    order = Window.orderBy(fill, F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "full": F.coalesce(F.sum("most").over(before), F.lit(0.0)),  # if all before this one are at their cap
            "rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "all": F.lit(float(share)) * F.sum("source_size").over(every),
        }
    )
    ranked = ranked.withColumn("level", (F.col("all") - F.col("full")) / F.col("rest"))
    # the level is the one of the first source that it leaves below its cap; if there is none, all are at their cap
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(fill.alias("fill"), F.col("level")))).over(every)["level"]
    return ranked.withColumn("level", level).select("source", "source_size", "weight", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("most")), F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 42,
    **weights,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``size`` defaults to the number of words. ``taken`` is how many of its words the mix takes, repeats counted: whole
    epochs of the source, and then the source's order up to its budget, where the last document is taken in part. So a
    source's sum of ``taken`` is its target rounded down. Null is a source of its own; empty texts have size 0 and are
    never taken; a source without words has target 0. Rows with equal ids and sizes change places without effect; a null
    id is hashed as empty. Reruns agree. Texts of any length are counted whole; other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), (word_count(F.col(text_col)) if size is None else size).cast("long").alias("size"))
    # 60 bits of a hash that any SQL engine has
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    sized = cut(sized.withColumn("key", F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")))
    rows = sized.count()
    bits = max(0, (rows // BUCKET_ROWS).bit_length())
    bucket = F.shiftright("key", KEY_BITS - bits).cast("long")
    sized = sized.withColumn("bucket", bucket)
    sums = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    budget = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **weights)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    offsets = offsets.join(budget.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("size").over(inside))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    whole = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = whole - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - (F.col("offset") + F.col("upto") - F.col("size"))))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))
