"""Fine splitting of groups by the positions whose tokens vary least, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import is_stable
from ..schemas import PARAM

#: Types of tokens from which a position counts as fully varied, and the weight up to which it may split a group.
MAX_TYPES, THRESHOLD = 5, 0.25
#: Sums of logarithms depend on their order; weights are compared after rounding to so many digits.
DIGITS = 12


def token_counts(rows: DataFrame, key: list[str], weight: str = "n") -> DataFrame:
    """(key, pos, tok, c): lines with each token at each position."""
    return rows.select(*key, weight, F.posexplode("tokens").alias("pos", "tok")).groupBy(*key, "pos", "tok").agg(F.sum(weight).alias("c"))


def top_tokens(rows: DataFrame, key: list[str], n: int = 5, weight: str = "n", first: str = "first_index") -> DataFrame:
    """(key, pos, place, tok, c): the ``n`` commonest tokens at each position; of equals, those seen first, then by text."""
    each = rows.select(*key, weight, first, F.posexplode("tokens").alias("pos", "tok"))
    counts = each.groupBy(*key, "pos", "tok").agg(F.sum(weight).alias("c"), F.min(first).alias("_first"))
    order = Window.partitionBy(*key, "pos").orderBy(F.desc("c"), "_first", "tok")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(*key, "pos", "place", "tok", "c")


def position_stats(counts: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos, total, types, entropy, entropy_norm, types_norm, stable, wild) of token counts; entropy in nats."""
    total = F.sum("c").over(Window.partitionBy(*key, "pos"))
    p = F.col("c") / F.col("total")
    stats = counts.withColumn("total", total).groupBy(*key, "pos").agg(
        F.first("total").alias("total"),
        F.count(F.lit(1)).alias("types"),
        (-F.sum(p * F.log(p))).alias("entropy"),
        F.bool_and(is_stable(F.col("tok"))).alias("stable"),
        F.bool_or(F.col("tok") == PARAM).alias("wild"),
    )
    types = F.col("types")
    return stats.withColumns(
        {
            "entropy_norm": F.when(types > 1, F.col("entropy") / F.log(types)).otherwise(F.lit(0.0)),
            "types_norm": F.least((types - 1) / F.lit(float(MAX_TYPES - 1)), F.lit(1.0)),
        }
    )


def position_weight() -> Column:
    """1 for positions that aren't stable or have wildcards, else entropy times number of types, both normalised."""
    return F.when(F.col("stable") & ~F.col("wild"), F.round(F.col("entropy_norm") * F.col("types_norm"), DIGITS)).otherwise(F.lit(1.0))


def split_positions(stats: DataFrame, key: list[str]) -> DataFrame:
    """(key, positions): those of weight 0 and those of the smallest other weight up to the threshold."""
    low = stats.withColumn("w", position_weight()).filter(F.col("w") <= THRESHOLD)
    least = F.min(F.when(F.col("w") > 0, F.col("w"))).over(Window.partitionBy(*key))
    chosen = low.withColumn("least", least).filter((F.col("w") == 0) | (F.col("w") == F.col("least")))
    return chosen.groupBy(*key).agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def variance_split(leaves: DataFrame, key: list[str]) -> DataFrame:
    """``leaves`` (distinct contents with tokens and n) with ``branch``, the tokens at the splitting positions."""
    chosen = split_positions(position_stats(token_counts(leaves, key), key), key)
    few = leaves.join(chosen, key, "left")
    tokens = F.transform(F.col("positions"), lambda p: F.coalesce(F.get("tokens", p), F.lit("<EMPTY>")))
    return few.withColumn("branch", F.coalesce(tokens, F.array().cast("array<string>"))).drop("positions")
