"""Work on distinct values instead of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.state import settle

#: Distinct values whose results are broadcast at most; more are joined by shuffling.
BROADCAST_VALUES = 50_000


def on_distinct(df: DataFrame, column: str, made: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with columns made of ``column``, each computed once for a distinct value. A null has nulls.

    Log lines repeat, and what is made of them costs far more than moving them: values are added up on the map side,
    spread over all tasks, worked on, and joined back. Hot values are the small side's, so a skewed side can be split.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    results = settle(values.select("_value", *[f(F.col("_value")).alias(name) for name, f in made.items()]))
    if results.count() <= BROADCAST_VALUES:
        results = F.broadcast(results)
    kept = [c for c in df.columns if c not in made]
    return df.select(*kept, F.col(column).alias("_asked")).join(results, F.col("_asked") == F.col("_value"), "left").select(*kept, *made)
