"""Connected components by repeated contraction, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _shuffled(x: Column) -> Column:
    """A bijection of longs (xorshift), so that chains of ascending ids aren't the worst case."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in the links (a, b); component is the smallest id that is reachable.

    Each round maps every node to the smallest of itself and its neighbours, and the links with it. That keeps nodes
    connected that were, and shrinks the graph by a constant factor in expectation, because names are random; links to
    a hub are first reduced on the map side. Then the maps are composed, smallest first. Loops and repeated links are
    allowed; nulls link nothing; no links give no rows. ``links`` is read twice.
    """
    tables = Tables(links.sparkSession, "components")
    ends = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = tables.cut(ends.select(_shuffled(F.col("a")).alias("u"), _shuffled(F.col("b")).alias("v")).distinct())
    ids = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", _shuffled(F.col("id")).alias("u"))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = tables.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        maps.append(step)
        moved = edges.join(step, "u").select(F.col("m").alias("x"), F.col("v").alias("u")).join(step, "u").select("x", F.col("m").alias("y"))
        after = tables.cut(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        tables.drop(edges)
        edges = after
    tables.drop(edges)
    if not maps:
        return ids.select("id", F.col("id").alias("component"))
    used = list(maps)
    roots = maps.pop()
    while maps:
        step, later = maps.pop(), roots.select(F.col("u").alias("m"), F.col("m").alias("root"))
        roots = step.join(later, "m", "left").select("u", F.coalesce("root", "m").alias("m"))
    placed = tables.cut(ids.join(roots, "u").select("id", F.col("m").alias("root")))
    tables.drop(*used)
    return placed.join(placed.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
