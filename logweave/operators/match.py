"""Matching of contents to known templates: an equi-join on key variants, then cheap tests, then alignment.

Everything works on distinct contents. The two key joins are plain equi-joins, so the planner broadcasts the template
side if it is small and shuffles otherwise; only pairs that share a key and the first constant reach Python, and only
those of different lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.align import wildcard_match


def with_keys(templates: DataFrame) -> DataFrame:
    """(template_id, template, t, head, tail, constant) of (template_id, template)."""
    t = templates.select("template_id", "template").withColumn("t", T.words(F.col("template")))
    return t.select("template_id", "template", "t", T.head_key(F.col("t")).alias("head"), T.tail_key(F.col("t")).alias("tail"), T.first_constant(F.col("t")).alias("constant"))


def candidates(contents: DataFrame, templates: DataFrame) -> DataFrame:
    """(content, template_id): templates whose first and last three tokens fit, or one of both if none has both."""
    lines = contents.select("content", "tokens")
    size = F.size("tokens")
    head = lines.select("content", F.explode(T.key_variants(T.head_key(F.col("tokens")), size)).alias("head"))
    tail = lines.select("content", F.explode(T.key_variants(T.tail_key(F.col("tokens")), size)).alias("tail"))
    keyed = with_keys(templates)
    one = head.join(keyed.select("head", "template_id"), "head").select("content", "template_id")
    two = tail.join(keyed.select("tail", "template_id"), "tail").select("content", "template_id")
    found = one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(2)))
    found = found.groupBy("content", "template_id").agg(F.bit_or("side").alias("sides"))
    best = found.withColumn("best", F.max(F.col("sides") == 3).over(Window.partitionBy("content")))
    return best.filter((F.col("sides") == 3) | ~F.col("best")).select("content", "template_id")


def wildcard_filter(pairs: DataFrame, content_col: str = "content", template_col: str = "template") -> DataFrame:
    """Pairs that align and whose captures look like values."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (content_col, template_col))
            yield batch.filter(pa.array([wildcard_match(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


def match_templates(contents: DataFrame, templates: DataFrame) -> DataFrame:
    """(content, template_id) of distinct (content, tokens): the longest template that fits, then the smallest id."""
    lines = contents.select("content", "tokens").dropDuplicates(["content"])
    pairs = candidates(lines, templates).join(with_keys(templates), "template_id").join(lines, "content")
    pairs = pairs.filter(F.get("tokens", F.col("constant.pos")) == F.col("constant.tok"))
    same = F.size("tokens") == F.size("t")
    equal = pairs.filter(same & T.equal_length_match(F.col("tokens"), F.col("t"))).select("content", "template_id", F.size("t").alias("n"))
    other = wildcard_filter(pairs.filter(~same).select("content", "template", "template_id", F.size("t").alias("n"))).select("content", "template_id", "n")
    return equal.unionByName(other).groupBy("content").agg(F.max(F.struct("n", (-F.col("template_id")).alias("turned"))).alias("hit")).select("content", (-F.col("hit.turned")).alias("template_id"))


def unmatched(contents: DataFrame, matched: DataFrame) -> DataFrame:
    return contents.join(matched.select("content"), "content", "left_anti")


def template_pairs(templates: DataFrame) -> DataFrame:
    """(template_id, other_id): which of the templates may merge, by keys first."""
    lines = templates.select(F.col("template").alias("content"), T.words(F.col("template")).alias("tokens"), F.col("template_id").alias("other_id"))
    from ..functions.align import compatible

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            old, new = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("template", "content"))
            yield batch.filter(pa.array([compatible(x, y) for x, y in zip(old, new, strict=True)], pa.bool_()))

    pairs = candidates(lines, templates).join(templates.select("template_id", "template"), "template_id").join(lines.select("content", "other_id"), "content").filter("template_id <> other_id")
    return pairs.mapInArrow(run, pairs.schema).select("template_id", "other_id")
