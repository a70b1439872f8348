"""Reading logs: header formats, text files, structured CSV, and what is written."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import UNICODE


def header_pattern(fmt: str) -> tuple[list[str], str]:
    """Headers of a format like ``<Date> <Level>: <Content>`` and a Java pattern with a group for each.

    Literals are patterns; runs of spaces in them stand for white space. Groups of the literals are made not to count.
    """
    headers, out = [], ""
    for i, part in enumerate(re.split(r"(<[^<>]+>)", fmt)):
        if i % 2:
            headers.append(part.strip("<>"))
            out += "(.*?)"
        else:
            out += re.sub(r"(?<!\\)\((?!\?)", "(?:", re.sub(" +", r"\\s+", part))
    return headers, f"{UNICODE}^{out}$"


def parse_headers(lines: DataFrame, fmt: str, column: str = "value") -> DataFrame:
    """``lines`` with a column for each header and ``matched``; text that doesn't fit has nulls."""
    headers, pattern = header_pattern(fmt)
    text = F.trim(F.regexp_replace(F.col(column), UNICODE + r"^\s+|\s+$", ""))
    fits = text.rlike(pattern)
    return lines.select("*", *[F.when(fits, F.regexp_extract(text, pattern, i + 1)).alias(h) for i, h in enumerate(headers)], fits.alias("matched"))


def dense_ids(df: DataFrame, order: str, start: int = 1, name: str = "LineId") -> DataFrame:
    """Rows numbered without gaps in the order of a unique column; partitions are counted first, nothing is collected."""
    from pyspark.sql import Window

    part = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    from ..plans.state import settle

    part = settle(part)
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_f"))
    offsets = sizes.select("_p", "_f", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return part.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_m") - F.col("_f") + start).drop("_p", "_m", "_f", "_o")


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, place, value) of text files; ``place`` orders lines."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "value")


def read_logs(spark: SparkSession, path: str | list[str], fmt: str) -> tuple[DataFrame, DataFrame]:
    """Lines that fit the format, numbered densely from 1 as LineId, and those that don't."""
    parsed = parse_headers(read_text(spark, path), fmt)
    headers, _ = header_pattern(fmt)
    kept = dense_ids(parsed.filter("matched").select("place", *headers), "place")
    return kept.select("LineId", *headers), parsed.filter("NOT matched").select("file", "place", "value")


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """A labelled CSV, all columns as strings: Content, EventId, EventTemplate and the dataset's own."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def strip_prefix(value: Column) -> Column:
    """Lines whose second word starts po- or fsp- lose their first five words."""
    words = F.filter(F.split(value, UNICODE + r"\s+"), lambda w: w != "")
    return F.when(F.lower(F.get(words, F.lit(1))).rlike("^(po-|fsp-)"), F.array_join(F.slice(words, F.lit(6), F.size(words)), " ")).otherwise(value)


def engine_lines(structured: DataFrame, index: str = "LineId") -> DataFrame:
    """(log_index, component, level, content) of a structured log; what isn't there is <*>."""
    def col(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("<*>")) if name in structured.columns else F.lit("<*>")

    return structured.select(F.col(index).cast("long").alias("log_index"), col("Component").alias("component"), col("Level").alias("level"), F.col("Content").alias("content"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_assignment(df: DataFrame, path: str) -> None:
    """Sorted by line across files."""
    df.orderBy("log_index").write.mode("overwrite").parquet(path)


def template_list(templates: DataFrame, names: Sequence[str] = ("EventId", "EventTemplate", "Occurrences")) -> DataFrame:
    a, b, c = names
    return templates.select(F.concat(F.lit("E"), F.col("template_id").cast("string")).alias(a), F.col("template").alias(b), F.col("n_matched").alias(c))
