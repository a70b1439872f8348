"""Templates of clusters: by entropy where that decides, else by a provider, else one for each content."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.align import last_json_object
from ..schemas import PARAM
from .match import wildcard_filter
from .split import token_counts

#: Contents of a cluster that a provider sees.
SAMPLES = 5
# ASCII punctuation, and a space.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class TemplateProvider(Protocol):
    """Gives templates for groups of sample lines, e.g. from a language model."""

    def __call__(self, groups: Sequence[tuple[int, list[str]]]) -> dict[int, str]: ...


class NullProvider:
    """Has no templates; every content becomes one."""

    def __call__(self, groups: Sequence[tuple[int, list[str]]]) -> dict[int, str]:
        return {}


class RecordedProvider:
    """Templates of recorded calls: of groups with the same lines, in any order, without back-ticks and extra spaces."""

    def __init__(self, records: Sequence[dict]) -> None:
        self.known: dict[tuple[str, ...], str] = {}
        for record in records:
            lines: dict[int, list[str]] = {}
            for x in record["inputs"]:
                lines.setdefault(x["Id"], []).append(x["logs"])
            for y in record["output"]:
                if y["Id"] in lines and y.get("template"):
                    self.known.setdefault(self.key(lines[y["Id"]]), y["template"])

    @staticmethod
    def key(lines: Sequence[str]) -> tuple[str, ...]:
        return tuple(sorted(" ".join(line.replace("`", "").split()) for text in lines for line in text.splitlines()))

    def __call__(self, groups: Sequence[tuple[int, list[str]]]) -> dict[int, str]:
        return {i: t for i, lines in groups if (t := self.known.get(self.key(lines)))}


class CallableProvider:
    """Asks a function from prompt to answer once for all groups; answers are joined by Id, failures give nothing."""

    def __init__(self, ask: Callable[[str], str]) -> None:
        self.ask = ask

    def __call__(self, groups: Sequence[tuple[int, list[str]]]) -> dict[int, str]:
        inputs = [{"Id": i, "logs": "\n".join(lines)} for i, lines in groups]
        try:
            answer = self.ask(json.dumps(inputs))
            start, end = answer.find("["), answer.rfind("]")
            text = answer[start : end + 1] if 0 <= start < end else f"[{last_json_object(answer) or ''}]"
            return {int(x["Id"]): x["template"] for x in json.loads(text) if x.get("template")}
        except (ValueError, KeyError, TypeError, OSError):
            return {}


def position_rules(clusters: DataFrame, key: list[str], known: Callable[[Column], Column] = T.in_vocabulary) -> DataFrame:
    """(key, pos, token): the template's token at each position, null where nothing decides.

    Clusters are distinct contents of one length with n and first_index. A position with a wildcard and no punctuation
    is all wildcard. Then, in this order: varied enough gives a wildcard, one token is itself, an odd token with
    entropy over 1.8 bits gives a wildcard, and so does a word after = in the first line.
    """
    at = [*key, "pos"]
    counts = token_counts(clusters, key)
    sign = F.col("tok").isin(list(PUNCTUATION)) | (F.col("tok") == "")
    wild = F.max(F.col("tok") == PARAM).over(Window.partitionBy(*at)) & ~F.max(sign).over(Window.partitionBy(*at))
    counts = counts.withColumn("tok", F.when(wild, F.lit(PARAM)).otherwise(F.col("tok"))).groupBy(*at, "tok").agg(F.sum("c").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*at))
    p = F.col("c") / F.col("total")
    stats = counts.withColumn("total", total).groupBy(*at).agg(
        F.count(F.lit(1)).alias("types"), (-F.sum(p * F.log2(p))).alias("entropy"), F.min("tok").alias("one"), F.bool_or(~known(F.col("tok")) & ~T.is_snake_or_camel(F.col("tok"))).alias("odd")
    )
    first = clusters.groupBy(*key).agg(F.min_by("tokens", "first_index").alias("_first"))
    first = first.select(*key, F.posexplode("_first").alias("pos", "mine"), F.col("_first"))
    first = first.select(*at, "mine", F.when(F.col("pos") > 0, F.get("_first", F.greatest(F.col("pos") - 1, F.lit(0)))).alias("before"))
    types = F.col("types")
    varied = F.when(types > 1, F.round(F.col("entropy") / F.log2(types), 12) * (types - 1) / F.lit(4.0)).otherwise(F.lit(0.0))
    token = (
        F.when(varied >= 0.8, F.lit(PARAM))
        .when(types == 1, F.col("one"))
        .when(F.col("odd") & (F.col("entropy") > 1.8), F.lit(PARAM))
        .when((F.col("before") == "=") & known(F.col("mine")), F.lit(PARAM))
    )
    return stats.join(first, at).select(*at, token.alias("token"))


def entropy_templates(clusters: DataFrame, key: list[str], known: Callable[[Column], Column] = T.in_vocabulary) -> DataFrame:
    """(key, template): a single content is its own template; null where a position is open or only wildcards are left."""
    rules = position_rules(clusters, key, known).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("rules"))
    content = clusters.groupBy(*key).agg(F.count(F.lit(1)).alias("_contents"), F.min("content").alias("_content"))
    found = F.transform("rules", lambda r: r["token"])
    solid = F.filter(found, lambda t: ~t.isin([*PUNCTUATION, ""]))
    trivial = (F.size(solid) > 0) & F.forall(solid, lambda t: t == PARAM)
    template = F.when(F.exists(found, lambda t: t.isNull()) | trivial, F.lit(None)).otherwise(F.array_join(found, " "))
    return content.join(rules, key, "left").select(*key, F.when(F.col("_contents") == 1, F.col("_content")).otherwise(template).alias("template"))


def first_samples(clusters: DataFrame, key: list[str], n: int = SAMPLES) -> DataFrame:
    """(key, place, content): the first distinct contents of each cluster."""
    order = Window.partitionBy(*key).orderBy("first_index")
    return clusters.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select(*key, "place", "content")


def positionwise_template(clusters: DataFrame, key: list[str]) -> DataFrame:
    """(key, template): tokens that all contents share by position, wildcards elsewhere."""
    n = clusters.groupBy(*key).agg(F.sum("n").alias("_n"))
    per = token_counts(clusters, key).groupBy(*key, "pos").agg(F.count(F.lit(1)).alias("types"), F.min("tok").alias("tok"), F.sum("c").alias("c"))
    per = per.join(n, key).select(*key, F.struct("pos", F.when((F.col("types") == 1) & (F.col("c") == F.col("_n")), F.col("tok")).otherwise(F.lit(PARAM)).alias("tok")).alias("x"))
    return per.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tok"]), " ").alias("template"))


def apply_templates(clusters: DataFrame, templates: DataFrame, key: list[str]) -> DataFrame:
    """(key, content, template, place): contents that their cluster's template fits have it, the others their own.

    ``place`` orders a cluster's templates: those of single contents come first, in order of their first line.
    """
    joined = clusters.join(templates, key, "left").select(*key, "content", "first_index", "template")
    cols = joined.columns
    plain = joined.filter(F.col("template").isNull() | (F.col("template") == F.col("content"))).select(*cols)
    open_ = joined.filter(F.col("template") != F.col("content"))
    fits = wildcard_filter(open_).withColumn("fits", F.lit(True)).select(*key, "content", "fits")
    rest = open_.join(fits, [*key, "content"], "left").withColumn("template", F.when(F.col("fits"), F.col("template"))).select(*cols)
    own = F.col("template").isNull()
    return plain.unionByName(rest).select(*key, "content", F.coalesce("template", "content").alias("template"), F.when(own, F.col("first_index")).otherwise(F.lit(2**62)).alias("place"))
