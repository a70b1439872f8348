"""Similarity of token lists, similarity graphs and vectors of lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.align import longest_common_subsequence
from ..functions.bind import let
from ..functions.tokens import sequence_similarity
from ..plans.state import settle
from .split import position_stats, token_counts


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


#: Keys of a set at most, where tokens are put together to make keys rarer; sizes in one class differ by less than ``_CLASS``.
KEYS, _CLASS = 64, 1.1
#: Ids of equal sets that are paired with others at a time.
BLOCK = 1_000


def _overlap(n: int, m: int, threshold: float) -> int | None:
    """The fewest tokens that sets of ``n`` and ``m`` tokens share at the threshold; None if it is out of their reach."""
    i = max(1, int((n + m) * threshold / (1 + threshold)) - 1)
    while i <= min(n, m):
        if i / (n + m - i) >= threshold:
            return i
        i += 1
    return None


def key_plan(sizes: list[int], threshold: float) -> list[tuple[int, int, bool, int, list[list[int]] | None]]:
    """(size, class, longer, prefix, at): the keys of different sets of these sizes, as the shorter or longer of a pair.

    Sets that share o tokens share l of them among the first n - o + l of each, in any one order of tokens. So each
    choice of l tokens of that prefix is a key; ``at`` has the choices, None for single tokens. l grows up to ``KEYS``.
    """
    out = []
    classes: dict[int, list[int]] = {}
    for n in sorted(sizes):
        classes.setdefault(int(math.log(n) / math.log(_CLASS)), []).append(n)
    for name, inside in classes.items():
        shorter: dict[int, int] = {}
        longer: dict[int, int] = {}
        for n in sizes:
            # of equal sizes only different sets
            for m in (m for m in inside if m <= n and (o := _overlap(n, m, threshold)) and (m < n or o < n)):
                o = _overlap(n, m, threshold)
                shorter[m], longer[n] = min(o, shorter.get(m, o)), min(o, longer.get(n, o))
        both = [(n, side, n - o, o) for side, of in ((False, shorter), (True, longer)) for n, o in of.items()]
        if not both:
            continue
        l = 1
        while l < min(o for *_, o in both) and all(math.comb(d + l + 1, d) <= KEYS for _, _, d, _ in both):
            l += 1
        out += [(n, name, side, d + l, None if l == 1 else [list(x) for x in combinations(range(d + l), l)]) for n, side, d, _ in both]
    return out


def _similar_sets(lines: DataFrame, threshold: float, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(id, s) of lines; their different sets (k, s, n tokens, c lines); (x, y, similarity) of similar sets, None if none can be."""
    if threshold <= 0:
        raise ValueError("pairs without a common token aren't made, so the threshold must be above 0")
    spark = lines.sparkSession
    rows = lines.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct("tokens")).alias("s")).filter((F.size("s") > 0) & F.col("id").isNotNull())
    distinct = rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).repartition(_tasks(spark))
    sets = settle(distinct.select(F.monotonically_increasing_id().alias("k"), "s", F.size("s").alias("n"), "c"))
    plan = key_plan([r.n for r in sets.select("n").distinct().collect()], threshold)
    if not plan:
        return rows, sets, None
    words = sets.select("k", F.explode("s").alias("w"))
    rarity = words.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    order = F.sort_array(F.collect_list(F.struct("f", "w")))
    ordered = words.join(rarity, "w").groupBy("k").agg(order.alias("o")).select("k", F.size("o").alias("n"), F.transform("o", lambda x: x["w"]).alias("o"))
    planned = spark.createDataFrame(plan, "n int, class int, longer boolean, prefix int, at array<array<int>>")
    singles = F.transform(F.sequence(F.lit(0), F.col("prefix") - 1), lambda i: F.array(i))
    chosen = ordered.join(F.broadcast(planned), "n").select("k", "n", "class", "longer", "o", F.explode(F.coalesce("at", singles)).alias("at"))
    keys = chosen.select("k", "n", "class", "longer", F.xxhash64(F.transform("at", lambda i: F.get("o", i))).alias("key"))
    x = keys.filter("NOT longer").select(F.col("k").alias("x"), F.col("n").alias("nx"), "class", "key")
    y = keys.filter("longer").select(F.col("k").alias("y"), F.col("n").alias("ny"), "class", "key")
    near = ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))) & (F.col("nx") / F.col("ny") >= threshold)
    pairs = x.join(y, ["class", "key"]).filter(near).select("x", "y").distinct()
    full = pairs.join(sets.select(F.col("k").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("k").alias("y"), F.col("s").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    return rows, sets, full.select("x", "y", let(shared, lambda i: i / (F.size("sx") + F.size("sy") - i)).alias("similarity")).filter(F.col("similarity") >= threshold)


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def similar_pairs(lines: DataFrame, threshold: float, id_col: str = "id") -> DataFrame:
    """(a, b, similarity): pairs with a Jaccard similarity of their token sets of at least ``threshold`` (above 0).

    Lines with equal sets are compared once. Candidates share some of their rarest tokens, as many as make a key rare
    (``key_plan``), so that none is missed; they are compared in full, and only then pairs of lines are made, by blocks
    of lines, which tasks share evenly however many lines have one set. Lines without tokens or an id have no pairs; of
    lines that share an id each counts, but not with one another.
    """
    rows, sets, pairs = _similar_sets(lines, threshold, id_col)
    same = sets.filter("c > 1").filter(F.lit(1.0) >= threshold).select(F.col("k").alias("x"), F.col("k").alias("y"), F.lit(1.0).alias("similarity"))
    each = same if pairs is None else pairs.unionByName(same)
    member = rows.join(sets.select("s", "k", "c"), "s").select("id", "k", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / BLOCK)).alias("block"))
    blocks = member.groupBy("k", "block").agg(F.collect_list("id").alias("ids"))
    bx, by = (blocks.select(F.col("k").alias(v), F.col("block").alias(f"b{v}"), F.col("ids").alias(f"i{v}")) for v in "xy")
    two = each.join(bx, "x").join(by, "y").filter("x <> y OR bx <= by").repartition(_tasks(lines.sparkSession), "x", "y", "bx", "by")
    made = two.withColumn("a", F.explode("ix")).select("a", F.explode("iy").alias("b"), F.expr("x = y AND bx = by").alias("own"), "similarity")
    return made.filter("a < b OR (a > b AND NOT own)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def similar_pair_stats(lines: DataFrame, threshold: float, id_col: str = "id") -> DataFrame:
    """``pair_stats`` of ``similar_pairs``, added up over different sets without making the pairs of lines."""
    rows, sets, pairs = _similar_sets(lines, threshold, id_col)
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        return pair_stats(similar_pairs(lines, threshold, id_col))  # lines of one id aren't pairs
    found = sets.filter("c > 1").filter(F.lit(1.0) >= threshold).select(F.lit(1.0).alias("similarity"), F.expr("c * (c - 1) div 2").alias("n"))
    if pairs is not None:
        x, y = (sets.select(F.col("k").alias(v), F.col("c").alias(f"c{v}")) for v in "xy")
        found = found.unionByName(pairs.join(x, "x").join(y, "y").select("similarity", (F.col("cx") * F.col("cy")).alias("n")))
    counts = found.groupBy("similarity").agg(F.sum("n").alias("n"))
    return counts.agg(F.max("similarity").alias("most"), F.min("similarity").alias("least"), (F.sum(F.col("similarity") * F.col("n")) / F.sum("n")).alias("mean"))


def lcs_similarity(pairs: DataFrame, a: str = "a_tokens", b: str = "b_tokens") -> DataFrame:
    """``pairs`` with ``similarity``: 0 if lengths differ by more than 3, 1 if one text has the other, else LCS / shorter."""
    schema = f"{', '.join(f'`{n}` {k}' for n, k in pairs.dtypes)}, similarity double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for x, y in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b)), strict=True):
                one, two = " ".join(x), " ".join(y)
                if abs(len(x) - len(y)) > 3:
                    out.append(0.0)
                elif one in two or two in one:
                    out.append(1.0)
                else:
                    out.append(len(longest_common_subsequence(x, y)) / min(len(x), len(y)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "similarity"])

    return pairs.mapInArrow(run, schema)


def best_match(lines: DataFrame, templates: DataFrame, threshold: float, count_wildcards: bool = False) -> DataFrame:
    """(id, template_id, similarity): the most similar template of the same length, then most wildcards, smallest id.

    lines: (id, tokens); templates: (template_id, tokens). An equi-join on the length.
    """
    t = templates.select("template_id", F.col("tokens").alias("t"), F.size("tokens").alias("n"))
    both = lines.select("id", "tokens", F.size("tokens").alias("n")).join(t, "n").withColumn("s", sequence_similarity(F.col("t"), F.col("tokens"), count_wildcards))
    best = both.filter(F.col("s.similarity") >= threshold).groupBy("id").agg(F.max(F.struct("s.similarity", "s.n_wildcards", (-F.col("template_id")).alias("turned"))).alias("m"))
    return best.select("id", (-F.col("m.turned")).alias("template_id"), F.col("m.similarity").alias("similarity"))


def connected(links: DataFrame, checkpoint) -> DataFrame:
    """(id, component) of links (a, b): labels spread to neighbours until none changes; ``checkpoint`` cuts lineage."""
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("next"), "component")
        # and to the label's own label, which halves long chains
        jump = step.select(F.col("id").alias("_i"), F.col("next").alias("_n"))
        new = checkpoint(step.join(jump, step.next == jump._i, "left").select("id", F.least("next", F.coalesce("_n", "next")).alias("component"), F.col("component").alias("_old")))
        if new.filter("component <> _old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def tfidf(lines: DataFrame, ngrams: int = 1) -> DataFrame:
    """(id, term, weight) of (id, tokens): term frequency times smoothed inverse document frequency, length 1 a line."""
    if ngrams == 2:
        grams = F.concat(F.col("tokens"), F.when(F.size("tokens") > 1, F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.concat_ws(" ", F.get("tokens", i - 1), F.get("tokens", i)))).otherwise(F.array().cast("array<string>")))
    else:
        grams = F.col("tokens")
    terms = lines.select("id", F.explode(grams).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = lines.agg(F.count(F.lit(1)).alias("docs"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = terms.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.withColumn("weight", F.col("w") / norm).select("id", "term", "weight")


def position_vectors(lines: DataFrame) -> DataFrame:
    """(id, term, weight): a token at a position weighs 1 less that position's normalised entropy times types."""
    one = lines.withColumns({"_g": F.lit(1), "n": F.lit(1)})
    stats = position_stats(token_counts(one, ["_g"]), ["_g"]).select("pos", (1 - F.col("entropy_norm") * F.col("types_norm")).alias("weight"))
    return lines.select("id", F.posexplode("tokens").alias("pos", "tok")).join(F.broadcast(stats), "pos").select("id", F.concat_ws(":", F.col("pos").cast("string"), "tok").alias("term"), "weight")


def cosine_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of sparse vectors (id, term, weight) that share a term."""
    norm = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    x, y = vectors.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa")), vectors.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    dots = x.join(y, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = dots.join(norm.withColumnsRenamed({"id": "a", "norm": "na"}), "a").join(norm.withColumnsRenamed({"id": "b", "norm": "nb"}), "b")
    return out.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity")).filter(F.col("similarity") >= least)


def semantic_clusters(lines: DataFrame, checkpoint) -> DataFrame:
    """(id, cluster): components of lines whose vectors are close; the more positions vary, the looser.

    With one point enough for a core, density clustering is components of the graph of pairs within a radius of
    1 - min(0.9, (L - k) / (L - 7 k / 16)) for the greatest length L and k varying positions.
    """
    one = lines.withColumns({"_g": F.lit(1), "n": F.lit(1)})
    shape = token_counts(one, ["_g"]).groupBy("pos").agg(F.count(F.lit(1)).alias("types")).agg(F.count(F.lit(1)).alias("l"), F.count(F.when(F.col("types") > 1, 1)).alias("k")).first()
    length, varying = shape["l"], shape["k"]
    least = min(0.9, (length - varying) / (length - 7 * varying / 16)) if length else 0.9
    found = connected(cosine_pairs(position_vectors(lines), least), checkpoint)
    return lines.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.max("similarity").alias("most"), F.min("similarity").alias("least"), F.avg("similarity").alias("mean"))
