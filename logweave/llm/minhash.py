"""Near-duplicate documents by b-bit MinHash.

One pass over the texts gives each document its set of word shingles as 64-bit hashes, and of it only the size, a
128-bit fingerprint, a key per band of minima, the low bits of all minima, packed in bit planes, and the parity of how
many shingles fall on each of 1024 places (an odd sketch). Then:

1. documents with the same set collapse to the smallest id (the map side collapses copies first);
2. representatives that share a band key are candidates, pruned by the similarity that the packed bits estimate,
   corrected for chance collisions, with a margin of Z standard deviations, and by the odd sketch: places where two
   sketches differ hold a shingle that only one of the sets has, which bounds the similarity without any error;
3. what is left is confirmed on the full sets.

Pairs within a component need no comparison, since only the components are asked for. So first each bucket's members are
compared with a few leaders, and each is confirmed with the most alike of them: a group of n near copies costs a small
multiple of n. In the last turn the members that are not in the largest component of their bucket are compared with the
members of other components. So no link between components is lost. All tests but the confirmation are part of the
joins' conditions: pairs that fail them are never written or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, attach, bytes_of, mix, pieces, ragged, restrict, small_batches, window_hashes, word_hashes
from .components import connected_components

BITS = 4  # kept of each minimum
ROWS = 6  # minima in a band's key
MISS = 1e-6  # chance that a pair at the threshold shares no band
Z = -NormalDist().inv_cdf(MISS)  # standard deviations that an estimate may be too low
ODD = 1024  # places of the odd sketch
#: Turns with leaders, and leaders of a bucket in each.
ROUNDS, LEADERS = 2, 4


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``k``-word shingles, A-Z lower-cased; fewer words are one shingle."""
    words = word_hashes(raw.lower())
    if 0 < len(words) < k:
        words, k = words, len(words)
    return np.unique(window_hashes(words, k))


class _Signer:
    def __init__(self, bands: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        n = bands * ROWS
        self.bands, self.n = bands, n
        self.times = rng.integers(0, 2**32, (n, 1), dtype=np.uint32) | np.uint32(1)
        self.plus = rng.integers(0, 2**32, (n, 1), dtype=np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.n, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(short), 512):
            made = short[at : at + 512] * self.times
            made += self.plus
            np.minimum(out, made.min(axis=1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(self.bands, ROWS).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        return key.view(np.int64)

    def planes(self, minima: np.ndarray) -> np.ndarray:
        """BITS planes of ceil(n / 64) words: bit i of plane j is bit j of minimum i."""
        words = -(-self.n // 64)
        bits = np.zeros((BITS, words * 64), dtype=np.uint8)
        bits[:, : self.n] = (minima[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
        return np.packbits(bits, axis=1).view(">u8").astype(np.int64).ravel()


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """ODD bits as longs: whether an odd number of shingles falls on each place."""
    parity = np.bincount((shingles & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(parity.astype(np.uint8)).view(">u8").astype(np.int64)


def features(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands, planes, odd) of (doc_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        signer = _Signer(bands)
        none = np.empty(0, dtype=np.int64)
        for batch in pieces(batches):
            sizes, f1, f2, keys, planes, odd = [], [], [], [], [], []
            for raw in bytes_of(batch.column(1)):
                s = shingle_set(raw, shingle)
                sizes.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).view(np.int64)))
                minima = signer.minima(s) if len(s) else None
                keys.append(none if minima is None else signer.keys(minima))
                planes.append(none if minima is None else signer.planes(minima))
                odd.append(none if minima is None else odd_sketch(s))
            ints = [pa.array(x, pa.int64()) for x in (sizes, f1, f2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ints, ragged(keys), ragged(planes), ragged(odd)], ["doc_id", "n_shingles", "f1", "f2", "bands", "planes", "odd"])

    return small_batches(docs).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, planes array<long>, odd array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, members) of (doc_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged([shingle_set(raw, shingle).view(np.int64) for raw in bytes_of(batch.column(1))])], ["doc_id", "members"])

    return small_batches(docs).mapInArrow(run, "doc_id long, members array<long>")


def estimate(a: Column, b: Column, bands: int) -> Column:
    """Jaccard similarity from packed planes: the share of equal minima, less what chance makes equal."""
    n = bands * ROWS
    words = -(-n // 64)
    differ = F.lit(0)
    for w in range(words):
        wrong = F.lit(0).cast("long")
        for j in range(BITS):
            wrong = wrong.bitwiseOR(F.get(a, F.lit(j * words + w)).bitwiseXOR(F.get(b, F.lit(j * words + w))))
        differ = differ + F.bit_count(wrong)
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(n))) - chance) / (1 - chance)


def at_least_apart(a: Column, b: Column) -> Column:
    """A lower bound of how many shingles are in one set only, from their odd sketches."""
    differ = F.lit(0)
    for w in range(ODD // 64):
        differ = differ + F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))))
    return differ


def margin(threshold: float, bands: int) -> float:
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return Z * math.sqrt(p * (1 - p) / (bands * ROWS)) / (1 - chance)


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, group_id.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``shingle``-word shingles
    (lower-cased A-Z, distinct; a text with fewer words is one shingle). ``component_id`` is the smallest id reachable
    by links, ``kept`` whether it is the row's own, ``group_id`` the smallest id with the same set. Texts that are null
    or without words have no shingles and link with nothing. Rows with one id are one node, with the links of all their
    texts; identical rows are one node too. A row without an id takes the class of its copies and is not kept if it has
    any with an id; else its class is null and it is kept. A text of any length is taken whole: words are hashed in
    blocks of a megabyte, and what travels of a text is fixed in size until a link of it is confirmed. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    threshold = percent / 100
    bands = bands_for(threshold)
    tables = Tables(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = tables.cut(features(texts, shingle, bands))
    same = ["f1", "f2", "n_shingles"]
    # only sets that several rows have need to be looked up; the map side adds copies up first
    several = tables.cut(feats.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    own = feats.filter("n_shingles > 0")
    alone = attach(own, several.select(*same), same, "left_anti").filter("doc_id IS NOT NULL")
    first = attach(own, several, same, "inner").filter("doc_id = smallest").dropDuplicates(["doc_id", *same])
    reps = alone.unionByName(first.drop("smallest")).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "planes", "odd")

    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key")
    live = tables.cut(rows.join(shared, "key").distinct())
    labels = _labels(tables, live, reps.drop("bands"), texts, shingle, percent, bands)
    tables.drop(live)
    members = attach(feats.select("doc_id", *same), several, same).select("doc_id", "n_shingles", F.when(F.col("smallest").isNotNull(), F.col("smallest")).when(F.col("n_shingles") > 0, F.col("doc_id")).alias("group_id"))
    out = attach(members, labels.withColumnRenamed("id", "group_id"), "group_id")
    component = F.coalesce("component", "group_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        F.coalesce("group_id", "doc_id").alias("group_id"),
    )


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "planes", "odd")])


def _similar(percent: int, bands: int) -> Column:
    """What a pair in the columns of ``_side`` must pass before its full sets are compared.

    Sizes and the odd sketch rule out nothing that is linked; the packed minima do so with a chance of about MISS.
    """
    sizes = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    rated = estimate(F.col("planes_x"), F.col("planes_y"), bands) >= percent / 100 - margin(percent / 100, bands)
    # of two linked sets a and b at most (100 - percent) / (100 + percent) * (|a| + |b|) shingles are in one only
    apart = at_least_apart(F.col("odd_x"), F.col("odd_y")) * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)
    return sizes & rated & apart


def _confirm(tables: Tables, pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b), materialised and distinct, that the full sets link."""
    ids = tables.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = tables.cut(full_sets(restrict(texts, ids, "doc_id"), shingle).filter(F.size("members") > 0))

    def of(x: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(x), F.col("members").alias(f"members_{x}"))

    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("members_a", "members_b"))
    both = both.select("a", "b", common.alias("common"), (F.size("members_a") + F.size("members_b") - common).alias("union"))
    links = tables.cut(both.filter(F.col("common") * 100 >= F.col("union") * percent).select("a", "b").distinct())
    tables.drop(ids, sets)
    return links


def _labels(tables: Tables, live: DataFrame, sketches: DataFrame, texts: DataFrame, shingle: int, percent: int, bands: int) -> DataFrame:
    """(id, component) of the linked representatives. live: (id, key) of buckets with several members."""
    narrow = live.select("id").distinct()
    state = tables.cut(live.join(sketches.join(narrow, "id", "left_semi"), "id").withColumn("component", F.col("id")))
    links, labels = None, state.select("id", "component").limit(0)
    for turn in range(ROUNDS):
        rated = tables.cut(_to_leaders(state, turn, percent, bands))
        found = _confirm(tables, rated, texts, shingle, percent)
        tables.drop(rated)
        if found.isEmpty():
            break  # leaders no longer help
        links = found if links is None else links.unionByName(found)
        labels = tables.cut(connected_components(links))
        joined = attach(state.drop("component"), labels, "id").withColumn("component", F.coalesce("component", "id"))
        open_ = tables.cut(joined.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"))
        after = tables.cut(joined.join(open_, "key", "left_semi"))
        tables.drop(state, open_)
        state = after
    rated = tables.cut(_between_components(state, percent, bands))
    found = _confirm(tables, rated, texts, shingle, percent)
    tables.drop(rated, state)
    if found.isEmpty():
        return labels
    return tables.cut(connected_components(found if links is None else links.unionByName(found)))


def _to_leaders(state: DataFrame, turn: int, percent: int, bands: int) -> DataFrame:
    """(a, b): each member with the most alike leader of its buckets, if there is one of another component.

    Leaders differ from turn to turn; they go by a hash of the id alone, so a group has the same ones in all its buckets.
    """
    order = F.xxhash64(F.lit(turn), "id")
    first = state.groupBy("key", F.pmod(order, F.lit(LEADERS)).alias("_class")).agg(F.min(order).alias("_order")).select("key", "_order")
    x = _side(state.withColumn("_order", order).join(first, ["key", "_order"]), "x")
    met = x.join(_side(state, "y"), "key").filter((F.col("component_x") != F.col("component_y")) & _similar(percent, bands))
    score = estimate(F.col("planes_x"), F.col("planes_y"), bands)
    best = met.groupBy("id_y").agg(F.max(F.struct(score.alias("score"), F.bitwise_not("id_x").alias("turned"))).alias("best"))
    pairs = best.select(F.col("id_y").alias("y"), F.bitwise_not("best.turned").alias("x"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _between_components(state: DataFrame, percent: int, bands: int) -> DataFrame:
    """(a, b): members outside of their bucket's largest component, with all that are in other components."""
    main = state.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("_main"))
    placed = state.join(main, "key").withColumn("_inner", F.col("component") == F.col("_main"))
    x = _side(placed.filter("NOT _inner"), "x")
    y = placed.select("key", "_inner", *[F.col(c).alias(f"{c}_y") for c in ("id", "component", "n", "planes", "odd")])
    once = F.col("_inner") | (F.col("id_x") < F.col("id_y"))
    met = x.join(y, "key").filter((F.col("component_x") != F.col("component_y")) & once & _similar(percent, bands))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
