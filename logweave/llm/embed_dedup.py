"""Near-duplicate vectors by sorted projection passes, finished exactly inside the groups that these find.

1. Equal vectors of a label collapse (on the map side first). Each distinct vector gets BITS signs of random projections,
   packed; from here to the last step only these travel, a few bytes for each dimension's worth of floats.
2. In each pass the rows are ordered by label and by the signs, lexicographically and in an order of its own, numbered
   without collecting them, and each row's signs are compared with those of the WINDOW rows behind it. Pairs that differ
   in no more places than linked vectors do (by Z standard deviations) are candidates; what is written of them is one edge
   a row and pass at most, to the first row of its group within the block. The number of passes follows from the number
   of vectors, so that a linked pair is missed by all passes with a chance of MISS at any size, if signs are spread evenly.
3. Candidates of all passes are united to groups. Vectors of different groups aren't linked. Inside a group *all* pairs
   are compared in doubles, in pairs of blocks, as matrix products: windows cap nothing that the passes have connected,
   and links are verified and counted exactly, while no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, ragged
from .components import connected_components

#: Signs of a vector; rows behind a row that it is compared with in a pass; chance that a linked pair is never met.
BITS, WINDOW, MISS = 512, 256, 1e-4
#: Standard deviations that the signs of a linked pair may differ more than they should.
Z = -NormalDist().inv_cdf(1e-6)
#: Rows of a block of a pass, and of a block and a tile of the exact products.
STRIDE, BLOCK, TILE = 2048, 4096, 1024


def differing(cosine: float) -> int:
    """The most places in which the signs of vectors with this cosine differ."""
    p = math.acos(cosine) / math.pi
    return math.floor(BITS * p + Z * math.sqrt(BITS * p * (1 - p)))


def passes_for(rows: int, cosine: float) -> int:
    """Passes until a linked pair has been in a common window: its first log2(rows / WINDOW) signs must agree."""
    same = (1 - math.acos(cosine) / math.pi) ** max(1.0, math.log2(max(2, rows) / WINDOW))
    return max(2, math.ceil(math.log(MISS) / math.log1p(-same)))


def _signs(vectors: DataFrame) -> DataFrame:
    """(n, label, width, signs) of (n, label, width, vector); the projections follow from the width alone."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            width, flat = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(width)
            packed = np.zeros((len(width), BITS // 64), dtype=np.int64)
            for w in np.unique(width).tolist():
                if w not in planes:
                    planes[w] = np.random.default_rng(w).standard_normal((w, BITS))
                at = np.flatnonzero(width == w)
                for lo in range(0, len(at), 1024):
                    some = at[lo : lo + 1024]
                    x = flat[(ends[some] - w)[:, None] + np.arange(w)]
                    x /= np.abs(x).max(axis=1, keepdims=True)  # signs don't depend on lengths, but products may overflow
                    packed[some] = np.packbits(x @ planes[w] >= 0, axis=1).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ragged(list(packed))], ["n", "label", "width", "signs"])

    return vectors.mapInArrow(run, f"n long, label {vectors.schema['label'].dataType.simpleString()}, width int, signs array<long>")


def _turned(signs: Column, turn: int) -> list[Column]:
    """What pass ``turn`` sorts by: words of the signs in an order of its own, their bits rotated."""
    words = BITS // 64
    out = []
    for i in range(2):
        # each pass begins at another bit; two words order finely enough that equal ones fit a window of their own
        word, shift = divmod((turn * 37 + i * 64) % BITS, 64)
        x = F.get(signs, F.lit(word))
        if shift:
            x = F.shiftleft(x, shift).bitwiseOR(F.shiftrightunsigned(F.get(signs, F.lit((word + 1) % words)), 64 - shift))
        out.append(x)
    return out


def _numbered(tables: Tables, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Globally sorted ``rows`` with ``place``, their position: partitions are counted first, nothing is collected."""
    kept = tables.cut(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    starts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = starts.select("_part", "_first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_start"), kept


def _neighbours(rows: DataFrame, most: int) -> DataFrame:
    """(a, b) of rows (block, place, n, label, width, signs): each row with the first of its block's candidate group."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("place")
        count = table.num_rows
        n = table.column("n").to_numpy()
        labels = np.unique(table.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        group = labels.astype(np.int64) * (1 << 32) + table.column("width").to_numpy()
        signs = table.column("signs").combine_chunks().flatten().to_numpy().reshape(count, -1).view(np.uint64)
        roots = np.arange(count)
        for lo in range(0, min(count, STRIDE), 128):
            hi = min(lo + 128, count, STRIDE)
            end = min(hi + WINDOW, count)
            differ = np.zeros((hi - lo, end - lo), dtype=np.uint16)
            for w in range(signs.shape[1]):
                differ += np.bitwise_count(signs[lo:hi, w, None] ^ signs[None, lo:end, w])
            i, j = np.nonzero((differ <= most) & (group[lo:hi, None] == group[None, lo:end]))
            fit = (j > i) & (j - i <= WINDOW)
            if fit.any():
                roots = _unite(roots, i[fit] + lo, j[fit] + lo)
        moved = np.flatnonzero(roots != np.arange(count))
        return pa.table({"a": n[roots[moved]], "b": n[moved]})

    return rows.groupBy("block").applyInArrow(run, "a long, b long")


def _unite(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``roots`` (the first row of each row's component) after the links (i, j)."""
    while True:
        a, b = roots[i], roots[j]
        open_ = a != b
        if not open_.any():
            return roots
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (up := roots[roots]).tolist() != roots.tolist():
            roots = up


def _compare(rows: DataFrame, cosine: float) -> DataFrame:
    """(place, root, near) of rows (lo, hi, block, place, group, copies, vector), by pair of blocks (lo, hi).

    For each row with links: the first row it is connected with in this pair, and the copies it is linked with.
    """

    def run(table):
        import pyarrow as pa

        table = table.sort_by("place")
        place, block, copies = (table.column(c).to_numpy() for c in ("place", "block", "copies"))
        group = table.column("group").to_numpy()
        change = np.flatnonzero(group[1:] != group[:-1]) + 1
        flat = table.column("vector").combine_chunks()
        near, roots = np.zeros(len(place)), np.arange(len(place))
        # two blocks share one group at most, and only rows of both are compared
        across = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
        for lo, hi in zip([0, *change], [*change, len(place)], strict=True):
            if hi - lo < 2:
                continue
            x = flat[lo:hi].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norms = np.sqrt((x * x).sum(axis=1))
            for p in range(0, across or hi - lo, TILE):
                end = min(p + TILE, across or hi - lo)
                for q in range(across or p, hi - lo, TILE):
                    hit = x[p:end] @ x[q : q + TILE].T >= cosine * np.outer(norms[p:end], norms[q : q + TILE])
                    i, j = np.nonzero(np.triu(hit, 1) if p == q else hit)
                    if len(i):
                        i, j = i + lo + p, j + lo + q
                        near += np.bincount(i, copies[j], len(near)) + np.bincount(j, copies[i], len(near))
                        roots = _unite(roots, i, j)
        found = np.flatnonzero(near)
        return pa.table({"place": place[found], "root": place[roots[found]], "near": near[found].astype(np.int64)})

    return rows.groupBy("lo", "hi").applyInArrow(run, "place long, root long, near long")


def embed_dedup(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels are equal and their cosine (in doubles) is at least ``cosine``; copies always
    are. ``n_links`` counts other rows, ``component_id`` is the smallest id reachable, ``kept`` whether it is the row's
    own. Links inside the groups that the passes connect are all found, and none below ``cosine``. Null labels, null or
    zero vectors and those with null or non-finite components link with nothing; nor do vectors of different lengths.
    Vectors that differ only in length of the same direction are not copies but have cosine 1. A row without an id takes
    the class of its copies and doesn't count as a link. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    tables = Tables(vectors.sparkSession, "embed")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    # copies have one key; the vector itself is compared as well
    groups = tables.cut(rows.filter("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("vec_id").alias("copies")))
    reps = tables.cut(groups.filter("rep IS NOT NULL").withColumn("width", F.size("vector")).withColumn("n", F.monotonically_increasing_id()))
    signs = tables.cut(_signs(reps.select("n", "label", "width", "vector")))
    count, edges = signs.count(), None
    for turn in range(passes_for(count, cosine) if count > 1 else 0):
        placed, kept = _numbered(tables, signs.orderBy("label", "width", *_turned(F.col("signs"), turn), "n"))
        # a row also goes to the block before if a window of that one reaches it
        block = F.floor(F.col("place") / STRIDE).cast("long")
        blocks = F.when((F.col("place") % STRIDE < WINDOW) & (block > 0), F.array(block - 1, block)).otherwise(F.array(block))
        found = tables.cut(_neighbours(placed.withColumn("block", F.explode(blocks)), differing(cosine)).distinct())
        tables.drop(kept)
        # what earlier passes have connected stays connected by fewer edges than rows
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        edges = signs.select(F.col("n").alias("a"), F.col("n").alias("b")).limit(0)
    met = _finish(tables, reps, tables.cut(connected_components(edges)), cosine)
    known = reps.join(met, "n", "left").select("label", "vector", "rep", "copies", "near", "component")
    known = known.unionByName(groups.filter("rep IS NULL"), allowMissingColumns=True)
    known = known.select(F.col("label").alias("_l"), F.col("vector").alias("_v"), (F.col("copies") + F.coalesce("near", F.lit(0))).alias("reached"), F.coalesce("component", "rep").alias("component"))
    # rows without a copy or a link needn't be looked up by their vectors; those that have some are
    some = tables.cut(known.filter("reached > 1 OR component IS NULL"))
    out = rows.join(some, (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v")), "left")
    component = F.coalesce("component", "vec_id")
    own = F.when(F.col("vec_id").isNotNull(), 1).otherwise(0)
    return out.select("vec_id", F.coalesce(F.greatest(F.col("reached") - own, F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def _finish(tables: Tables, reps: DataFrame, groups: DataFrame, cosine: float) -> DataFrame:
    """(n, near, component) of the linked vectors: all pairs inside the groups (id, component) compared.

    ``near`` counts the copies that a vector is linked with; ``component`` is the smallest id reachable.
    """
    inside = groups.select(F.col("id").alias("n"), F.col("component").alias("group")).join(reps.select("n", "rep", "copies", "vector"), "n")
    placed, kept = _numbered(tables, inside.orderBy("group", "rep"))
    placed = placed.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    # the groups of more than one block, fewer than there are blocks
    long = placed.groupBy("group").agg(F.min("block").alias("from"), F.max("block").alias("to")).filter("from < to")
    spread = placed.join(F.broadcast(long), "group", "left").withColumn("other", F.explode(F.sequence(F.coalesce("from", "block"), F.coalesce("to", "block"))))
    dealt = spread.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "place", "group", "copies", "vector")
    met = tables.cut(_compare(dealt, cosine))
    # rows of a component are in one group, so its first place has its smallest id
    places = tables.cut(placed.select("place", "n", "rep"))
    labels = connected_components(met.filter("place <> root"), "place", "root").withColumnRenamed("id", "place")
    labels = labels.join(places.select(F.col("place").alias("component"), F.col("rep").alias("smallest")), "component").select("place", F.col("smallest").alias("component"))
    counts = met.groupBy("place").agg(F.sum("near").alias("near"))
    out = tables.cut(places.join(counts, "place").join(labels, "place", "left").select("n", "near", "component"))
    tables.drop(kept, met, places)
    return out
