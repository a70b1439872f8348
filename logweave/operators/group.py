"""Coarse grouping: lines of one component, level and length, by similar n-grams along the first half of the line.

Which group a line joins depends on the order of lines, but only inside its key, and lines with the same content go
the same way. So distinct contents are grouped by key and walked in order of their first line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PARAM

KEY = ["component", "level", "n_tokens"]
LEAVES = "component string, level string, n_tokens int, content string, n long, first_index long, leaf_id long, key_first long"


def similar(a: Sequence[str | None], b: Sequence[str | None]) -> bool:
    """Whether an n-gram may take the branch of another one."""
    size = sum(x is not None for x in a)
    if size < 3:
        return any(x is not None and x == y for x, y in zip(a, b, strict=True))
    wild = [PARAM in (x, y) for x, y in zip(a, b, strict=True)]
    equal = [x == y and not w for x, y, w in zip(a, b, wild, strict=True)]
    if sum(w or e for w, e in zip(wild, equal, strict=True)) < 2 or not any(equal):
        return False
    apart = [not w and not e for w, e in zip(wild, equal, strict=True)]
    return not any(d and (i and wild[i - 1] or i + 1 < len(a) and wild[i + 1]) for i, d in enumerate(apart))


class _Node:
    __slots__ = ("children", "lines")

    def __init__(self) -> None:
        self.children: dict[tuple, _Node] = {}
        self.lines: list[int] = []


def walk(lines: list[list[str]], depth: int = 500) -> list[list[int]]:
    """Leaves, in the order of the tree, as positions in ``lines``, which are in order of arrival."""
    root = _Node()
    for place, t in enumerate(lines):
        node, levels = root, min(-(-len(t) // 2), max(1, depth - 3))
        for i in range(levels):
            gram = tuple(t[i : i + 3])
            gram += (None,) * (3 - len(gram))
            child = node.children.get(gram)
            if child is None:
                child = next((c for other, c in node.children.items() if similar(gram, other)), None)
            if child is None:
                child = node.children[gram] = _Node()
            node = child
        node.lines.append(place)
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.lines:
            out.append(node.lines)
        stack += reversed(node.children.values())
    return out


def coarse_groups(contents: DataFrame, depth: int = 500) -> DataFrame:
    """Distinct (component, level, content, tokens, n, first_index) with leaf_id, dense within the key, and key_first."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("first_index")
        leaf = [0] * table.num_rows
        for i, places in enumerate(walk([c.split(" ") if c else [] for c in table.column("content").to_pylist()], depth)):
            for p in places:
                leaf[p] = i
        first = table.column("first_index")[0].as_py()
        return table.append_column("leaf_id", pa.array(leaf, pa.int64())).append_column("key_first", pa.array([first] * len(leaf), pa.int64()))

    rows = contents.withColumn("n_tokens", F.size("tokens")).select(*KEY, "content", "n", "first_index")
    leaves = rows.groupBy(*KEY).applyInArrow(run, LEAVES)
    # a content is its tokens joined by a space
    return leaves.withColumn("tokens", F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(F.split("content", " ")))


def ready(leaves: DataFrame, last: bool, distinct: int = 2, lines: int = 100) -> DataFrame:
    """``leaves`` with whether their templates are due: several contents, many lines or no more to come."""
    key = [*KEY, "leaf_id"]
    due = leaves.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_l"))
    due = due.select(*key, (F.lit(last) | (F.col("_c") > distinct) | (F.col("_l") > lines)).alias("ready"))
    return leaves.join(due, key)
