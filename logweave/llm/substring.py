"""Removal of passages that another document has already, by level-wise doubling.

Windows are compared at a short length first; those that repeat are extended to twice the length, until the full length
is reached or no candidates survive. At a length below the full one, not every position is needed: among the shorter
windows inside a full window, the one with the smallest hash is its anchor. Equal windows have equal anchors, so a full
window whose anchors don't all occur in a second document can't either, and only about two in ``window - length``
positions are ever shuffled. Hash counts are added up on the map side, so a passage that every document has sends one row
from each task. Documents that have the words of a smaller id in full are set apart before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SPACE, Tables, bytes_of, cut, mix, pieces, restrict, small_batches, window_hashes, word_count, word_hashes

_SECOND = np.uint64(0xA0761D6478BD642F)


#: Doublings up to the full window.
STEPS = 3


def levels(window: int, steps: int = STEPS) -> list[int]:
    """Lengths that double up to ``window``, after ``steps`` doublings."""
    out = [window]
    while len(out) <= steps and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def _anchors(words: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``length`` words; for each full window, where its anchor is."""
    hashes = window_hashes(words, length)
    span = window - length + 1
    if len(hashes) < span:
        return hashes, np.empty(0, dtype=np.int64)
    starts = np.arange(len(hashes) - span + 1)
    return hashes, starts if span == 1 else starts + np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(axis=1)


def candidates(raw: bytes, length: int, window: int, before: int | None, survivors: np.ndarray | None) -> np.ndarray:
    """Two hashes of each anchor of ``length`` words, for full windows whose anchors of ``before`` words all survive."""
    words = word_hashes(raw)
    hashes, at = _anchors(words, length, window)
    if before and len(at):
        shorter, own = _anchors(words, before, window)
        at = at[np.isin(shorter[own], survivors)]
    at = np.unique(at)
    found = np.unique(hashes[at], return_index=True)
    if length < window:
        return found[0][None, :]
    # a second, independent hash of the same words
    second = window_hashes(mix(words ^ _SECOND), length)
    return np.stack([found[0], second[at[found[1]]]])


def _level(docs: DataFrame, length: int, window: int, before: int | None) -> DataFrame:
    """(h, g, doc_id) of (doc_id, text[, hashes])."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            lists = batch.column(2) if before else None
            out, ids = [], []
            for i, (doc_id, raw) in enumerate(zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True)):
                known = np.asarray(lists[i].values).view(np.uint64) if before else None
                made = candidates(raw, length, window, before, known)
                out.append(made)
                ids.append(np.full(made.shape[1], doc_id, dtype=np.int64))
            both = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[-1]), pa.array(np.concatenate(ids))], ["h", "g", "doc_id"])

    return small_batches(docs).mapInArrow(run, "h long, g long, doc_id long")


def _lists(tables: Tables, rows: DataFrame, repeated_only: bool) -> DataFrame:
    """(doc_id, hashes): windows that occur in two documents, or else those that a smaller id has."""
    key = ["h"] if repeated_only else ["h", "g"]
    rows = tables.cut(rows.select(*key, "doc_id"))  # read twice, made once
    owners = rows.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    found = rows.join(owners, key)
    if not repeated_only:
        found = found.filter("doc_id > low")
    lists = tables.cut(found.groupBy("doc_id").agg(F.collect_set("h").alias("hashes")))
    tables.drop(rows)
    return lists


def _strip(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of (doc_id, text, hashes)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            counts, removed, kept = [], [], []
            for raw, hashes in zip(bytes_of(batch.column(1)), batch.column(2), strict=True):
                words, gone = raw.split(), 0
                if hashes.is_valid:
                    hit = np.flatnonzero(np.isin(window_hashes(word_hashes(raw), window), np.asarray(hashes.values).view(np.uint64)))
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, hit, 1)
                    np.add.at(change, hit + window, -1)
                    keep = np.cumsum(change[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words_kept = compress(words, keep)
                else:
                    words_kept = words
                counts.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(words_kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return small_batches(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def drop_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if it is in a run of ``window`` words that also starts in a document with a smaller id, as the input
    has it. A null text has no words; a text shorter than the window loses nothing. Repeats within a document and
    between rows with one id stay. A row without an id neither loses words nor makes others lose them. Texts of any length
    are compared whole. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", " "))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(bare)).alias("words"))
    # a document with the words of a smaller id loses them all, and what it has, that one has: it needs no comparison
    owners = cut(texts.groupBy("words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high"))
    owned = texts.join(F.broadcast(owners) if owners.count() <= BROADCAST_IDS else owners, "words", "left")
    copies = owned.filter("doc_id > low").select("doc_id", word_count(F.col("text")).alias("n_words"), F.trim(F.regexp_replace("text", SPACE + "+", " ")).alias("bare"))
    gone = F.col("n_words") >= window
    copies = copies.select("doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(gone, "").otherwise(F.coalesce("bare", F.lit(""))).alias("kept_text"))
    fresh = owned.filter("doc_id IS NULL OR low IS NULL OR doc_id <= low").select("doc_id", "text")
    named = fresh.filter(F.col("doc_id").isNotNull())
    tables = Tables(docs.sparkSession, "passages")
    lists: DataFrame | None = None
    before = None
    for length in levels(window):
        inside = named if lists is None else restrict(named, lists.select("doc_id"), "doc_id").join(lists, "doc_id").select("doc_id", "text", "hashes")
        after = _lists(tables, _level(inside, length, window, before), length < window)
        tables.drop(lists)
        lists, before = after, length
        if lists.isEmpty():
            break  # no candidate survives
    ids = lists.select("doc_id")
    hit = restrict(named, ids, "doc_id").join(lists, "doc_id").select("doc_id", "text", "hashes")
    # left_anti also keeps rows without an id
    clear = restrict(fresh, ids, "doc_id", "left_anti").withColumn("hashes", F.lit(None).cast("array<long>"))
    return _strip(hit, window).unionByName(_strip(clear, window)).unionByName(copies)
