"""Toxicity as an ordinal severity: a cumulative-link model on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all thresholds and theta_1 <= theta_2 <= ...; the
expected severity is the sum of these over k. Features are the distinct lower-cased words of the whole text and the
beginnings of longer words. Labels say toxic or not; the grade of a toxic document follows from log odds that the other
half of the sample gives its features, so that grades mean the same for samples of any size. The threshold from which a
document counts as toxic comes from cross-validation. The model is fitted on the driver on a sample of labelled
documents that is bounded in rows and bytes; its vocabulary is bounded too, so what goes to the executors doesn't grow
with the data. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, free_name, mix, pieces, ragged, small_batches, word_hashes

#: Labelled documents and bytes of them that the model is fitted on at most, features it has at most, the highest grade.
SAMPLE, SAMPLE_BYTES, VOCABULARY, GRADES = 6_000, 64 << 20, 20_000, 3
#: Nats of likelihood that a feature must gain, so that chance finds of rare words stay out.
GAIN = 8.0
#: Parts of the cross-validation, and how many missed toxic documents one false alarm is worth there.
FOLDS, ALARM = 3, 10.0
HEADS = (4, 6)  # bytes of a longer word's beginning that are features
_PUNCTUATION = bytes(c if c < 128 and chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def text_features(raw: bytes) -> np.ndarray:
    """Sorted distinct feature hashes of a text."""
    clean = raw.decode("utf-8", "replace").lower().encode().translate(_PUNCTUATION)
    parts = [word_hashes(clean)]
    for head in HEADS:
        parts.append(mix(word_hashes(clean, head) + np.uint64(head)))
    return np.unique(np.concatenate(parts))


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one for each grade above 0
    limit: float = 0.5  # P(grade >= 1) from which a document is toxic

    def scores(self, features: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        z = 0.0
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, features), len(self.vocabulary) - 1)
            z = float(self.weights[at[self.vocabulary[at] == features]].sum())
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -500, 500)))


def _counts(docs: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All features, in how many documents and toxic documents each is, and the likelihood that it gains."""
    every, place = np.unique(np.concatenate(docs), return_inverse=True)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    n = np.bincount(place, minlength=len(every)).astype(float)
    k = np.bincount(place, weights=toxic[owner], minlength=len(every))
    t, total = toxic.sum(), len(docs)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    gain = part(k, n * t / total) + part(n - k, n * (total - t) / total) + part(t - k, (total - n) * t / total) + part(total - t - n + k, (total - n) * (total - t) / total)
    return every, n, k, gain


def _vocabulary(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The features that tell toxic from clean documents best, by a likelihood ratio statistic."""
    every, _, _, gain = _counts(docs, toxic)
    clear = np.flatnonzero(gain >= GAIN)
    return np.sort(every[clear[np.argsort(-gain[clear], kind="stable")[:VOCABULARY]]])


def fit(docs: list[np.ndarray], grades: np.ndarray, steps: int = 300, penalty: float = 2e-4) -> Model:
    """Fit by Adam on the ordinal log-likelihood with a ridge penalty; deterministic."""
    top = max(1, int(grades.max(initial=0)))
    if not len(docs) or not (grades > 0).any() or not (grades == 0).any():
        never = len(docs) == 0 or not (grades > 0).any()
        return Model(np.empty(0, dtype=np.uint64), np.empty(0), np.full(top, 50.0 if never else -50.0))
    vocabulary = _vocabulary(docs, (grades > 0).astype(float))
    rows, cols = [], []
    for i, d in enumerate(docs):
        at = np.minimum(np.searchsorted(vocabulary, d), max(0, len(vocabulary) - 1))
        hit = at[vocabulary[at] == d] if len(vocabulary) else at[:0]
        rows.append(np.full(len(hit), i))
        cols.append(hit)
    row, col = np.concatenate(rows), np.concatenate(cols)
    m, n = len(vocabulary), len(docs)
    w, theta = np.zeros(m), np.linspace(1.0, 2.0, top)
    mean, square = np.zeros(m + top), np.zeros(m + top)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=n)
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -30, 30)))  # P(grade >= k)
        # P(grade = g) = tail[g] - tail[g + 1]
        wide = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        p = np.maximum(wide[np.arange(n), grades] - wide[np.arange(n), grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], axis=1)
        up, down = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        dz = -(up - down) / p / n
        dtheta = np.zeros(top)
        np.add.at(dtheta, np.maximum(grades - 1, 0), np.where(grades > 0, up / p, 0) / n)
        np.add.at(dtheta, np.minimum(grades, top - 1), np.where(grades < top, -down / p, 0) / n)
        grad = np.concatenate([np.bincount(col, weights=dz[row], minlength=m) + penalty * w, dtheta])
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w -= move[:m]
        theta = np.maximum.accumulate(theta - move[m:])
        theta += np.arange(top) * 1e-6  # stay in order
    return Model(vocabulary, w, theta)


def severity_grades(docs: list[np.ndarray], toxic: np.ndarray, top: int = GRADES) -> np.ndarray:
    """Grades from yes-or-no labels: 0 if clean, else 1 to ``top`` by the log odds of a document's features.

    Each half of the sample is scored by the odds that the other half has for features over ``GAIN``; the sums of the
    toxic documents are cut at their quantiles. Many equal sums may leave a grade empty.
    """
    grades = np.zeros(len(docs), dtype=np.int64)
    toxic = np.asarray(toxic, dtype=bool)
    score, half = np.zeros(len(docs)), np.arange(len(docs)) % 2
    for side in (0, 1):
        known, asked = np.flatnonzero(half != side), np.flatnonzero((half == side) & toxic)
        if not len(known) or not len(asked) or not toxic[known].any():
            continue
        labels = toxic[known].astype(float)
        every, n, k, gain = _counts([docs[i] for i in known], labels)
        t, c = labels.sum(), len(known) - labels.sum()
        odds = np.where(gain >= GAIN, np.log((k + 0.5) / (t + 1)) - np.log((n - k + 0.5) / (c + 1)), 0.0)
        for i in asked:
            at = np.minimum(np.searchsorted(every, docs[i]), max(0, len(every) - 1))
            score[i] = odds[at[every[at] == docs[i]]].sum() if len(every) else 0.0
    if toxic.any():
        cuts = np.quantile(score[toxic], np.arange(1, top) / top)
        grades[toxic] = 1 + np.searchsorted(cuts, score[toxic], side="left")
    return grades


def held_out(docs: list[np.ndarray], grades: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """P(grade >= 1) of each document by a model fitted on the other folds."""
    fold, out = np.arange(len(docs)) % folds, np.zeros(len(docs))
    for f in range(folds):
        rest = np.flatnonzero(fold != f)
        model = fit([docs[i] for i in rest], grades[rest])
        for i in np.flatnonzero(fold == f):
            out[i] = model.scores(docs[i])[0]
    return out


def best_limit(chances: np.ndarray, toxic: np.ndarray) -> float:
    """The limit with the fewest missed toxic documents and false alarms, the latter ``ALARM`` times; half way down to the
    next lower chance on the scale of log odds."""
    order = np.argsort(-chances, kind="stable")
    p, y = chances[order], np.asarray(toxic, dtype=bool)[order]
    if not y.any() or y.all():
        return 0.5
    cost = (y.sum() - np.cumsum(y)) + ALARM * np.cumsum(~y)
    last = np.r_[p[1:] != p[:-1], True]  # a limit can't part equal chances
    at = int(np.flatnonzero(last)[np.argmin(cost[last])])
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    below = z[at + 1] if at + 1 < len(z) else z[at]
    return float(1 / (1 + np.exp(-(z[at] + below) / 2)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` documents with a label, chosen by a hash of their ids.

    They have ``SAMPLE_BYTES`` of text together at most; later ones in the order of hashes are left out. A label over 0 is
    toxic; of several labels of one id the highest counts, of several texts the first in code point order. Null ids,
    labels and texts are left out, other columns ignored. Without toxic documents in the sample, or without any, the model
    finds nothing toxic.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = texts.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id").groupBy("doc_id", "label").agg(F.max("size").alias("size"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # at most ``sample`` rows of numbers
    room = np.cumsum([r["size"] for r in chosen]) <= SAMPLE_BYTES
    place = {r.doc_id: i for i, (r, fits) in enumerate(zip(chosen, room, strict=True)) if fits}
    if not place:
        return fit([], np.empty(0, dtype=np.int64))
    few = docs.sparkSession.createDataFrame([(r.doc_id, int(r.label)) for r in chosen if r.doc_id in place], "doc_id long, label long")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ragged([text_features(raw).view(np.int64) for raw in bytes_of(batch.column(2))])], ["doc_id", "label", "features"])

    one = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    table = small_batches(one).mapInArrow(run, "doc_id long, label long, features array<long>").toArrow()
    order = np.argsort([place[i] for i in table.column("doc_id").to_pylist()], kind="stable")
    lists = [np.asarray(x.values).view(np.uint64) for x in table.column("features")]
    found = [lists[i] for i in order]
    toxic = table.column("label").to_numpy()[order] > 0
    grades = severity_grades(found, toxic)
    model = fit(found, grades)
    model.limit = best_limit(held_out(found, grades), toxic)
    return model


def toxicity(docs: DataFrame, model: Model, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keep`` columns, severity, grade, p_toxic, toxic, kept.

    ``severity`` is the expected grade, ``grade`` the most probable one, ``p_toxic`` P(grade >= 1); ``toxic`` and not
    ``kept`` if that is at least ``threshold``, by default the model's own. Null and empty texts have no features and score
    by the thresholds alone; texts of any length are taken whole. Ids may be null or repeat. ``keep`` may not name a column
    like one of the result; other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    limit = model.limit if threshold is None else threshold
    if taken := {"doc_id", "severity", "grade", "p_toxic", "toxic", "kept"} & set(keep):
        raise ValueError(f"kept columns would clash with the result's: {', '.join(sorted(taken))}")
    rows = docs.select(F.col(text_col).alias(free_name(keep)), F.col(id_col).alias("doc_id"), *keep)
    names = rows.columns[1:]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            tails = np.array([model.scores(text_features(raw)) for raw in bytes_of(batch.column(0))])
            chances = np.concatenate([np.ones((len(tails), 1)), tails], axis=1) - np.concatenate([tails, np.zeros((len(tails), 1))], axis=1)
            made = [tails.sum(axis=1).round(9), chances.argmax(axis=1).astype(np.int32), tails[:, 0].round(9), tails[:, 0] >= limit, tails[:, 0] < limit]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, made)], [*names, "severity", "grade", "p_toxic", "toxic", "kept"])

    return small_batches(rows).mapInArrow(run, f"{kinds}, severity double, grade int, p_toxic double, toxic boolean, kept boolean")
