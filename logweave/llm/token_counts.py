"""Token counts of a piece BPE by dynamic programming over prefixes.

No piece of the vocabulary has a space mark behind another character, so a text falls into chunks (space marks and
what follows) that merge independently. Inside a chunk, the last token of each prefix's exact encoding is the one piece
that ends there and is compatible with the last token of what is before it (two pieces are compatible if merging their
joined text gives just them). So two numbers a prefix, its count and the length of its last token, extend to the next,
and a chunk of any length needs two arrays of its length and no copies of its prefixes. The count at any prefix of a text
is the sum over the chunks before it plus the entry of the chunk's prefix: lengths, truncation points and budgets are
read from the arrays without encoding again. Runs of space marks have pieces of their own, which all merge last and from
the left, so their counts are a division.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches
from .merging import merge

MARK = "▁"
#: Bytes of chunks and of pairs that a worker remembers (those asked for lately twice), and letters of the longest chunk.
MEMORY, LONGEST = 96 << 20, 48
#: What a remembered chunk and a pair cost besides their letters.
_CHUNK, _PAIR = 180, 180


class Counter:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = {i for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.scores = {model.id_to_piece(i): -model.get_score(i) for i in range(model.vocab_size()) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece has a space inside: chunks aren't independent")
        probe = model.normalize("a \n\t b")
        if probe != f"{MARK}a{MARK}\n\t{MARK}b":
            raise ValueError("this counter needs a model that normalises nothing but spaces and adds a leading one")
        # pieces of several marks have one score, behind all others; then runs merge from the left, into longest ones
        runs = {p: r for p, r in self.scores.items() if p.startswith(MARK * 2)}
        self.run = max(map(len, runs), default=1)
        last = max((r for p, r in self.scores.items() if len(p) > 1 and p not in runs), default=0.0)
        self.rests = [self.exact(MARK * i) for i in range(self.run)]
        plain = all(not p.strip(MARK) for p in runs) and (not runs or set(runs.values()) == {max(last + 1, *runs.values())})
        if not plain or any(self.exact(MARK * i) != self.marks(i) for i in range(4 * self.run)):
            raise ValueError("this counter needs pieces of space marks that merge last and from the left")
        long = [p for p in self.scores if len(p) > 1 and p not in runs]
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in long))
        self.chunks = re.compile(f"{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+" + (f"|[{re.escape(alone)}]" if alone else "")).findall
        # lengths of the pieces that end in each two characters, longest first
        ends: dict[str, set[int]] = {}
        for p in long:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {c: tuple(sorted(n, reverse=True)) for c, n in ends.items()}
        self.totals: dict[str, int] = {}  # of whole chunks
        self.old: dict[str, int] = {}  # those remembered before
        #: By the joined text of two pieces, two bits for each length of the second: whether it is known, and whether they fit.
        self.fits: dict[str, int] = {}
        self.before, self.arrays = "", ([0], [0], [0])  # the last chunk, and of its prefixes: count, first and last token
        self.held = 0

    def rank(self, a: str, b: str) -> float | None:
        return self.scores.get(a + b)

    def width(self, token: str) -> int:
        """Tokens that a piece counts for: a character that isn't in the vocabulary falls back to bytes."""
        return 1 if token in self.scores else len(token.encode())

    def exact(self, chunk: str) -> int:
        """The count by merging."""
        return sum(map(self.width, merge(chunk, self.rank)))

    def marks(self, n: int) -> int:
        """The count of a run of ``n`` space marks."""
        return n // self.run + self.rests[n % self.run]

    def compatible(self, joined: str, length: int) -> int:
        """Whether merging ``joined`` gives its last ``length`` characters and the rest as one piece each: 2 if so, else 0."""
        if len(self.fits) * _PAIR >= MEMORY // 3:
            self.fits.clear()
        at = len(joined) - length
        fit = 2 * (merge(joined, self.rank) == ([joined[:at], joined[at:]] if at else [joined]))
        self.fits[joined] = self.fits.get(joined, 0) | (1 | fit) << 2 * length
        return fit

    def table(self, chunk: str) -> tuple[list[int], list[int]]:
        """For each prefix of a chunk with at most one space mark, from the empty one: its count, its first token's length.

        What the chunk shares with the one before is there already; the lists are the next call's too, and may be longer.
        """
        scores, known, ends, n = self.scores, self.fits.get, self.ends, len(chunk)
        before, (counts, firsts, lasts) = self.before, self.arrays
        same, most = 0, min(len(before), n)
        while same < most and before[same] == chunk[same]:
            same += 1
        if len(counts) <= n:
            for x in self.arrays:
                x.extend([0] * (n + 1 - len(x)))
        for i in range(same + 1, n + 1):
            at = i - 1
            for length in ends.get(chunk[i - 2 : i], ()) if i > 1 else ():
                start = i - length
                if start < 0 or chunk[start:i] not in scores:
                    continue
                joined = chunk[start - lasts[start] : i]
                fit = known(joined, 0) >> 2 * length
                if (fit if fit & 1 else self.compatible(joined, length)) & 2:
                    at = start
                    break
            counts[i] = counts[at] + (1 if i - at > 1 else self.width(chunk[at:i]))
            firsts[i], lasts[i] = firsts[at] or i, i - at
        self.before = chunk
        if n > LONGEST:  # nor are these arrays kept
            self.before, self.arrays = "", ([0], [0], [0])
        return counts, firsts

    def counts(self, chunk: str) -> list[int]:
        """The count at every prefix of a chunk, from one character on."""
        marks = len(chunk) - len(chunk.lstrip(MARK))
        if marks < 2:
            return self.table(chunk)[0][1 : len(chunk) + 1]
        made = [self.marks(i) for i in range(1, marks + 1)]
        counts, firsts = self.table(chunk[marks - 1 :])
        # the last mark is in the first token of what follows, or one of the run
        with_, without = self.marks(marks - 1), made[-1]
        return made + [counts[i] + with_ if firsts[i] > 1 else counts[i] - 1 + without for i in range(2, len(chunk) - marks + 2)]

    def total(self, chunk: str) -> int:
        return self.counts(chunk)[-1] if chunk.startswith(MARK * 2) else self.table(chunk)[0][len(chunk)]

    def split(self, text: str) -> list[str]:
        return self.chunks(MARK + text.replace(" ", MARK)) if text else []

    def prefixes(self, text: str) -> list[int]:
        """The exact token count of text[:i] for i from 0 to len(text)."""
        out, done = [0], 0
        for chunk in self.split(text):
            made = self.counts(chunk)
            out += [done + x for x in made]
            done += made[-1]
        return [0, *out[2:]] if text else out

    def measure(self, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Each text's count, and the length of its longest prefix within the limit."""
        split = [self.split(t) for t in texts]
        if self.held >= MEMORY // 3:
            self.old, self.totals, self.held = self.totals, {}, 0
        every = set().union(*split) - self.totals.keys() if split else set()
        long = []
        for chunk in sorted(every):  # neighbours share prefixes
            known = self.old.get(chunk)
            self.totals[chunk] = self.total(chunk) if known is None else known
            if len(chunk) > LONGEST:
                long.append(chunk)
            else:
                self.held += _CHUNK + len(chunk)
        get = self.totals.__getitem__
        counts, fit = [], []
        for text, chunks in zip(texts, split, strict=True):
            n = sum(map(get, chunks))
            counts.append(n)
            fit.append(len(text) if n <= limit else self._cut(chunks, get, limit))
        for chunk in long:
            del self.totals[chunk]
        return counts, fit

    def _cut(self, chunks: list[str], get, limit: int) -> int:
        sums = list(accumulate(map(get, chunks)))
        k = int(np.searchsorted(sums, limit, side="right"))
        room = limit - (sums[k - 1] if k else 0)
        inside = max((i for i, c in enumerate(self.counts(chunks[k]), 1) if c <= room), default=0)
        return max(0, sum(map(len, chunks[:k])) + inside - 1)  # without the leading space mark


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker process, which keeps its table from task to task."""
    return Counter(path)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    ``model`` is the path of a piece BPE model, the same on all machines; counts are those of whole texts without added
    tokens. ``fit_chars`` is the length in code points of the longest prefix with at most ``limit`` tokens. A null text
    is empty and has no tokens. A text of any length is counted whole, in time and memory proportional to it, also without
    spaces; chunks longer than ``LONGEST`` aren't remembered. Ids may be null or repeat; other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = counter(model)
        for batch in pieces(batches):
            texts = batch.column(1).to_pylist()
            counts, fit = own.measure(texts, limit)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts]), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return small_batches(rows).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
