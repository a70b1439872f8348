"""Byte-level BPE encoding and decoding: speculate and verify.

A text is split at the special token and by the vocabulary's word pattern. Each new distinct word is first cut
greedily into the longest tokens. Then all adjacent pairs of all new words are tested at once: two tokens are compatible
if no merge across their border comes before the merges that made them. The test takes the two tokens apart, the one
that was made later first, and looks up whether the pieces that touch at that moment merge; it runs on arrays of pairs,
with one look-up in a sorted table of merges a step. A word all of whose pairs are compatible has its exact encoding
already; only the others are merged exactly.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, pieces, small_batches
from .merging import SHORT, merge

_NEVER = np.int64(1) << 62
_FAR = 1 << 80

#: Bytes of distinct words that a worker remembers (those asked for lately twice), and letters of the longest of them.
MEMORY, LONGEST = 96 << 20, 64
HEAD = 4  # letters of a token's beginning by which the longest is looked up
#: What a remembered word costs at most besides its letters, and each of its tokens.
_ENTRY, _TOKEN = 200, 8
#: Bytes of texts that are cut into words at a time: each word of them is an object of its own meanwhile.
PIECE = 256 << 10
# fixed: the published word pattern of this vocabulary family, with Unicode's White_Space for \s
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype=np.int32).tolist()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        value = {c: b for b, c in enumerate(letters)}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        self.bytes = [b""] * size
        for t, i in self.ids.items():
            if all(c in value for c in t):
                self.tokens[i], self.bytes[i] = t, bytes(value[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i], self.bytes[i] = t, t.encode()
        self.vocab = {t: i for t, i in self.ids.items() if t not in self.special}
        # the longest token for each beginning of HEAD letters
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            if len(t) >= HEAD:
                self.reach[t[:HEAD]] = max(self.reach.get(t[:HEAD], 0), len(t))
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()
        self._merges(size)

    def _forget(self) -> None:
        """Makes the words remembered now the old ones, and forgets the old ones that weren't asked for again."""
        self.old = getattr(self, "known", {})
        self.known: dict[str, bytes] = {s: _packed([i]) for s, i in self.special.items()}
        self.held = 0

    def _merges(self, size: int) -> None:
        """Arrays by token: the merge that makes it (-1: none) and its two parts; and the merges by pair, sorted."""
        self.made, self.left, self.right = (np.full(size, -1, dtype=np.int64) for _ in range(3))
        keys = np.full(len(self.ranks), _NEVER, dtype=np.int64)
        self.joined: dict[int, int] = {}  # by left << 32 | right: rank << 32 | token
        for (a, b), rank in self.ranks.items():
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.joined[self.vocab[a] << 32 | self.vocab[b]] = rank << 32 | self.vocab[a + b]
        for (a, b), rank in self.ranks.items():
            x, y, z = self.vocab.get(a), self.vocab.get(b), self.vocab.get(a + b)
            if x is None or y is None or z is None:
                continue
            keys[rank] = (x << 32) | y
            if self.made[z] < 0 and self.exact(a + b) == [z]:
                # the parts that merging the token's own text puts together last
                self.made[z], self.left[z], self.right[z] = rank, x, y
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        # a token that merging its own text doesn't give, or whose parts are made after it, can't be tested by pairs
        inside = self.made >= 0
        late = np.zeros(size, dtype=bool)
        late[inside] = (self.made[self.left[inside]] >= self.made[inside]) | (self.made[self.right[inside]] >= self.made[inside])
        self.odd = late
        for t, i in self.vocab.items():
            self.odd[i] |= len(t) > 1 and self.made[i] < 0

    def exact(self, word: str) -> list[int]:
        """The encoding of a word in byte letters by merging."""
        if len(word) > SHORT:
            return [self.vocab[t] for t in merge(word, lambda a, b: self.ranks.get((a, b)))]
        get, ids = self.joined.get, [self.vocab[c] for c in word]
        # rank and token of each neighbouring pair's merge as one number
        pairs = [get(a << 32 | b, _FAR) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs and (low := min(pairs)) != _FAR:
            i = pairs.index(low)
            ids[i : i + 2] = [low & 0xFFFFFFFF]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(ids[i] << 32 | ids[i + 1], _FAR)
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | ids[i], _FAR)
        return ids

    def greedy(self, word: str) -> list[int]:
        get, reach, out, i, n = self.vocab.get, self.reach.get, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + reach(word[i : i + HEAD], HEAD - 1)), i, -1):
                token = get(word[i:j])
                if token is not None:
                    break
            out.append(token)
            i = j
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of each pair of tokens comes before those that make them."""
        fine = np.ones(len(left), dtype=bool)
        place, a, b = np.arange(len(left)), left, right
        until_a, until_b = np.full(len(left), _NEVER), np.full(len(left), _NEVER)  # the merges that take a and b up
        while len(place):
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.order[at], _NEVER)
            # equal pairs merge from the left, so b is taken up by an equal merge only after this one
            crossed = (rank < until_a) & (rank <= until_b)
            fine[place[crossed]] = False
            first = self.made[a] > self.made[b]
            go = ~crossed & (np.maximum(self.made[a], self.made[b]) >= 0)
            place, a, b, until_a, until_b, first = (x[go] for x in (place, a, b, until_a, until_b, first))
            until_a, until_b = np.where(first, self.made[a], until_a), np.where(first, until_b, self.made[b])
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return fine

    def learn(self, words: list[str]) -> list[bytes]:
        """The encodings of words (as in the text), packed."""
        if not words:
            return []
        spelt = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        guesses = [self.greedy(s) for s in spelt]
        sizes = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        wrong = set(owner[self.odd[flat]].tolist())
        border = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique((flat[border] << 32) | flat[border + 1], return_inverse=True)
        ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        wrong.update(owner[border[~ok]].tolist())
        return [_packed(self.exact(s) if i in wrong else g) for i, (s, g) in enumerate(zip(spelt, guesses, strict=True))]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [_unpacked(x) for x in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        split: list[list[str]] = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]
            words: list[str] = []
            for part in parts:
                words.extend([part] if part in self.special else self.pattern.findall(part))
            split.append(words)
        known, old = self.known, self.old
        every = set().union(*split) - known.keys() if split else set()
        found = {w: old.pop(w) for w in every & old.keys()}  # a word is remembered once
        new = list(every - found.keys())
        found.update(zip(new, self.learn(new), strict=True))
        known.update(found)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word, ids in found.items():
            if len(word) > LONGEST:
                del known[word]
            else:
                self.held += _ENTRY + len(word) + _TOKEN * (len(ids) // 4)
        if self.held > MEMORY // 2:
            self._forget()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each worker process, which keeps what it has learnt from task to task."""
    return Codec(path)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keep`` columns, ids array<int>, decoded string.

    ``vocabulary`` is the path of a byte-level BPE's JSON file, the same on all machines. Ids are those of whole texts,
    without added special tokens; a special token's string in a text is that token. ``decoded`` is decoded from the ids
    with special tokens kept. A null text is empty: no ids, decoded to an empty text. Ids of rows may be null or repeat.
    A text of any length is encoded whole; words longer than ``LONGEST`` aren't remembered. ``keep`` may not name a column
    like one of the result; other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    if taken := {"doc_id", "ids", "decoded"} & set(keep):
        raise ValueError(f"kept columns would clash with the result's: {', '.join(sorted(taken))}")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(free_name(keep)), F.col(id_col).alias("doc_id"), *keep)
    names = rows.columns[1:]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(vocabulary)
        for batch in pieces(batches, PIECE):
            ids = own.encode_packed(batch.column(0).to_pylist())
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            flat = np.frombuffer(b"".join(ids), dtype=np.int32)
            decoded = pa.array([own.decode(_unpacked(x)) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], [*names, "ids", "decoded"])

    return small_batches(rows).mapInArrow(run, f"{kinds}, ids array<int>, decoded string")
