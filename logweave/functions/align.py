"""Wildcard alignment in plain Python, for the few places where a pattern differs from row to row, and bracket groups."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PARAM

_SNAKE_OR_CAMEL = re.compile(r"[a-z]+(?:_[a-z]+)+\n?\Z|[a-zA-Z]+(?:[A-Z][a-z0-9]+)+\n?\Z")
_WORD = re.compile(r"[A-Za-z][a-z]+\Z")
_JOINTS = frozenset(",.;:=")


def known_word(token: str) -> bool:
    """The default vocabulary: see ``tokens.in_vocabulary``."""
    return _WORD.match(token) is not None


def captures(content: str, template: str) -> list[str] | None:
    """What each wildcard of the template stands for, or None. Wildcards may be empty and take as little as possible.

    Constant parts are placed from left to right, each at its first occurrence; the last must end the line. That is
    what a lazy pattern finds, in linear time.
    """
    line = " ".join(content.split())
    first, *rest = [p.strip() for p in template.split(PARAM)]
    if not rest:
        return [] if line == first else None
    if not line.startswith(first):
        return None
    at, found = len(first), []
    for part in rest[:-1]:
        place = line.find(part, at)
        if place < 0:
            return None
        found.append(line[at:place].strip())
        at = place + len(part)
        if not part:  # an empty part ends where the next one's leading space has been skipped
            while at < len(line) and line[at] == " ":
                at += 1
    end = len(line) - len(rest[-1])
    if end < at or not line.endswith(rest[-1]):
        return None
    return [*found, line[at:end].strip()]


def wildcard_match(content: str, template: str, known: Callable[[str], bool] = known_word) -> bool:
    """Whether a line fits a template and its captures look like values.

    A capture of several tokens may have no snake or camel case token in it, and if it has a wildcard, the others may
    neither include a joint sign nor all be words.
    """
    found = captures(content, template)
    if found is None:
        return False
    for value in found:
        tokens = value.split()
        if len(tokens) < 2:
            continue
        if any(_SNAKE_OR_CAMEL.match(t) for t in tokens):
            return False
        if PARAM in tokens:
            others = [t for t in tokens if PARAM not in t]
            if others and (not _JOINTS.isdisjoint(others) or all(t.isalpha() and known(t) for t in others)):
                return False
    return True


def compatible(old: str, new: str) -> bool:
    """Whether two templates may merge."""
    a, b = old.split(), new.split()
    constant = next((i for i, t in enumerate(a) if t != PARAM), None)
    if constant is None or constant >= len(b) or a[constant] != b[constant] or abs(len(a) - len(b)) > 3:
        return False
    if len(a) == len(b):
        return all(x == y or PARAM in (x, y) for x, y in zip(a, b, strict=True))
    return (PARAM in old or PARAM in new) and (wildcard_match(old, new) or wildcard_match(new, old))


def longest_common_subsequence(a: list[str], b: list[str]) -> list[str]:
    """One of the longest common subsequences; of several, the one that walking back prefers to leave ``a`` for."""
    lengths = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            lengths[i][j] = lengths[i - 1][j - 1] + 1 if x == y else max(lengths[i - 1][j], lengths[i][j - 1])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif lengths[i - 1][j] >= lengths[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


#: Brackets that make groups, and what is between brackets of any kind.
BRACKETS = ("{}", "[]", "()", "<>")
_PLAIN = re.compile(r"[^{}\[\]()<>]+")


def _partners(text: str) -> dict[int, int]:
    """Where each bracket that is closed by one of its kind is closed; kinds don't see each other."""
    kind = {c: pair for pair in BRACKETS for c in pair}
    waiting: dict[str, list[int]] = {pair: [] for pair in BRACKETS}
    closed = {}
    for i, c in enumerate(text):
        pair = kind.get(c)
        if pair and c == pair[0]:
            waiting[pair].append(i)
        elif pair and waiting[pair]:
            closed[waiting[pair].pop()] = i
    return closed


def symmetric_split(text: str) -> list[str]:
    """Brackets and what is between them, nested groups too; from a bracket that its group leaves open, the group's rest is
    one token."""
    closed, out, ends, i = _partners(text), [], [len(text)], 0
    while i < len(text):
        if i == ends[-1]:
            ends.pop()
        elif text[i] in "{[(<":
            if closed.get(i, len(text)) >= ends[-1]:
                out.append(text[i : ends[-1]])
                i = ends[-1]
                continue
            ends.append(closed[i])
        elif plain := _PLAIN.match(text, i, ends[-1]):
            out.append(plain[0])
            i = plain.end()
            continue
        out.append(text[i])
        i += 1
    return out


def symmetric_tokens(text: Column) -> Column:
    """array<string>: ``symmetric_split`` of a column, in Arrow batches; null stays null."""

    @F.pandas_udf("array<string>")
    def split(values: pd.Series) -> pd.Series:
        return values.map(symmetric_split, na_action="ignore")

    return split(text)


def outer_tokens(text: Column) -> Column:
    """array<string>: words, with a bracket pair around a whole word split off."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    whole = r"(?s)^(\{.*\}|\[.*\]|\(.*\)|<.*>)$"

    def parts(w: Column) -> Column:
        return F.when(w.rlike(whole), F.array(F.left(w, F.lit(1)), F.substr(w, F.lit(2), F.length(w) - 2), F.right(w, F.lit(1)))).otherwise(F.array(w))

    return F.filter(F.flatten(F.transform(words, parts)), lambda t: t != "")


def last_json_object(text: str) -> str | None:
    """The last balanced {...} of a text."""
    depth, end, i = 0, -1, len(text) - 1
    while i >= 0:
        if text[i] == "}":
            end = i if not depth else end
            depth += 1
        elif text[i] == "{" and depth:
            depth -= 1
            if not depth:
                return text[i : end + 1]
        i -= 1
    return None


def streamed_content(lines: list[str]) -> str:
    """The text of a server-sent event stream of completion deltas."""
    import json

    out = []
    for line in lines:
        data = line.removeprefix("data:").strip() if line.startswith("data:") else ""
        if not data or data == "[DONE]":
            continue
        try:
            choices = json.loads(data).get("choices") or []
        except ValueError:
            continue
        out += [c.get("delta", {}).get("content") or "" for c in choices[:1]]
    return "".join(out)
