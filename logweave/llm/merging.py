"""Exact byte-pair merging of one word, and what makes neighbouring tokens compatible."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence


#: Up to this length, looking for the lowest rank in a list is faster than a heap.
SHORT = 40


def _merge_short(text: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    none = float("inf")
    ranks = [none if (r := rank(a, b)) is None else r for a, b in zip(text, text[1:], strict=False)]
    while ranks and (low := min(ranks)) != none:
        i = ranks.index(low)
        text[i] += text.pop(i + 1)
        del ranks[i]
        if i < len(ranks):
            ranks[i] = none if (r := rank(text[i], text[i + 1])) is None else r
        if i:
            ranks[i - 1] = none if (r := rank(text[i - 1], text[i])) is None else r
    return text


def merge(parts: Sequence[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """Merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank. O(n log n) for long words."""
    n = len(parts)
    if n < 2:
        return list(parts)
    if n <= SHORT:
        return _merge_short(list(parts), rank)
    text, nxt, prev = list(parts), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(a, b)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if text[i] == a else -1
        if j < 0 or text[j] != b:
            continue  # one of them has been merged meanwhile
        text[i], text[j] = a + b, ""
        nxt[i] = k = nxt[j]
        if k >= 0:
            prev[k] = i
            if (r := rank(text[i], text[k])) is not None:
                heapq.heappush(heap, (r, i, text[i], text[k]))
        if (h := prev[i]) >= 0 and (r := rank(text[h], text[i])) is not None:
            heapq.heappush(heap, (r, h, text[h], text[i]))
    return [t for t in text if t]
