"""What the operators should give, computed the plain way."""

import base64
import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def near(docs, k, percent):
    """{doc_id: (n_shingles, component_id)}"""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in docs:
        w = [x.translate(lower) for x in words(t)]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def passages(docs, window):
    """{doc_id: (n_words, n_removed, kept text)}"""
    first = {}
    split = {d: words(t) for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in split.items():
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = [False] * window
        out[d] = (len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y))
    return out


def copies(docs):
    """{doc_id: (keep_id, group_size, sha)}"""
    groups = defaultdict(list)
    for d, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    return {d: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, d in g}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def warc(pages):
    """{page_id: (bytes, digest, type, refers_to)}"""
    owner = {}
    for i, h in pages:
        owner[h or ""] = max(owner.get(h or "", i), i)
    out = {}
    for i, h in pages:
        raw, o = (h or "").encode(), owner[h or ""]
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if o == i else "revisit", None if o == i else o)
    return out


def fill(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by literal re-sharing: {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        out = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if out[s] > 2 * sizes[s]]
        if not over:
            return full | out
        full |= {s: 2.0 * sizes[s] for s in over}
