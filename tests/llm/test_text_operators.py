"""Deduplication, passages, personal data, mixing and toxicity against brute force, with odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import components, exact_dedup, minhash, mixing, pii, substring, toxicity
from logweave.llm.common import window_hashes, word_hashes

from . import brute

SCHEMA = "doc_id long, text string, source string, size int, kept string"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["ba", "da", "Ga", "la", "mo", "NU", "öx"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(60, 160))) for _ in range(10)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 8, 30])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        if rng.random() < 0.3:
            w = w[:30] + rng.choice(base).split()[:55] + w[30:]
        out.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return [*out, (100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "one two"), (105, "ONE two"), (106, "a" * 5000), (107, "w " * 30000)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "s", 1, "clash") for d, t in docs], SCHEMA)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, k, percent):
    docs = corpus()
    got = minhash.near_dedup(frame(spark, docs), shingle=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(docs, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """Leaders and the pairs between components give what all pairs would, whether leaders find links or not."""
    monkeypatch.setattr(minhash, "LEADERS", 1)
    rng = random.Random(5)
    w = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(80):
        v = list(w)
        for _ in range(rng.choice([1, 2, 3, 4])):
            v[rng.randrange(len(v))] = f"y{rng.randrange(1000)}"
        docs.append((i, " ".join(v)))
    for rounds in (2, 0):
        monkeypatch.setattr(minhash, "ROUNDS", rounds)
        got = minhash.near_dedup(frame(spark, docs), shingle=3, percent=85).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near(docs, 3, 85)


def test_odd_sketch_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for n, k in ((50, 5), (300, 40), (5000, 900), (5000, 0)):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[k:], rng.integers(0, 2**63, k, dtype=np.uint64)]))
        differ = int(np.bitwise_count((minhash.odd_sketch(x) ^ minhash.odd_sketch(y)).view(np.uint64)).sum())
        apart = len(np.setxor1d(x, y))
        assert differ <= apart and differ % 2 == apart % 2 and (n > 300 or differ >= 0.8 * apart)


def test_near_dedup_of_repeated_rows_and_long_texts(spark):
    long = "w" * 3_000_000 + " " + " ".join(f"v{i}" for i in range(400))
    docs = [(1, "a b c d e")] * 40 + [(2, long), (3, long + " end"), (4, "x" * 50_000)]
    rows = minhash.near_dedup(frame(spark, docs), shingle=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1)] * 40 + [(2, 2), (3, 2), (4, 4)]


def test_near_dedup_odd_rows(spark):
    docs = [(5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "z z z z"), (None, None), (9, "q r s t u")]
    rows = minhash.near_dedup(frame(spark, docs), shingle=3, percent=85).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0, r.kept) for r in rows)
    assert got == sorted([(False, 5, False, 5, True)] * 2 + [(False, 7, False, 5, False), (False, 9, False, 9, True), (True, 0, False, 5, False), (True, 0, True, 0, True), (True, 0, True, 0, True)])
    assert minhash.near_dedup(frame(spark, docs).limit(0)).count() == 0


def test_bit_estimate():
    rng = np.random.default_rng(0)
    signer = minhash._Signer(30)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for same in (1000, 900, 600):
        y = np.concatenate([x[:same], rng.integers(0, 2**63, 1000 - same, dtype=np.uint64)])
        a, b = (signer.planes(signer.minima(s)).reshape(minhash.BITS, -1) for s in (x, y))
        differ = np.bitwise_or.reduce(a ^ b, axis=0)
        share = 1 - sum(int(v).bit_count() for v in differ.view(np.uint64)) / signer.n
        chance = 2.0**-minhash.BITS
        assert abs((share - chance) / (1 - chance) - same / (2000 - same)) < 0.15


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7), (None, 3)]
    parent = list(range(1100))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {x for a, b in links if a is not None for x in (a, b)}
    assert {r.id: r.component for r in got} == {x: root(x) for x in want}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_of_words_and_windows(monkeypatch):
    from logweave.llm import common

    text = " ".join(f"w{i % 97}é" for i in range(3000)).encode()
    whole = word_hashes(text)
    monkeypatch.setattr(common, "_BLOCK", 100)
    assert (word_hashes(text) == whole).all() and len(whole) == 3000 and len(set(whole.tolist())) == 97
    for k in (3, 50):
        h = window_hashes(whole, k)
        assert len(h) == 3001 - k and (h[:-97] == h[97:]).all() and len(set(h.tolist())) == 97
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0


def test_exact_dedup(spark, monkeypatch):
    docs = corpus()
    for limit in (exact_dedup.BROADCAST_HASHES, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", limit)
        got = exact_dedup.exact_dedup(frame(spark, docs)).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == brute.copies(docs)
        assert len(got) == len(docs) and all(r.kept == (r.keep_id == r.doc_id) for r in got)
    odd = [(None, "a b"), (3, "ab "), (3, "ab "), (4, "a  b"), (None, "zz")]
    rows = exact_dedup.exact_dedup(frame(spark, odd)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 0, 1, True), (0, 4, 4, False), (3, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True)]
    assert exact_dedup.exact_dedup(frame(spark, odd).limit(0)).count() == 0


@pytest.mark.parametrize("window", [50, 7, 1])
def test_drop_repeats(spark, window):
    docs = corpus()
    got = substring.drop_repeats(frame(spark, docs), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute.passages(docs, window)
    assert len(got) == len(docs)


def test_drop_repeats_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_IDS", 0)
    text = " ".join(map(str, range(60)))
    docs = [(1, "x " + text), (2, text + " y"), (2, text + " z"), (None, text), (3, None), (1, "x " + text)]
    rows = substring.drop_repeats(frame(spark, docs)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text[-1:]) for r in rows) == [(0, 60, 0, "9"), (1, 61, 0, "9"), (1, 61, 0, "9"), (2, 61, 60, "y"), (2, 61, 60, "z"), (3, 0, 0, "")]
    assert substring.drop_repeats(frame(spark, docs).limit(0)).count() == 0
    assert substring.levels(50) == [7, 13, 25, 50] and substring.levels(50, 1) == [25, 50] and substring.levels(1) == [1]
    alone = [(i, " ".join(f"{i}_{j}" for j in range(70))) for i in range(5)]
    assert all(r.n_removed == 0 and r.n_words == 70 for r in substring.drop_repeats(frame(spark, alone)).collect())


PERSONAL = [
    "write to bob.x+1@mail.example.com or x@y.zz_w@q.rr, a@b.c..d@e.f; no@dot",
    "hosts 10.0.0.1 1.2.3.4.5 256.1.1.1 000255.1.1.01 1.2.3 9.9.9.9.9.9.9.9",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111-1 4111111111111112 49927398716 6011000990139424",
    "call +1 (555) 123-4567 or +49 30 1234567890 +12 +1((((( 5 +1.2.3.4.5.6.7.8.9.0.1",
    "ünï 😀 +4915112345678 é a@b.co",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2 3",
    "x@" + "a." * 20000,
    "7" * 40000,
    "a" * 30000 + "@b.cc",
    "",
]


def test_pii_base(spark):
    rng = random.Random(4)
    docs = PERSONAL + ["".join(rng.choice("a1234.@+-_ ()5é😀") for _ in range(80)) for _ in range(400)]
    rows = pii.digest(pii.find_pii(frame(spark, list(enumerate(docs)) + [(9999, None)]))).collect()
    assert len(rows) == len(docs) + 1
    for r in rows:
        want = brute.base_spans(docs[r.doc_id] if r.doc_id < 9999 else "")
        assert r.base_sha256 == hashlib.sha256(brute.spans_text(want).encode()).hexdigest(), docs[r.doc_id][:100]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in want) for k in pii.BASE)
        assert set(brute.spans_text(want).split(",")) - {""} <= set(r.spans.split(","))
    assert pii.find_pii(frame(spark, []).limit(0)).count() == 0


def test_pii_added_kinds(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "iban DE89 3704 0044 0532 0130 01 no", "my social security 123-45-6789", "part 123-45-6789", "card 4111111111111111", "x 4111111111111111"]
    rows = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, list(enumerate(texts)))).collect()}
    assert [[s.kind for s in rows[i]] for i in range(4)] == [["iban"], [], ["ssn"], []]
    assert rows[4][0].score > rows[5][0].score
    assert texts[0][rows[0][0].start : rows[0][0].stop] == "DE89 3704 0044 0532 0130 00"


def test_pii_ibans_before_words(spark):
    """The words behind an IBAN don't hide it; each text has its IBANs in brackets, which are taken out."""
    marked = [
        "IBAN [DE89370400440532013000] Please pay",
        "[DE89 3704 0044 0532 0130 00] BIC COBADEFF",
        "[DE89 3704 0044 0532 0130 00] A b",
        "[DE89 3704 0044 0532 0130 00] [GB82 WEST 1234 5698 7654 32] OR [NO93 8601 1117 947] Then",
        "[MT84 MALT 0110 0001 2345 MTLC AST0 01S] OF 2024",
        "é😀 [ZZ22 3704 0044 0532 0130 00] XYZ Ab",
        "DE89370400440532013000Please DE88 3704 0044 0532 0130 00 Please xDE89370400440532013000",
        "AB12 " * 3000,
    ]
    texts = [re.sub(r"[\[\]]", "", t) for t in marked]
    want = [re.findall(r"\[(.*?)\]", t) for t in marked]
    rows = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, list(enumerate(texts)))).collect()}
    assert [[texts[i][s.start : s.stop] for s in rows[i] if s.kind == "iban"] for i in range(7)] == want[:7]


def test_pii_context_behind(spark):
    texts = ["123-45-6789 is my social security number", "😀 123-45-6789 (SSN)", "123-45-6789 " + "x" * 40 + " ssn", "123-45-6789", "4111111111111111 on my card", "4111111111111111 x"]
    rows = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, list(enumerate(texts)))).collect()}
    assert [[s.kind for s in rows[i]] for i in range(4)] == [["ssn"], ["ssn"], [], []]
    assert rows[4][0].score > rows[5][0].score


def test_mix_sources(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "ä", "Z", "", None])) for i in range(400)] + [(500, None, "b"), (501, "x", "only"), (502, "", "empty")]
    docs += [docs[0], docs[0]]
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, target string")
    results = []
    for rows in (mixing.BUCKET_ROWS, 16):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
        got = mixing.mix_sources(table).collect()
        results.append(sorted((r.doc_id, r.size, r.taken) for r in got))
    assert results[0] == results[1] and len(got) == len(docs)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.size == len(brute.words(next(t for d, t, _ in docs if d == r.doc_id)))
    want = brute.fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == int(target[s] + 1e-9)
    assert all(r.source_size == sizes[r.source] for r in got)
    assert mixing.mix_sources(table.limit(0)).count() == 0


def test_toxicity_model():
    rng = random.Random(8)

    def text(bad):
        w = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(rng.randint(2, 6) if bad else 0):
            w[rng.randrange(60)] = rng.choice(["Scum!", "idiot", "vile,"])
        return " ".join(w).encode()

    toxic = np.array([rng.random() < 0.2 for _ in range(1200)])
    feats = [toxicity.text_features(text(t)) for t in toxic]
    grades = toxicity.severity_grades(feats[:800], toxic[:800])
    assert set(grades[toxic[:800]].tolist()) == {1, 2, 3} and not grades[~toxic[:800]].any()
    model = toxicity.fit(feats[:800], grades)
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.scores(f) for f in feats[800:]])
    assert (np.diff(scores, axis=1) <= 0).all()
    found = scores[:, 0] >= toxicity.best_limit(toxicity.held_out(feats[:800], grades), toxic[:800])
    assert (found & toxic[800:]).sum() >= 0.97 * toxic[800:].sum() and not (found & ~toxic[800:]).any()
    assert (toxicity.fit(feats[:800], grades).weights == model.weights).all()


def test_toxicity_fit_is_a_maximum():
    """Against the likelihood written out, and its slope taken by differences."""
    rng = np.random.default_rng(4)
    words = np.arange(1, 9, dtype=np.uint64) * np.uint64(1 << 40)
    docs = [np.sort(rng.choice(words, rng.integers(1, 7), replace=False)) for _ in range(400)]
    pull = np.array([sum(1.5 for w in d if w in words[:2]) - 0.5 * (words[5] in d) for d in docs])
    grades = (rng.logistic(size=400) + pull > 1.0).astype(int) + (rng.logistic(size=400) + pull > 2.5).astype(int)
    penalty = 2e-4
    model = toxicity.fit(docs, grades, steps=3000, penalty=penalty)

    def loss(w, theta):
        total = 0.0
        for d, g in zip(docs, grades.tolist(), strict=True):
            z = sum(w[i] for i, v in enumerate(model.vocabulary) if v in d)
            tail = [1.0, *(1 / (1 + np.exp(t - z)) for t in theta), 0.0]
            total -= np.log(tail[g] - tail[g + 1])
        return total / len(docs) + penalty * (w @ w) / 2

    best = loss(model.weights, model.thresholds)
    for i in range(len(model.weights) + 2):
        for step in (-0.02, 0.02):
            x = np.concatenate([model.weights, model.thresholds])
            x[i] += step
            assert loss(x[:-2], x[-2:]) >= best - 1e-6
    assert len(model.weights) >= 2


def test_toxicity_limit():
    chances, toxic = np.array([0.99, 0.9, 0.6, 0.3, 0.1, 0.1]), np.array([1, 1, 1, 0, 0, 0], dtype=bool)
    assert 0.3 < toxicity.best_limit(chances, toxic) < 0.6
    assert toxicity.best_limit(chances, ~toxic) > 0 and toxicity.best_limit(chances, toxic & False) == 0.5


def test_toxicity_rows(spark):
    rng = random.Random(9)
    docs = [(i, " ".join([f"w{rng.randrange(90)}" for _ in range(30)] + ["scum idiot vile trash"] * (i % 5 == 0))) for i in range(300)] + [(900, None), (901, ""), (None, "scum idiot vile trash"), (5, "scum idiot vile trash")]
    table = frame(spark, docs)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(table, toxicity.train(table, labels), keep=("source",)).collect()
    assert len(rows) == len(docs)
    assert all(r.toxic == (r.doc_id is None or r.doc_id < 300 and r.doc_id % 5 == 0) for r in rows if r.doc_id not in (900, 901))
    assert not any(r.toxic for r in rows if r.doc_id in (900, 901)) and all(r.kept != r.toxic for r in rows)
    with pytest.raises(ValueError):
        toxicity.toxicity(table, toxicity.fit([], np.empty(0, dtype=np.int64)), keep=("kept",))
    long = toxicity.toxicity(frame(spark, [(1, "w1 " * 300_000), (2, "w" * 400_000 + " scum idiot vile trash")] + [(7, "w2 w3")] * 3), toxicity.train(table, labels)).collect()
    assert sorted((r.doc_id, r.toxic) for r in long) == [(1, False), (2, True), (7, False), (7, False), (7, False)]
    none = toxicity.train(table, labels.limit(0))
    assert not any(r.toxic for r in toxicity.toxicity(table, none).collect())
    assert toxicity.toxicity(table.limit(0), none).count() == 0


def test_no_python_in_native_plans(spark):
    table = frame(spark, corpus(n=5))
    for df in (exact_dedup.exact_dedup(table), pii.digest(pii.find_pii(table))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
