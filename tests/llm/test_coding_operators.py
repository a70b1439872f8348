"""Token counts, encoding, archives, vectors and the pipeline."""

import io
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import embed_dedup, warc
from logweave.llm.bpe import Codec, bpe_encode
from logweave.llm.merging import _merge_short, merge
from logweave.llm.token_counts import Counter, count_tokens

from . import brute

P = pytest.importorskip("public_tokenizers")

ODD = ["", "a", " ", "  ", "a  b   c\n\n d\t\te", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "  　x", "\x1c\x1d a\x85b", "é 你好世界 😀😀", "a" * 3000, " " * 300, "don't I'LL we're", "١٢٣ ²³ Ⅷ", "\x00\x01", "</s> <s> <0x0A>", "▁▁a ▁b", "\r\n\r\n x", "ﬁ ｘ 　", "=" * 200]


def texts():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "1", "22", ".", "the", "ing", "　", "😀", "▁", "'s", "ß", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(parts) for _ in range(50)) for _ in range(400)]


def test_merge_is_the_plain_algorithm():
    rng = random.Random(3)
    for _ in range(300):
        ranks = {(a, b): rng.random() for a in ("a", "b", "ab", "aa") for b in ("a", "b", "ab") if rng.random() < 0.6}
        word = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        want = list(word)
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in ranks]:
            i = min(pairs)[1]
            want[i : i + 2] = [want[i] + want[i + 1]]
        rank = lambda a, b: ranks.get((a, b))
        assert merge(word, rank) == _merge_short(list(word), rank) == want
        assert "".join(merge(word * 4, rank)) == "".join(word * 4)


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, own, sample = Tokenizer.from_file(path), Codec(path), texts()
    want = [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]
    assert own.encode_all(sample) == want and own.encode_all(sample) == want
    assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    rows = spark.createDataFrame([*enumerate(sample), (None, "a"), (1, None)], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_text", F.lit(1))
    got = bpe_encode(rows, path, keep=("_text",)).collect()
    assert {r._text for r in got} == {1}
    with pytest.raises(ValueError):
        bpe_encode(rows, path, keep=("ids",))
    assert len(got) == len(sample) + 2
    assert all(r.ids == want[r.doc_id] and r.decoded == sample[r.doc_id] for r in got if r.doc_id is not None and r.ids)
    assert bpe_encode(rows.limit(0), path).count() == 0


def test_bpe_forgets_and_goes_on(monkeypatch):
    from logweave.llm import bpe

    own, fresh = Codec(P.path("byte_bpe_50k.json")), texts()[:60]
    want = own.encode_all(fresh)
    monkeypatch.setattr(bpe, "MEMORY", 4000)
    for _ in range(2):
        assert [own.encode_all([t])[0] for t in fresh] == want and own.held <= 2000 and len(own.known) + len(own.old) < 40


def test_bpe_remembers_a_word_once_and_packed(monkeypatch):
    from logweave.llm import bpe

    own, fresh = Codec(P.path("byte_bpe_50k.json")), texts()[:60]
    monkeypatch.setattr(bpe, "MEMORY", 40_000)
    for _ in range(2):
        for t in fresh:
            own.encode_all([t])
            assert not (own.known.keys() & own.old.keys()) - own.special.keys()
    assert own.known and all(type(x) is bytes and len(x) % 4 == 0 for x in own.known.values())


def test_bpe_pairs_are_compatible_if_merging_gives_them():
    own, rng = Codec(P.path("byte_bpe_50k.json")), np.random.default_rng(2)
    plain = np.array(sorted(own.vocab.values()))
    left, right = rng.choice(plain, 6000), rng.choice(plain, 6000)
    short = np.flatnonzero(own.made < 2000)[:-1]
    left[3000:], right[3000:] = rng.choice(short, 3000), rng.choice(short, 3000)
    fits = own.compatible(left, right)
    exact = [own.exact(own.tokens[a] + own.tokens[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    sure = ~(own.odd[left] | own.odd[right])
    assert 500 < fits.sum() < 5950 and (fits == np.array(exact))[sure].all()


def test_token_counts(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own, sample = sentencepiece.SentencePieceProcessor(model_file=path), Counter(path), texts()
    want = [len(library.encode(t)) for t in sample]
    counts, fit = own.measure(sample, 7)
    assert counts == want
    for t in sample[:120]:
        t = t[:120]
        every = [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        assert own.prefixes(t) == every
        assert own.measure([t], 7)[1] == [max(i for i, n in enumerate(every) if n <= 7)]
    rows = spark.createDataFrame([*enumerate(sample), (None, "a"), (None, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = count_tokens(rows, path, limit=20).collect()
    assert len(got) == len(sample) + 2
    assert all((r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(sample[r.doc_id].encode()), want[r.doc_id] > 20) for r in got if r.doc_id is not None)
    assert count_tokens(rows.limit(0), path).count() == 0


def test_token_counts_of_long_unbroken_texts(monkeypatch):
    import time

    import sentencepiece

    from logweave.llm import token_counts

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), Counter(path)
    rng = random.Random(7)
    long = ["".join(rng.choice("abcdefgh0123") for _ in range(200_000)), "你好世界" * 20_000, " " * 100_000 + "x" + " " * 50, "a" * 100_000]
    began = time.perf_counter()
    counts, fit = own.measure(long, 4096)
    assert time.perf_counter() - began < 60
    assert counts == [len(library.encode(t)) for t in long] and not any(len(c) > token_counts.LONGEST for c in own.totals)
    assert all(len(library.encode(t[:n])) <= 4096 for t, n in zip(long, fit, strict=True))
    for t in (" " * 70 + "the end", "  " * 20 + "é", "x" + " " * 33 + "ing  a", " " * 40):
        assert own.prefixes(t) == [len(library.encode(t[:i])) for i in range(len(t) + 1)]
    monkeypatch.setattr(token_counts, "MEMORY", 3000)
    sample = texts()[:100]
    assert [own.measure([t], 9)[0][0] for t in sample] == [len(library.encode(t)) for t in sample] and own.held < 20_000


def test_archive_bytes():
    payloads = [b"", b"x\r\n\r\ny", "é".encode() * 100, *[f"<html>{i} {'text ' * (i % 50)}</html>".encode() for i in range(300)]]
    records = [warc.record(i, f"http://a/{i} é\n", p, None, False) for i, p in enumerate(payloads)] + [warc.record(999, None, b"x", 3, True)]
    out = io.BytesIO()
    assert warc.write_archive(out, iter(records)) == len(records)
    raw = out.getvalue()
    assert struct.unpack("<I", raw[:4])[0] == warc.DICTIONARY_FRAME
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    parsed = [warc.parse(r) for r in records]
    assert [p["payload"] for p in parsed[:-1]] == payloads
    assert parsed[-1]["record_type"] == "revisit" and parsed[-1]["refers_to"] == 3 and parsed[-1]["payload_bytes"] == 1
    few = io.BytesIO()
    warc.write_archive(few, iter(records[:2]))
    assert list(warc.read_archive(io.BytesIO(few.getvalue()))) == records[:2]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-3])))
    for bad in (records[1][:-1], records[1].replace(b"WARC/1.1", b"WARC/9.9"), records[1].replace(b"\r\n\r\ny", b"\r\n\r\nz"), records[1].replace(b"WARC-Type", b"WARC-Kind")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_warc_round_trip(spark, monkeypatch):
    pages = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "<b>é</b>")]
    schema = "page_id long, url string, html string, owner string"
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100)
    got = warc.warc_round_trip(spark.createDataFrame([(*p, "clash") for p in pages], schema)).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute.warc([(i, h) for i, _, h in pages])
    assert len(got) == len(pages)
    odd = spark.createDataFrame([(5, "u", "a"), (5, "u", "a"), (None, "u", "a"), (None, None, "b")], "page_id long, url string, html string")
    rows = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.warc_round_trip(odd).collect())
    assert rows == [(0, "response", 0), (0, "revisit", 5), (5, "response", 0), (5, "response", 0)]
    assert warc.warc_round_trip(odd.limit(0)).count() == 0


def test_embed_dedup(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((30, 16))
    rows = []
    for i in range(600):
        v = centres[i % 30] + rng.standard_normal(16) * (0.05 if i % 3 else 0.3)
        rows.append((i, i % 4, [float(x) for x in np.float32(v)], "clash"))
    rows += [(700 + i, 1, rows[5][2], "c") for i in range(5)] + [(800, None, rows[0][2], ""), (801, 1, None, ""), (802, 1, [0.0] * 16, ""), (803, 1, [float("nan")] * 16, ""), (804, 1, [None] * 16, ""), (805, 1, [1.0, 2.0], ""), (806, 1, [2.0, 4.0], ""), (None, 1, rows[5][2], "")]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, rep string")
    got = {r.vec_id: r for r in embed_dedup.embed_dedup(table).collect()}
    assert len(got) == len(rows)
    links = {r[0]: set() for r in rows}
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2] and np.isfinite(r[2]).all() and any(r[2])]
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2]), np.array(b[2])
                if x @ y >= 0.98 * np.sqrt((x @ x) * (y @ y)):
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    found = sum(got[i].n_links for i in links if i is not None)
    assert found >= 0.99 * sum(map(len, links.values())) and all(got[i].n_links <= len(links[i]) for i in links if i is not None)
    assert got[5].n_links == len(links[5]) and got[700].component_id == min(links[700] | {700})
    assert all(got[i].n_links == 0 and got[i].kept for i in range(800, 805))
    assert got[805].n_links == got[806].n_links == 1 and got[None].component_id == got[5].component_id and not got[None].kept
    assert embed_dedup.embed_dedup(table.limit(0)).count() == 0


def test_embed_dedup_of_large_groups(spark, monkeypatch):
    """All links of near-copy groups and labels much larger than a block."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 700)
    monkeypatch.setattr(embed_dedup, "TILE", 300)
    monkeypatch.setattr(embed_dedup, "STRIDE", 500)
    monkeypatch.setattr(embed_dedup, "WINDOW", 64)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((2, 64))
    near = [c + rng.standard_normal((n, 64)) * s for c, n, s in zip(centres, (3000, 900), (0.12, 0.02), strict=True)]
    x = np.concatenate([*near, rng.standard_normal((600, 64))]).astype(np.float32)
    label = np.array([1] * 3000 + [2] * 900 + [1] * 300 + [3] * 300)
    rows = [(int(i), int(label[i]), x[i].tolist()) for i in rng.permutation(len(x))]
    got = {r.vec_id: r for r in embed_dedup.embed_dedup(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    links, root = hit.sum(axis=1) - 1, np.arange(len(x))
    while (up := np.where(hit, root, len(x)).min(axis=1)).tolist() != root.tolist():
        root = up
    assert links.sum() > 4_000_000 and [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)

    def text():
        return " ".join(f"w{rng.randrange(400)}" for _ in range(60))

    docs = [(i, text() + (" scum idiot vile trash" if i % 7 == 0 else "")) for i in range(200)]
    docs += [(300 + i, docs[1][1] + " " * i) for i in range(3)] + [(310, docs[2][1] + " end"), (320, None), (321, ""), (None, text()), (3, docs[3][1])]
    rows = [(d, t, "en", ["a", "b", None][i % 3], len(t or ""), "extra") for i, (d, t) in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        seen = spark.read.parquet(f"{tmp_path}/out/{name}")
        before[name] = seen
        if name != "bpe":
            assert seen.columns == table.columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in before.items()}
    clean = [d for d, t in docs if "scum" not in (t or "")]
    assert sorted(map(str, ids["toxicity"])) == sorted(map(str, clean))
    kept = set(ids["exact_dedup"])
    assert len(kept & {1, 300, 301, 302}) == 1 and kept >= {2, 310, None}
    assert len(set(ids["minhash"]) & {2, 310}) == 1
    words = [len(brute.words(r.text)) for r in before["minhash"].collect()]
    mixed = before["mix_sources"].collect()
    assert sum(len(brute.words(r.text)) for r in mixed) == pytest.approx(1.5 * sum(words), abs=5)
    coded = before["bpe"].collect()
    assert len(coded) == len(mixed) and all(r.round_trip and r.n_tokens == len(r.ids) for r in coded)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(coded)


def test_pipeline_drops_rows_not_ids(spark):
    """Null and repeated ids: copies go, clean texts of the same id stay."""
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(5))
    exact = [(1, a), (2, a + " "), (2, b), (3, c), (3, c), (3, c), (None, d), (None, d), (None, " " + b), (None, None), (None, None)]
    out = corpus_pipeline.exact_copies(spark, spark.createDataFrame(exact, "doc_id long, text string"), "")
    assert out.columns == ["doc_id", "text"]
    assert sorted("".join((r.text or "").split()) for r in out.collect()) == sorted("".join(t.split()) for t in (a, b, c, d, ""))
    near = [(1, a), (2, a + " end"), (2, b), (None, c), (None, c + " end"), (None, d), (4, d + " end"), (5, e)]
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(near, "doc_id long, text string"), "").collect()]
    assert sorted(t.split()[0] for _, t in rows) == sorted(t.split()[0] for t in (a, b, c, d, e))
    assert {(1, a), (2, b), (4, d + " end"), (5, e)} <= set(rows)


def test_pipeline_stages_against_brute_force(spark):
    """Each dedup stage and the mix on rows with odd ids, clashing columns and empty tables."""
    import corpus_pipeline

    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(50)) for _ in range(12)]
    docs = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 12])):
            w[rng.randrange(50)] = f"x{rng.randrange(40)}"
        docs.append((rng.choice([i, i, i, i // 2, None]), rng.choice([" ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (None, ""), (502, "one two"), (502, "one  two")] + [docs[0]] * 3
    schema = "doc_id long, text string, source string, _key string, _words int, _copies int, kept int"
    table = spark.createDataFrame([(d, t, ["a", "b", None][i % 3], "k", 1, 2, 3) for i, (d, t) in enumerate(docs)], schema)

    exact = corpus_pipeline.exact_copies(spark, table, "")
    assert exact.columns == table.columns
    bare = sorted("".join((r.text or "").split()) for r in exact.collect())
    assert bare == sorted({"".join((t or "").split()) for _, t in docs})

    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, exact, "").collect()]
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    classes = {i: c for i, (_, c) in brute.near([(i, t) for i, (_, t) in enumerate(rows)], 5, 80).items()}
    place = {t: i for i, (_, t) in enumerate(rows)}
    assert len(kept) == len(set(classes.values())) and {classes[place[t]] for _, t in kept} == set(classes.values())

    mixed = corpus_pipeline.mixture(spark, table, "")
    assert mixed.columns == table.columns
    before, after = {}, {}
    for rows_, out in ((table.collect(), before), (mixed.collect(), after)):
        for r in rows_:
            out[r.source] = out.get(r.source, 0) + len(brute.words(r.text))
    for s, want in brute.fill(before).items():
        assert abs(after.get(s, 0) - want) <= 60
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies, corpus_pipeline.mixture, corpus_pipeline.encoding):
        assert stage(spark, table.limit(0), "").count() == 0
