"""Operators, plans, sources and streaming on small inputs."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.functions.masking import Masker
from logweave.operators import extract, match, merge, metrics, similarity, split
from logweave.plans.pipeline import evaluate, mine
from logweave.plans.profiler import NullProfiler, Profiler
from logweave.plans.queries import ORACLES, QUERIES
from logweave.plans.state import settle
from logweave.sources import config, logs
from logweave.streaming.chunks import StreamMiner
from logweave.streaming.online import LengthEngine, online


def contents(spark, rows):
    return spark.createDataFrame([(1, c, c.split(), n, i) for i, (c, n) in enumerate(rows)], "k int, content string, tokens array<string>, n long, first_index long")


def log_lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "log_index long, content string")


def test_variance_split(spark):
    rows = contents(spark, [("A x 1", 1), ("A y 2", 1), ("A x 3", 1), ("A y 4", 1)])
    got = {r.content: tuple(r.branch) for r in split.variance_split(rows, ["k"]).collect()}
    assert got == {"A x 1": ("A", "x"), "A x 3": ("A", "x"), "A y 2": ("A", "y"), "A y 4": ("A", "y")}


def test_entropy_templates(spark):
    rows = contents(spark, [(f"item {w} ok", 1) for w in ("alpha1", "beta2", "gamma3", "delta4", "eps5", "zeta6")])
    assert [r.template for r in extract.entropy_templates(rows, ["k"]).collect()] == ["item <*> ok"]
    same = contents(spark, [("only one", 7)])
    assert [r.template for r in extract.entropy_templates(same, ["k"]).collect()] == ["only one"]
    open_ = contents(spark, [("state up", 3), ("state down", 2)])
    assert [r.template for r in extract.entropy_templates(open_, ["k"]).collect()] == [None]


def test_apply_templates_keeps_what_does_not_fit(spark):
    rows = contents(spark, [("open file a", 1), ("open file b", 1), ("shut file c", 1)])
    templates = spark.createDataFrame([(1, "open file <*>")], "k int, template string")
    got = {r.content: r.template for r in extract.apply_templates(rows, templates, ["k"]).collect()}
    assert got == {"open file a": "open file <*>", "open file b": "open file <*>", "shut file c": "shut file c"}


def test_match(spark):
    templates = spark.createDataFrame([(1, "open <*> now"), (2, "open file <*>"), (3, "<*> <*>"), (4, "go")], "template_id long, template string")
    rows = contents(spark, [("open file now", 1), ("open file x y", 1), ("close it now", 1), ("go", 1)])
    got = {r.content: r.template_id for r in match.match_templates(rows, templates).collect()}
    assert got == {"open file now": 1, "open file x y": 2, "go": 4}
    assert {r.content for r in match.unmatched(rows, match.match_templates(rows, templates)).collect()} == {"close it now"}


def test_merge_store():
    store = merge.Store()
    ids = [store.add(t) for t in ("open file <*>", "open file a", "shut <*> b", "open file a b c d e f g")]
    assert [store.final(i) for i in ids] == [2, 2, 3, 4]
    assert store.templates == {2: "open file <*>", 3: "shut <*> b", 4: "open file a b c d e f g"}
    apart = merge.Store()
    apart.add("send <*> to b")
    assert len({apart.add("send x y to b"), 1}) == 2 and len(apart.templates) == 2
    joined = merge.Store(combine=lambda parts: "send <*> to b")
    joined.add("send <*> to b")
    joined.add("send x y to b")
    assert list(joined.templates.values()) == ["send <*> to b"]


def test_merge_fold(spark):
    new = spark.createDataFrame([(1, "a b <*>"), (2, "a b c")], "ordinal long, template string")
    old = spark.createDataFrame([(7, "a b d")], "template_id long, template string")
    got = {(r.ordinal, r.old_id): (r.template_id, r.template) for r in merge.merge_fold(new, old).collect()}
    assert got == {(1, None): (9, "a b <*>"), (2, None): (9, "a b <*>"), (None, 7): (7, "a b d")}


def test_accuracy(spark):
    rows = [(0, "1", "a", "a", "a"), (1, "1", "a", "a", "a"), (2, "2", "b", "b", "b"), (3, "2", "b", "b", "b"), (4, "2", "b", "c", "c")]
    scored = spark.createDataFrame(rows, "log_index long, parsed string, template string, event string, event_template string")
    r = metrics.accuracy(scored).first()
    assert (r.GA, r.PA, r.FGA, r.FTA) == (0.4, 0.8, 0.4, 0.4)


def test_same_template(spark):
    rows = spark.createDataFrame([("a <*> b", "a  <*> <*> b"), ("a<*>", "a <*>"), ("a b", "a c")], "t string, g string")
    assert [r.s for r in rows.select(metrics.same_template(F.col("t"), F.col("g")).alias("s")).collect()] == [True, True, False]


def test_results_round_trip(spark):
    run = {"Dataset": "X", "GA": 0.5, "PA": 0.25, "FGA": 0.5, "FTA": 0.125, "Dura": 2.0, "#Line": 100, "#Tpl": 3, "#Invoke": 1, "#Tokens": 9, "Match": 0.1, "Group": 0.2, "Extract": 0.3, "Correct": 0.4}
    text = [(0, metrics.result_line(run)), (1, "noise"), (2, metrics.result_line(run | {"GA": 0.75})), (3, metrics.result_line(run | {"Dataset": "Y"}))]
    found = metrics.best_runs(metrics.parse_results(spark.createDataFrame(text, "place long, value string")))
    assert {r.Dataset: r.GA for r in found.collect()} == {"X": 0.75, "Y": 0.5}
    assert {r.Dataset: r.GA for r in metrics.with_average(found.drop("place")).collect()}["Average"] == 0.625


def test_similarity(spark):
    rows = spark.createDataFrame([(1, "a b c d".split()), (2, "a b c e".split()), (3, "x y".split()), (4, "a b c d".split())], "id long, tokens array<string>")
    got = {(r.a, r.b): round(r.similarity, 3) for r in similarity.similar_pairs(rows, 0.6).collect()}
    assert got == {(1, 2): 0.6, (2, 4): 0.6, (1, 4): 1.0}
    parts = similarity.connected(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long"), settle)
    assert {(r.id, r.component) for r in parts.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    pairs = spark.createDataFrame([("a b c".split(), "a x c".split()), ("a".split(), "a b c d e".split()), ("a b".split(), "a b c".split())], "a_tokens array<string>, b_tokens array<string>")
    assert [round(r.similarity, 3) for r in similarity.lcs_similarity(pairs).collect()] == [0.667, 0.0, 1.0]
    assert {r.id: r.cluster for r in similarity.semantic_clusters(rows, settle).collect()}[4] == 1


def brute_pairs(rows, threshold):
    known = [(i, set(t)) for i, t in rows if i is not None and t]
    both = [(a, b, len(x & y) / len(x | y)) for i, (a, x) in enumerate(known) for b, y in known[i + 1 :] if a != b]
    return sorted((min(a, b), max(a, b), s) for a, b, s in both if s >= threshold)


@pytest.mark.parametrize("threshold", [0.35, 0.55, 0.6, 0.8, 1.0])
def test_similar_pairs_of_any_sizes(spark, threshold):
    draw = random.Random(7)
    rows = [(i, [draw.choice("abcdefghijklm") for _ in range(draw.randint(0, 14))]) for i in range(220)]
    rows += [(300, ["a", "b"]), (300, ["a", "b", "c"]), (301, ["b", "a", "a"]), (None, ["a", "b"]), (302, None)]  # a repeated and a missing id
    lines = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = brute_pairs(rows, threshold)
    assert sorted(tuple(r) for r in similarity.similar_pairs(lines, threshold).collect()) == want
    # with and without repeated ids
    for some in (lines, lines.filter("id < 300")):
        kept = [s for a, b, s in want if some is lines or b < 300]
        (got,) = similarity.similar_pair_stats(some, threshold).collect()
        assert (got.most, got.least) == (max(kept, default=None), min(kept, default=None))
        assert got["mean"] == pytest.approx(sum(kept) / len(kept)) if kept else got["mean"] is None


def test_similar_pairs_reach_the_threshold(spark):
    long, short = [f"w{i}" for i in range(20)], [f"w{i}" for i in range(11)]  # 11 / 20 is 0.55, but 20 * 0.55 is over 11
    lines = spark.createDataFrame([(1, long), (2, short)], "id long, tokens array<string>")
    assert [tuple(r) for r in similarity.similar_pairs(lines, 0.55).collect()] == [(1, 2, 0.55)]


def test_copies_are_compared_once(spark, monkeypatch):
    kinds = [f"{a} {b} x y".split() for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, kinds[i % 100]) for i in range(3_000)]
    lines = spark.createDataFrame(rows, "id long, tokens array<string>")
    _, sets, pairs = similarity._similar_sets(lines, 0.6, "id")
    assert sets.count() == 100 and pairs.count() == 100 * 18 // 2
    (got,) = similarity.similar_pair_stats(lines, 0.6).collect()
    same, near = 100 * 30 * 29 // 2, 900 * 30 * 30
    assert got["mean"] == pytest.approx((same + near * 0.6) / (same + near)) and got.most == 1 and got.least == 0.6
    monkeypatch.setattr(similarity, "BLOCK", 4)
    found = similarity.similar_pairs(lines, 0.8).collect()
    assert len({(r.a, r.b) for r in found}) == len(found) == same and all(r.a < r.b and r.a % 100 == r.b % 100 for r in found)


def test_keys_are_rare(spark):
    assert similarity.key_plan([5], 0.8) == []  # of five tokens each, only equal sets reach 0.8
    assert {(n, side, len(at)) for n, _, side, _, at in similarity.key_plan([5], 0.6)} == {(5, False, 5), (5, True, 5)}  # four of five
    assert all(at is None or len(at) <= similarity.KEYS for *_, at in similarity.key_plan(list(range(1, 300)), 0.5))


@pytest.mark.parametrize("name", ["similar_pairs", "similarity_stats"])
def test_parts_with_nulls(spark, tmp_path, name):
    parts = [(1, None, "B#1", "X", 1), (2, None, "B#1", "X", 1), (3, "red ring", "B#1", None, 2), (4, "red ring", "B#1", None, 2), (5, "red ring", "B#2", None, 2), (None, "red ring", "B#2", None, 2)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    assert want and sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want


TEXTS = [f"session opened for user u{i} from 10.0.0.{i % 5}" for i in range(40)] + [f"disk sda{i} has {i * 7} bytes free" for i in range(40)] + ["all is well"] * 3


def test_mine_assigns_every_line_once(spark):
    found, templates = mine(log_lines(spark, TEXTS))
    rows = found.collect()
    assert sorted(r.log_index for r in rows) == list(range(len(TEXTS)))
    assert len({r.template for r in rows if r.log_index >= 80}) == 1
    assert sum(r.n_matched for r in templates.collect()) == len(TEXTS)


def test_chunks_and_stream_agree(spark, tmp_path):
    lines = log_lines(spark, TEXTS)
    whole = {r.log_index: r.template for r in mine(lines, chunk_size=50)[0].collect()}
    source = str(tmp_path / "in")
    for i in range(2):
        lines.filter(F.col("log_index").between(50 * i, 50 * i + 49)).coalesce(1).write.mode("append").parquet(source)
    miner = StreamMiner(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.writeStream.foreachBatch(miner).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    state = miner.finalize()
    known = {(r.content): r.template for r in state.assigned.join(state.templates, "template_id").collect()}
    assert set(known.values()) == set(whole.values())
    # a new miner goes on from the saved state
    assert StreamMiner(spark, str(tmp_path / "state")).state.templates.count() == state.templates.count()


def test_empty_input(spark):
    found, templates = mine(spark.createDataFrame([], "log_index long, content string"))
    assert found.count() == templates.count() == 0


def test_evaluate(spark):
    truth = spark.createDataFrame([(i, "a" if i < 40 else "b" if i < 80 else "c", "session opened for user <*> from <*>" if i < 40 else "disk <*> has <*> bytes free" if i < 80 else "all is well") for i in range(len(TEXTS))], "log_index long, event string, event_template string")
    r = evaluate(log_lines(spark, TEXTS), truth).first()
    assert r.n_lines == len(TEXTS) and 0 <= r.GA <= 1


def test_recorded_provider(spark):
    records = [{"inputs": [{"Id": 0, "logs": "state `up`\nstate down\nstate idle"}], "output": [{"Id": 0, "Reason": "", "template": "state <*>"}]}]
    provider = extract.RecordedProvider(records)
    assert provider([(5, ["state down", "state up", "state  idle"])]) == {5: "state <*>"}
    texts = ["state up", "state down", "state idle"] * 3
    assert {r.template for r in mine(log_lines(spark, texts), provider=provider)[0].collect()} == {"state <*>"}
    assert {r.template for r in mine(log_lines(spark, texts))[0].collect()} == {"state up", "state down", "state idle"}
    ask = extract.CallableProvider(lambda prompt: '```json\n[{"Id": 5, "template": "state <*>"}]\n```')
    assert ask([(5, ["state up"])]) == {5: "state <*>"}
    assert extract.CallableProvider(lambda prompt: "no idea")([(5, ["state up"])]) == {}


def test_online_engine(spark):
    engine = LengthEngine(depth=10, threshold=0.4)
    first = engine.add("bob leaves at ten".split())
    again = engine.add("bob leaves at ten".split())
    other = engine.add("bob leaves at two".split())
    assert [first[0], again[0], other[0]] == ["created/none", "none", "changed"]
    assert engine.clusters[other[1]]["tokens"] == ["bob", "leaves", "at", "<*>"]
    restored = LengthEngine(depth=10, threshold=0.4).load(engine.dump())
    assert restored.add("bob leaves at six".split()) == engine.add("bob leaves at six".split())
    assert engine.match("bob leaves at ten".split()) is not None and engine.match("x y z w".split(), "always") is None
    with pytest.raises(ValueError):
        engine.match([], "sometimes")
    assert engine.tree_lines()[0] == "<root>"
    rows = online(log_lines(spark, ["a b c", "a b d", "x", "", "a b c"])).collect()
    assert sorted(r.log_index for r in rows) == [0, 1, 2, 3, 4]


def test_online_stream_equals_batch(spark, tmp_path):
    lines = log_lines(spark, [f"user {n} did {w}" for n in ("ann", "bob", "cid") for w in ("this", "that")])
    for i in range(2):
        lines.filter(F.col("log_index").between(3 * i, 3 * i + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online(stream).writeStream.format("memory").queryName("online_rows").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: tuple(r.asDict().values())
    assert sorted(map(key, spark.table("online_rows").collect())) == sorted(map(key, online(lines).collect()))


def test_read_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text("d1 t1 7 INFO core: all good\n  nonsense\nd2 t2 8 WARN net: link (a) down\n")
    kept, rejected = logs.read_logs(spark, str(tmp_path / "x.log"), config.FORMATS["HDFS"])
    assert [(r.LineId, r.Level, r.Component, r.Content) for r in kept.orderBy("LineId").collect()] == [(1, "INFO", "core", "all good"), (2, "WARN", "net", "link (a) down")]
    assert [r.value.strip() for r in rejected.collect()] == ["nonsense"]
    lines = logs.engine_lines(kept)
    assert lines.columns == ["log_index", "component", "level", "content"]
    headers, pattern = logs.header_pattern(config.FORMATS["Linux"])
    assert headers[-1] == "Content" and "(?:\\[(.*?)\\])?" in pattern


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("E1", 'say "hi", then <*>')], "EventId string, EventTemplate string")
    logs.write_csv(rows, str(tmp_path / "c"))
    assert logs.read_structured(spark, str(tmp_path / "c")).collect() == rows.collect()


def test_config(tmp_path):
    path = tmp_path / "a.ini"
    path.write_text('[DRAIN]\nengine = batch\nLLM_provider = p\nLLM_model = m\nLLM_thinking = true\ndepth = 500\nsim_th = 0.1\n[MASKING]\nmask_prefix = <:\nmask_suffix = :>\nparameter_extraction_cache_capacity = 77\nmasking = [{"regex_pattern": "\\\\d+", "mask_with": "NUM"}]\n')
    c = config.load_config(str(path))
    assert (c.depth, c.sim_th, c.mask_prefix, c.masking[0].pattern) == (500, 0.1, "<:", r"\d+")
    assert isinstance(c.masker, Masker)
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.ini"))
    path.write_text("[DRAIN]\nengine = other\n")
    with pytest.raises(ValueError):
        config.load_config(str(path))
    assert config.dataset_paths("r", "HPC", "2K", "raw")["structured"] == "r/loghub-2K/HPC/HPC_2k.log_structured.csv"


def test_call_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"inputs": [{"Id": 1, "logs": "b x\na  x"}], "output": [{"Id": 1, "Reason": "r", "template": "<*> x"}]}]))
    calls = config.read_calls(spark, str(tmp_path / "c.json"))
    samples = spark.createDataFrame([(9, ["a x", "b x"])], "cluster_id long, lines array<string>")
    assert [r.template for r in config.cached_templates(samples, calls, ordered=False).collect()] == ["<*> x"]
    assert config.cached_templates(samples, calls).count() == 0


def test_profiler():
    said = []
    p = Profiler(reset_after=2, printer=said.append)
    with p.section("total"):
        for _ in range(3):
            with p.section("part"):
                pass
    p.report(every=0)
    assert p.count["part"] == 3 and len(said) == 2
    with NullProfiler().section("x"):
        pass


def test_dataset_evaluation_and_command_line(spark, tmp_path, capsys):
    from logweave.__main__ import main

    folder = tmp_path / "loghub-2K" / "HDFS"
    folder.mkdir(parents=True)
    rows = ["LineId,Level,Component,Content,EventId,EventTemplate"]
    rows += [f"{i},INFO,dn,Received block blk_{'-' * (i % 2)}{900 + i} now,E1,Received block <*> now" for i in range(1, 21)]
    rows += [f"{i},INFO,dn,all is well,E2,all is well" for i in range(21, 31)]
    (folder / "HDFS_2k.log_structured_corrected.csv").write_text("\n".join(rows) + "\n")
    (line,) = main([str(tmp_path), "--dataset", "HDFS"])
    run = metrics.parse_results(spark.createDataFrame([(line,)], "value string")).first()
    assert (run["Dataset"], run["GA"], run["PA"], run["FGA"], run["FTA"], run["#Line"], run["#Tpl"]) == ("HDFS", 1, 1, 1, 1, 30, 2)
    assert run["Group"] > 0 and run["Extract"] > 0 and run["Match"] + run["Group"] + run["Extract"] + run["Correct"] <= run["Dura"] + 0.05
    assert line in capsys.readouterr().out


def test_registry():
    assert config.DATASETS.keys() == config.FORMATS.keys() and len(config.DATASETS) == 18
    assert config.FILTERS.keys() | config.PATTERNS.keys() <= config.DATASETS.keys()
    assert config.DATASETS["OpenStack"].filters and not config.DATASETS["BGL"].patterns


def test_top_tokens(spark):
    rows = spark.createDataFrame([("k", ["a", "x"], 2, 5), ("k", ["b", "x"], 2, 1), ("k", ["c"], 1, 0)], "key string, tokens array<string>, n long, first_index long")
    found = {(r.pos, r.place): (r.tok, r.c) for r in split.top_tokens(rows, ["key"], 2).collect()}
    assert found == {(0, 1): ("b", 2), (0, 2): ("a", 2), (1, 1): ("x", 4)}
    assert split.top_tokens(rows.limit(0), ["key"]).count() == 0


def test_stratified_sample(spark):
    from logweave.operators import sample

    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'big' WHEN id % 30 = 0 THEN null ELSE 'small' END AS kind", "'x' AS _n")
    found = sample.stratified_sample(rows.repartition(7), "kind", "id", 300).collect()
    assert len({r.id for r in found}) == len(found)
    counts = {k: sum(r.kind == k for r in found) for k in ("big", "small", None)}
    assert counts == {"big": 200, "small": 90, None: 10}
    again = sample.stratified_sample(rows, "kind", "id", 300)
    assert {r.id for r in again.collect()} == {r.id for r in found}
    order = [r.id for r in sample.shuffled(again, "id").collect()]
    assert order != sorted(order) and order == [r.id for r in sample.shuffled(again.repartition(5), "id").collect()]
    assert sample.stratified_sample(rows, "kind", "id", 9000).count() == 3000
    assert sample.stratified_sample(rows.limit(0), "kind", "id", 10).count() == 0


def test_total_size(spark):
    sizes = spark.createDataFrame([(3,), (4,)], "n_matched long")
    assert [metrics.total_size(x).first().total_size for x in (sizes, sizes.limit(0))] == [7, 0]


def test_configured_online_engine(spark, tmp_path):
    path = tmp_path / "miner.ini"
    path.write_text("[DRAIN]\nengine = online\nsim_th = 0.9\nextra_delimiters = ['=']\n")
    options = config.load_config(str(path)).online_options
    assert options["threshold"] == 0.9 and options["depth"] == 4
    rows = online(log_lines(spark, ["a=1 is up", "a=2 is up", "a=2 is up"]), **options).orderBy("log_index").collect()
    assert [r.total_cluster_count for r in rows] == [1, 2, 2]
