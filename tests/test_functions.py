"""Golden cases of the scalar functions, derived by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from logweave.functions import align, correct, masking, tokens
from logweave.functions.params import template_pattern
from logweave.operators.group import similar, walk
from logweave.sources import logs


def values(spark, make, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_correct_input(spark):
    cases = {
        "Received block blk_-160 of size 67108864 from /10.0.0.1": "Received block blk_-<*> of size <*> from <*>",
        "enabled is true for root": "enabled is <*> for <*>",
        "a  b": "a b",
        "x=12, 3 4": "x=<*>, <*> <*>",
        "#<*># ##<*>##": "<*> <*>",
        "v<*>w": "<*>",
        "1.2.3.4:80": "<*>",
        "": "",
    }
    assert values(spark, correct.correct_input, list(cases)) == list(cases.values())


def test_digit_rule(spark):
    cases = {"12": 1, "1a": 1, "1abc": 0, "a12": 0, "1A": 0, "1234xyzxyzxyzxyz": 1, "1ab": 1, "12abcd": 1, "12abcde": 0, "é1": 0, "": 0}
    assert values(spark, correct.values, list(cases)) == ["<*>" if v else k for k, v in cases.items()]


def test_correct_final_and_pairs(spark):
    cases = {"a <*> : <*> b": "a <*> b", "a <*> <*> <*> b": "a <*> b", "k = <*> j = z": "k = <*> j = <*>", "k = v": "k = v"}
    assert values(spark, correct.correct_final, list(cases)) == list(cases.values())


def test_response(spark):
    cases = {"the template is `open {{file}} now`": "open <*> now", "none": "", "`<*> <*>`": "", "`a` or `abc ${x}`": "abc <*>"}
    assert values(spark, correct.correct_response, list(cases)) == list(cases.values())


def test_tokens(spark):
    cases = {
        "Received block blk_-<*> of size <*>": ["Received", "block", "<*>", "of", "size", "<*>"],
        "Connection closed by <*> [preauth]": ["Connection", "closed", "by", "<*>", "[", "preauth", "]"],
        "uid=0 ok": ["uid", "=", "0", "ok"],
        "uid=0": ["uid=0"],
        "a (b) f() x": ["a", "(", "b", ")", "f()", "x"],
        "<*> <*> a": ["<*>", "a"],
        "": [],
    }
    assert values(spark, tokens.tokens, list(cases)) == list(cases.values())


def test_split_token(spark):
    cases = {"key=a:b": ["key", "=", "a", ":", "b"], "hello!!,": ["hello", "!!", ","], "a==b": ["a==b"], "f()": ["f()"], "x:a=b": ["x", ":", "a", "=", "b"], "a+b": ["a", "+", "b"], "a++b": ["a++b"], "(x": ["(", "x"], "x)": ["x", ")"], "f(x)y": ["f", "(", "x", ")", "y"], "...": ["..."], "a::b": ["a::b"]}
    assert values(spark, tokens.split_token, list(cases)) == list(cases.values())


def test_stable(spark):
    cases = {"abc": 1, "a1": 0, "0": 1, "a0": 1, "/x": 1, "x(y)": 0, "()": 1, "(x)": 1, ",": 1, "a,b": 0, "12": 0}
    assert values(spark, tokens.is_stable, list(cases)) == [bool(v) for v in cases.values()]


def test_case_predicates(spark):
    cases = {"ab_cd": 1, "getName": 1, "Word": 0, "abc": 0, "AB_CD": 0}
    assert values(spark, tokens.is_snake_or_camel, list(cases)) == [bool(v) for v in cases.values()]
    assert values(spark, tokens.is_all_capital, ["ABC", "A1", "Ab", "<*>"]) == [True, False, False, False]


def test_masking(spark):
    masker = masking.Masker(masking.WILDCARD_RULES)
    cases = {"from 10.0.0.1:80 ok": "from <*> ok", "open /a/b/c": "open <*>", "id 0xff x": "id <*> x", "n -5 z": "n <*> z", "deadbeef z": "<*> z", "www.a.com now": "<*> now"}
    assert values(spark, masker.mask, list(cases)) == list(cases.values())
    named = masking.Masker(masking.NAMED_RULES)
    assert values(spark, named.mask, ["from 10.0.0.1 size 12 KB"]) == ["from <IPV4> size <NUM> <UNIT>"]
    assert "IPV4" in named.names and len(named.by_name["CMD"]) == 2


@pytest.mark.parametrize(
    ("line", "template", "expected"),
    [
        ("open file", "open file <*>", True),
        ("open file a b", "open file <*>", True),
        ("open file getName now", "open file <*>", False),
        ("open <*> , b end", "open <*> end", False),
        ("close file", "open file <*>", False),
        ("a x b y c", "a <*> b <*> c", True),
        ("a b", "a <*> <*> b", True),
    ],
)
def test_wildcard_match(line, template, expected):
    assert align.wildcard_match(line, template) is expected


def test_captures_equal_a_lazy_pattern():
    import random
    import re

    rng = random.Random(3)
    for _ in range(3000):
        line = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        template = " ".join(rng.choice(["a", "b", "<*>", "<*>"]) for _ in range(rng.randint(1, 5)))
        parts = [re.escape(p.strip()).replace("\\ ", " ") for p in template.split("<*>")]
        m = re.search("^" + r"\s*(.*?)\s*".join(parts) + "$", line)
        assert align.captures(line, template) == (list(m.groups()) if m else None), (line, template)


def test_similar_ngrams():
    assert similar(("a", "b", "c"), ("a", "b", "d"))
    assert not similar(("a", "<*>", "c"), ("a", "<*>", "d"))
    assert not similar(("a", "b", "c"), ("a", "x", "y"))
    assert similar(("a", "b", None), ("a", "c", None))
    assert not similar(("a", None, None), ("b", None, None))


def test_walk_groups_similar_lines():
    lines = [x.split() for x in ("send a to b now ok", "send c to d now ok", "link x is down right now")]
    assert sorted(map(sorted, walk(lines))) in ([[0], [1], [2]], [[0, 1], [2]])


def test_symmetric_split():
    assert align.symmetric_split("a(b[c]d)e") == ["a", "(", "b", "[", "c", "]", "d", ")", "e"]
    assert align.symmetric_split("a(b") == ["a", "(b"]
    assert align.symmetric_split("(a)(b)") == ["(", "a", ")", "(", "b", ")"]
    assert align.symmetric_split("(a[b)c]") == ["(", "a", "[b", ")", "c", "]"] and align.symmetric_split("") == []
    assert align.symmetric_split("x)<y <z>>{") == ["x", ")", "<", "y ", "<", "z", ">", ">", "{"]


def test_json_helpers():
    assert align.last_json_object('x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert align.streamed_content(['data: {"choices":[{"delta":{"content":"ab"}}]}', "data: [DONE]"]) == "ab"


def test_template_pattern():
    import re

    rules = [masking.MaskRule(r"\d+", "NUM"), masking.MaskRule(r"(?P<h>\w+)\.(?P=h)", "DOM")]
    pattern, names = template_pattern("user <NUM> at <DOM> did <*>", rules, "<", ">", True)
    m = re.match(pattern, "user 12 at x.x did go away")
    assert [(m[f"v{i}"], n) for i, n in enumerate(names)] == [("12", "NUM"), ("x.x", "DOM"), ("go away", "*")]
    twice, names = template_pattern("<DOM>  <DOM>", [rules[1], masking.MaskRule(r"(z)\1\\1", "DOM")], "<", ">", True)
    assert re.match(twice, "a.a  b.b") and not re.match(twice, "a.a b.b") and not re.match(twice, "a.b  b.b") and names == ["DOM", "DOM"]
    assert re.match(twice, "zq\\1  b.b")


def test_bracket_tokens(spark):
    texts = ["a(b[c]d)e", "(ab) c <x> {y} [z) ()", None, " ", "(a (b) c)", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", align.symmetric_tokens(F.col("t")).alias("s"), align.outer_tokens(F.col("t")).alias("o")).orderBy("i").collect()
    assert [r.s for r in got] == [None if t is None else align.symmetric_split(t) for t in texts]
    assert got[1].o == ["(", "ab", ")", "c", "<", "x", ">", "{", "y", "}", "[z)", "(", ")"] and got[2].o is None and got[3].o == [] and got[4].o == ["(a", "(", "b", ")", "c)"]


def test_nothing_is_cut_off_long_inputs(spark):
    """As the reference: #<*># is replaced until none is left."""
    texts = ["#####<*>#####", "a " + "#" * 50 + "<*>" + "#" * 52 + " b", "##<*>##<*>##", "#<*>####<*>###", "# <*>", ""]

    def plain(t):
        while "#<*>#" in t:
            t = t.replace("#<*>#", "<*>")
        return t

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in rows.select("i", correct._unwrap(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
    long = spark.range(1).select(F.concat(F.lit("1 PO-1 a b c"), F.repeat(F.lit(" w"), 1_000_003)).alias("value"))
    assert long.select(F.length(logs.strip_prefix(F.col("value")))).first()[0] == 2 * 1_000_003 - 1
