"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Plain DataFrame expressions only, one pass, no shuffle. Patterns scan whole texts in linear time: every run starts
only where it can't have begun earlier (look-behind, or ``\\G`` where the previous match ended), and repeats are
possessive, which neither backtracks nor recurses. A match's place is the sum of the lengths of what ``split`` leaves
between the matches and of the matches before it, in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties between spans with the same start; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # only runs of 14 to 19 digits: shorter and longer runs fail in any case
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # the start only, with what may follow it in group 1: a letter or digit behind the longest run as well
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?+))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that a text must pass before its pattern runs.
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z][A-Z][0-9][0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]"),
}
#: Characters of an IBAN by country.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: What a confirmed span scores before its surroundings are read, and the words that raise it by 0.3.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ["email", "e-mail", "mail", "contact", "write"],
    "ip": ["ip", "address", "host", "server", "login"],
    "card": ["card", "credit", "visa", "mastercard", "payment", "pay"],
    "phone": ["phone", "call", "tel", "mobile", "fax", "cell"],
    "iban": ["iban", "account", "bank", "transfer"],
    "ssn": ["ssn", "social", "security", "taxpayer"],
}
#: Code points on each side of a span in which context words count, and the score that a span beyond the base needs.
CONTEXT_CHARS = 40
ADDED_SCORE = 0.5

_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right counts twice."""
    places = F.split(F.reverse(digits), "")
    worth = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN leaves 1 modulo 97, with its first four characters moved to the end and letters as 10 to 35."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_IP),
    "card": lambda m: luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & ~m.rlike("[a-z]") & mod97(m),
    "ssn": lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"),
}


def iban_length(run: Column) -> Column:
    """The length of the IBAN that ``run`` starts with, 0 if there is none.

    It may end before a blank or with the run. A known country's has that country's length, or is the whole run; any
    other is the longest that passes.
    """
    bare = lambda m: F.length(F.replace(m, F.lit(" "), F.lit("")))
    country = F.substring(run, 1, 2)
    chars = reduce(lambda rest, n: F.when(country.isin(IBAN_CHARS[n].split()), n).otherwise(rest), IBAN_CHARS, F.lit(0))
    whole = F.length(run)
    ends = F.filter(F.sequence(F.lit(15), whole), lambda e: ((e == whole) | (F.substr(run, e + 1, F.lit(1)) == " ")) & ((chars == 0) | (e == whole) | (bare(F.substr(run, F.lit(1), e)) == chars)))
    valid = F.filter(ends, lambda e: _VALID["iban"](F.substr(run, F.lit(1), e)))
    own = F.filter(valid, lambda e: bare(F.substr(run, F.lit(1), e)) == chars)
    return F.coalesce(F.get(own, F.lit(0)), F.array_max(valid), F.lit(0))


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """array<struct<start, rank, stop, kind, score>> of the confirmed matches; those of IBANs are starts."""
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(matches))
    if kind == "iban":
        rests = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1))
        lengths = F.zip_with(matches, rests, lambda m, rest: iban_length(F.concat(m, rest)))
    else:
        lengths = F.transform(matches, lambda m: F.when(_VALID[kind](m), F.length(m)).otherwise(0))
    sized = F.zip_with(F.zip_with(gaps, matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"))), lengths, lambda x, n: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), n.alias("size")))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    # a start inside a span that is confirmed proposes nothing
    walked = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), empty.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["len"]).alias("at"),
            F.when((x["size"] > 0) & (a["at"] + x["gap"] >= a["free"]), a["at"] + x["gap"] + x["size"]).otherwise(a["free"]).alias("free"),
            F.when((x["size"] > 0) & (a["at"] + x["gap"] >= a["free"]), F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("stop"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    words = rf"(?i)(?<![A-Za-z])(?:{'|'.join(CONTEXT[kind])})(?![A-Za-z])"

    def scored(s: Column) -> Column:
        from_ = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        before = F.substr(text, from_ + 1, s["start"] - from_)
        behind = F.substr(text, s["stop"] + 1, F.lit(CONTEXT_CHARS))
        score = F.lit(SCORES[kind]) + F.when(before.rlike(words) | behind.rlike(words), F.lit(0.3)).otherwise(F.lit(0.0))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    spans = F.transform(walked, scored)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= ADDED_SCORE)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keep`` columns, spans: array<struct<start, rank, stop, kind, score>>.

    Spans are sorted by start, then kind; offsets are code points, ``stop`` is exclusive. Base kinds (email, ip, card,
    phone) have all matches that pass their check; iban (mod 97) and ssn (only near a context word) are added. Spans of
    different kinds may overlap. A null text is empty and has no spans; ids may be null or repeat.
    """
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,score:double>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = F.col("_t")
    found = rows.withColumns({f"_{k}": F.when(_NEEDS[k](t), F.regexp_extract_all(t, F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>")) for k in KINDS})
    spans = [F.when(F.size(f"_{k}") > 0, _spans(k, t, F.col(f"_{k}"))).otherwise(none) for k in KINDS]
    return found.select("doc_id", *keep, F.array_sort(reduce(lambda a, b: F.concat(a, b), spans)).alias("spans"))


def digest(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, a hash of the base spans and all spans as text, from the result of ``find_pii``."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), F.array_max(F.transform(spans, lambda s: s["score"])).alias("top_score"), *keep)
