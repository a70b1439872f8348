"""Tokens as Columns: splitting of contents, token tests, n-grams and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PAD, PARAM
from .bind import let
from .masking import UNICODE

_PUNCTUATION = r"[,.!?;:]"


def words(text: Column) -> Column:
    """Runs of non-white space."""
    return F.filter(F.split(text, UNICODE + r"\s+"), lambda t: t != "")


def _brackets(part: Column) -> Column:
    """Spaces around the round brackets of one part, by where the first of them is."""
    one = F.length(part) > 1
    inner = F.when(part.rlike(r"^.[^()]*\(\)"), part).when(part.rlike(r"^.[^()]*\([^)]*$"), F.regexp_replace(part, r"^(.[^()]*\()", "$1 ")).otherwise(F.regexp_replace(part, r"^(.[^()]*)\(([^)]*)\)(.*)$", "$1 ( $2 ) $3"))
    return (
        F.when(one & part.rlike(r"^\(.*\)$"), F.regexp_replace(part, r"^\((.*)\)$", "( $1 )"))
        .when(one & part.rlike(r"^\([^)]*$"), F.regexp_replace(part, r"^\(", "( "))
        .when(one & part.rlike(r"^[^(]*\)$"), F.regexp_replace(part, r"\)$", " )"))
        .when((F.length(part) > 2) & part.rlike(r"^.[^()]*\)"), F.regexp_replace(part, r"^(.[^()]*)\)(.*)$", "$1 ) $2"))
        .when((F.length(part) > 2) & part.rlike(r"^.[^()]*\("), inner)
        .otherwise(part)
    )


def split_token(token: Column) -> Column:
    """array<string>: punctuation peeled off the ends, then one split at = and :, =, : or +, then the bracket rule."""
    front = F.regexp_extract(token, f"^{_PUNCTUATION}+", 0)

    def spread(runs: Column) -> Column:
        return F.regexp_replace(runs, rf"({_PUNCTUATION})\1*", "$0 ")

    def cut(core: Column) -> Column:
        def once(sign: str) -> Column:
            # present, and never doubled unless it is there once only
            return core.rlike(rf"^[^{sign}]*\{sign}[^{sign}]*$") | (core.contains(sign) & ~core.contains(sign * 2))

        return (
            F.when(core.rlike("^[^=:]*=.*:"), F.regexp_replace(core, "^([^=:]*)=([^:]*):(.*)$", "$1 = $2 : $3"))
            .when(core.rlike("^[^=:]*:.*="), F.regexp_replace(core, "^([^=:]*):([^=]*)=(.*)$", "$1 : $2 = $3"))
            .when(once("="), F.regexp_replace(core, "^([^=]*)=(.*)$", "$1 = $2"))
            .when(once(":"), F.regexp_replace(core, "^([^:]*):(.*)$", "$1 : $2"))
            .when(once("+"), F.regexp_replace(core, r"^([^+]*)\+(.*)$", "$1 + $2"))
            .otherwise(core)
        )

    def peeled(rest: Column) -> Column:
        core = let(F.regexp_replace(rest, f"{_PUNCTUATION}+$", ""), cut)
        back = F.regexp_extract(rest, f"{_PUNCTUATION}+$", 0)
        return F.filter(F.split(F.concat(spread(front), core, F.lit(" "), spread(back)), " "), lambda p: p != "")

    parts = let(F.regexp_replace(token, f"^{_PUNCTUATION}+", ""), peeled)
    return F.filter(F.flatten(F.transform(parts, lambda p: F.split(_brackets(p), " "))), lambda p: p != "")


def _generalise(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.when(p.contains(PARAM) & (p != f"'{PARAM}'"), F.lit(PARAM)).otherwise(p))


def tokens(content: Column) -> Column:
    """array<string> of a corrected content.

    Brackets and commas get spaces; if there are several words, each is split further: those with a wildcard keep it
    as a token of its own. Wildcards next to each other become one.
    """
    spaced = F.replace(content, F.lit(","), F.lit(", "))

    def where(sign: str, pattern: str, by: str):
        # most contents have no such bracket
        return lambda t: F.when(t.contains(sign), F.regexp_replace(t, pattern, by)).otherwise(t)

    for sign, pattern, by in (("(", r"\((?!\))", " ("), (")", r"(?<!\()\)", ") "), ("[", UNICODE + r"\[(?!\s)", "[ "), ("]", UNICODE + r"(?!\s)\]", " ]")):
        spaced = let(spaced, where(sign, pattern, by))

    def split(t: Column) -> Column:
        dotted = F.filter(F.split(F.regexp_replace(t, r"\.{2,}", " $0 "), " "), lambda p: p != "")
        wild = F.when(t.rlike(r"\.{2,}"), _generalise(dotted)).when(t.rlike(r"[=:{}()\[\],.+;]"), _generalise(split_token(t))).otherwise(F.array(F.lit(PARAM)))
        return F.when(t == PARAM, F.array(t)).when(t.contains(PARAM), wild).when(t.rlike(r"[=:{}()\[\],.+;!?]"), split_token(t)).otherwise(F.array(t))

    several = let(words(spaced), lambda first: F.when(F.size(first) > 1, F.flatten(F.transform(first, split))).otherwise(first))
    return let(several, lambda chosen: F.filter(chosen, lambda t, i: ~((t == PARAM) & (i > 0) & (F.get(chosen, i - 1) == PARAM))))


def is_stable(token: Column) -> Column:
    """Whether a position with this token may tell groups apart: no digits, separators or bracketed remark.

    Tokens whose digit runs are just 0 count as stable, as do lone separators and a bracketed remark alone.
    """
    kept = F.filter(F.split(token, "[ ,|]"), lambda w: ~w.rlike(UNICODE + r"\d") & ~w.contains("/") & ~w.rlike("^[a-zA-Z][+-]$|^[+-][a-zA-Z]$"))
    kept = F.filter(F.transform(kept, lambda w: F.regexp_replace(w, r"\([^)]*\)", "")), lambda w: w != "")
    alone = F.regexp_replace(token, UNICODE + r"\d+(\.\d+)?", "0")
    return F.when(F.size(kept) == 0, alone == token).otherwise((F.size(kept) == 1) & (F.get(kept, F.lit(0)) == token))


def is_snake_or_camel(token: Column) -> Column:
    return token.rlike(r"^[a-z]+(_[a-z]+)+$") | token.rlike(r"^[a-zA-Z]+([A-Z][a-z0-9]+)+$")


def is_snake(token: Column) -> Column:
    return token.rlike(r"^[a-zA-Z]+(_[a-zA-Z]+)+$")


def is_camel(token: Column, known=None) -> Column:
    """Camel case with a part of two letters or more that ``known`` (Column to Column) has as a word."""
    parts = F.regexp_extract_all(token, F.lit("[a-z]+|[A-Z][a-z0-9]*"), F.lit(0))
    test = known or in_vocabulary
    word = F.exists(parts, lambda p: (F.length(p) > 1) & ~p.rlike(r"\d") & test(p))
    return token.rlike(r"^[a-zA-Z]+([A-Z][a-z0-9]+)+(\(\))?$") & (F.size(parts) >= 2) & word


def is_all_capital(token: Column) -> Column:
    """No digit and no letter that isn't a capital; the wildcard isn't."""
    return (token != PARAM) & ~token.rlike(UNICODE + r"\d") & ~token.rlike(UNICODE + r"[\p{L}&&[^\p{Lu}]]")


def has_numbers(token: Column) -> Column:
    return token.rlike(UNICODE + r"\d")


def in_vocabulary(token: Column) -> Column:
    """The default test for words where no word table is given: letters only, at most the first of them a capital."""
    return token.rlike(r"^[A-Za-z][a-z]+$")


def first_constant(template: Column) -> Column:
    """struct<pos, tok> of a template's first token that isn't a wildcard; null if there is none."""
    listed = F.filter(F.transform(template, lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))), lambda s: s["tok"] != PARAM)
    return F.get(listed, F.lit(0))


def head_key(t: Column) -> Column:
    """The first three tokens, padded."""
    return F.array(*[F.coalesce(F.get(t, F.lit(i)), F.lit(PAD)) for i in range(3)])


def tail_key(t: Column) -> Column:
    """The last three tokens; short lines have the padded first ones."""
    return F.when(F.size(t) >= 3, F.slice(t, F.greatest(F.size(t) - 2, F.lit(1)), F.lit(3))).otherwise(head_key(t))


def key_variants(key: Column, size: Column) -> Column:
    """array<array<string>>: a key and its four forms with wildcards, or padding for short lines."""
    any_ = F.when(size >= 3, F.lit(PARAM)).otherwise(F.lit(PAD))
    a, b, c = (F.get(key, F.lit(i)) for i in range(3))
    return F.array_distinct(F.array(F.array(a, b, c), F.array(any_, b, c), F.array(a, any_, c), F.array(a, b, any_), F.array(any_, b, any_)))


def half_windows(t: Column, width: int = 3) -> Column:
    """array<array<string>>: the n-grams of the first half of a line, the last ones cut short at its end."""
    half = F.ceil(F.size(t) / 2).cast("int")
    return F.when(half > 0, F.transform(F.sequence(F.lit(0), F.greatest(half - 1, F.lit(0))), lambda i: F.slice(t, i + 1, F.lit(width)))).otherwise(F.array().cast("array<array<string>>"))


def equal_length_match(log: Column, template: Column) -> Column:
    """Same number of tokens, each equal or a wildcard on either side."""
    fits = F.forall(F.zip_with(log, template, lambda a, b: (a == b) | (a == PARAM) | (b == PARAM)), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(log) == F.size(template)) & fits


def static_key(component: Column, level: Column, t: Column) -> Column:
    return F.concat_ws(PAD, component, level, F.concat(F.lit("G "), F.size(t).cast("string")))


def pair_template(a: Column, b: Column) -> Column:
    """Tokens that two sequences of one length share; the others become wildcards."""
    return F.zip_with(a, b, lambda x, y: F.when(x == y, y).otherwise(F.lit(PARAM)))


def sequence_similarity(template: Column, log: Column, count_wildcards: bool = False) -> Column:
    """struct<similarity, n_wildcards>: the share of equal tokens; wildcards of the template may count as equal."""
    wild = F.size(F.filter(template, lambda t: t == PARAM))
    same = F.size(F.filter(F.zip_with(template, log, lambda a, b: (a == b) & (a != PARAM)), lambda x: x))
    n = F.size(template)
    share = F.when(n == 0, F.lit(1.0)).otherwise((same + (wild if count_wildcards else F.lit(0))) / n)
    return F.struct(share.alias("similarity"), wild.alias("n_wildcards"))
