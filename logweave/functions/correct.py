"""Correction of contents and templates: rules that turn variable-looking runs into <*>, as one chain of Columns.

The rules look at maximal runs of characters that are no delimiter, so each is one replacement whose ends are look-
arounds on the delimiter class. Repeats are possessive: a run is read once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .masking import UNICODE

# Delimiters of path-like runs, further delimiters of tokens, and words that are values.
_PATH_DELIMITERS = r"\s,!;:=|\"'+\[\](){}"
_TOKEN_DELIMITERS = _PATH_DELIMITERS + r".\-@#$%&/"
_VALUES = ("true", "false", "null", "root")


def _run(body: str, delimiters: str) -> str:
    """A pattern for whole runs that match ``body``."""
    return f"{UNICODE}(?<![^{delimiters}])(?:{body})(?![^{delimiters}])"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    odd = UNICODE + r"^\s|\s$|\s\s|[^\S ]"
    return let(text, lambda t: F.when(t.rlike(odd), F.regexp_replace(F.regexp_replace(t, UNICODE + r"^\s+|\s+$", ""), UNICODE + r"\s+", " ")).otherwise(t))


def paths(text: Column) -> Column:
    """Runs like /a/b, or with a slash and later a dot, become <*>."""
    d = _PATH_DELIMITERS
    return _if(text, "/", _run(rf"(?:/[^/{d}]++)++/?+|[^/{d}]*+/[^.{d}]*+\.[^{d}]*+", d))


def _digit_body() -> str:
    d = _TOKEN_DELIMITERS
    few = "|".join(rf"(?=[^{d}]{{{n},{most}}}(?![^{d}]))(?:[^\d{d}]*+\d){{{n}}}[^\d{d}]*+" for n, most in ((1, 3), (2, 6), (3, 9)))
    return rf"(?!\p{{L}})(?![^{d}]*\p{{Lu}})(?:(?:[^\d{d}]*+\d){{4}}[^{d}]*+|{few})"


def values(text: Column, user_strings: Sequence[str] = ()) -> Column:
    """Tokens that are literals, digits-domain words or hold a wildcard become <*>.

    Digits-domain: a digit, no letter in front, no capital, and four digits or more than 0.3 of all characters.
    """
    d = _TOKEN_DELIMITERS
    words = "|".join(re.escape(w) for w in (*_VALUES, *user_strings))
    return F.regexp_replace(text, _run(rf"(?:{words})(?![^{d}])|{_digit_body()}|[^{d}]*?<\*>[^{d}]*+", d), "<*>")


def _if(text: Column, part: str, pattern: str) -> Column:
    """``pattern`` replaced by a wildcard, if ``part``, which all its matches hold, is in the text: most texts aren't searched."""
    return let(text, lambda t: F.when(t.contains(part), F.regexp_replace(t, pattern, "<*>")).otherwise(t))


def _chain(text: Column, sep: str) -> Column:
    return _if(text, f"<*>{sep}<*>", rf"<\*>(?:{re.escape(sep)}<\*>)++")


def _unwrap(text: Column) -> Column:
    """#<*># becomes <*> until none is left: as often as the longest run of # before a wildcard at most."""

    def all_of(t: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(t, F.lit(r"(#+)(?=<\*>#)"), F.lit(1)), F.length)
        return F.when(t.contains("#<*>#"), F.aggregate(F.sequence(F.lit(1), F.array_max(runs)), t, lambda a, _: F.regexp_replace(a, r"#<\*>#", "<*>"))).otherwise(t)

    return let(text, all_of)


def collapse(text: Column) -> Column:
    """Wildcards next to each other, or with one symbol between them, become one."""
    text = _chain(_chain(text, "."), "")
    text = _unwrap(text)
    text = _chain(_chain(text, ":"), "/")
    text = _if(text, " #<*> ", r"(?<= )#<\*>(?= )")
    for sep in (":", "#", "/", "@", "."):
        text = _chain(text, sep)
    text = _if(text, ' "<*>" ', r'(?<= )"<\*>"(?= )')
    return _chain(text, "")


def collapse_spaced(text: Column) -> Column:
    """As ``collapse``, with spaces around the symbol, or a space alone."""
    for sep in (" : ", " / ", " # ", " @ ", " . ", " , ", " "):
        text = _chain(text, sep)
    return text


def key_values(text: Column) -> Column:
    """If there are several pairs and a value is <*>, then every k = v before another key or the end becomes k = <*>."""

    def general(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(UNICODE + r"(\b\w+)\s*=\s*([^\s;]*)?"), F.lit(2))
        # a pair needs its sign: other texts aren't searched
        several = t.contains("=") & (F.size(found) > 1) & F.array_contains(found, "<*>")
        return F.when(several, F.regexp_replace(t, UNICODE + r"(\b\w+)\s*=\s*([^=\s;]*)(?=\s+\w+\s*=|$)", "$1 = <*>")).otherwise(t)

    return let(text, general)


def correct_input(text: Column, user_strings: Sequence[str] = ()) -> Column:
    """What contents go through before they are cut into tokens."""
    return key_values(collapse(values(paths(squeeze(text)), user_strings)))


def correct_final(text: Column, user_strings: Sequence[str] = ()) -> Column:
    """What templates go through at the end."""
    return key_values(collapse_spaced(collapse(values(paths(squeeze(text)), user_strings))))


def correct_response(response: Column) -> Column:
    """The template in a model's answer: the longest piece between back-ticks; '' if nothing but wildcards is left."""
    line = F.replace(response, F.lit("\n"), F.lit(""))
    between = F.regexp_extract(line, "`(.*)`", 1)
    pieces = F.filter(F.split(between, "`"), lambda p: F.replace(F.replace(p, F.lit(" "), F.lit("")), F.lit("<*>"), F.lit("")) != "")
    longest = F.aggregate(pieces, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    template = F.regexp_replace(F.regexp_replace(longest, r"\{\{.*?\}\}", "<*>"), r"\$\{.*?\}", "<*>")
    template = correct_final(template)
    return F.when(F.regexp_replace(template, r"<\*>| ", "") == "", F.lit("")).otherwise(template)
