"""Extraction of parameter values from lines by their template."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PARAMETERS
from .masking import Masker, MaskRule

#: Template patterns that a worker keeps compiled.
CACHE = 3000


# What may have to change in a rule's pattern: names of groups and references to them; escaped backslashes are passed over.
_NAMES = re.compile(r"\\\\|\(\?P<(?P<define>\w+)>|\(\?P=(?P<refer>\w+)\)|\\(?P<number>[1-9]\d?)")


def _local(pattern: str, place: int) -> str:
    """A rule's pattern as a part of a larger one: its groups are named after the ``place`` of the mask, and a reference by
    number, which would mean another group there, is anything."""

    def changed(m: re.Match) -> str:
        if m["define"]:
            return f"(?P<{m['define']}__{place}>"
        if m["refer"]:
            return f"(?P={m['refer']}__{place})"
        return "(?:.+?)" if m["number"] else m[0]

    return _NAMES.sub(changed, pattern)


def template_pattern(template: str, rules: Sequence[MaskRule], prefix: str, suffix: str, exact: bool) -> tuple[str, list[str]]:
    """A pattern for the lines of a template, and the mask names of its masks in order; mask i is group ``v<i>``.

    A mask stands for what its rules match (``exact``) or for anything; a space for any white space.
    """
    known = {"*", *(r.mask_with for r in rules)}
    marks = "|".join(re.escape(prefix + n + suffix) for n in sorted(known, key=len, reverse=True))
    # literals and masks take turns
    parts = re.split(f"({marks})", template)
    literals = [r"\s+".join(map(re.escape, x.split(" "))) for x in parts[::2]]
    names = [x[len(prefix) : len(x) - len(suffix)] for x in parts[1::2]]
    masks = []
    for i, name in enumerate(names):
        fits = [_local(r.pattern, 100 * i + j) for j, r in enumerate(rules) if exact and r.mask_with == name]
        if not exact or name == "*":
            fits.append(".+?")
        masks.append(f"(?P<v{i}>{'|'.join(fits)})")
    return "^" + "".join(x + y for x, y in zip(literals, [*masks, ""], strict=True)) + "$", names


@lru_cache(CACHE)
def _compiled(template: str, rules: tuple[MaskRule, ...], prefix: str, suffix: str, exact: bool) -> tuple[re.Pattern, list[str]]:
    pattern, names = template_pattern(template, rules, prefix, suffix, exact)
    return re.compile(pattern), names


def _values(template: str | None, content: str | None, rules: tuple[MaskRule, ...], prefix: str, suffix: str, exact: bool, delimiters: Sequence[str]) -> list[dict] | None:
    if template is None or content is None:
        return None
    for d in delimiters:
        content = re.sub(d, " ", content)
    pattern, names = _compiled(template, rules, prefix, suffix, exact)
    m = pattern.match(content)
    return [{"value": m[f"v{i}"], "mask_name": name} for i, name in enumerate(names)] if m else None


def extract_parameters(lines: DataFrame, masker: Masker, exact: bool = True, delimiters: Sequence[str] = (), template_col: str = "template", content_col: str = "content", out_col: str = "parameters") -> DataFrame:
    """``lines`` with the values of each line's template in order, as array<struct<value, mask_name>>.

    Null if the line isn't one of the template's. ``delimiters`` are patterns that are blanks in the line. Patterns
    differ from row to row, so this runs in Python, in Arrow batches; each worker compiles a template once.
    """
    rules = tuple(r for r in masker.rules if isinstance(r, MaskRule))
    prefix, suffix = masker.prefix, masker.suffix

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("value", pa.string()), ("mask_name", pa.string())]))
        for batch in batches:
            pairs = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (template_col, content_col)), strict=True)
            made = [_values(t, c, rules, prefix, suffix, exact, delimiters) for t, c in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, out_col])

    schema = ", ".join(f"`{n}` {k}" for n, k in lines.dtypes)
    return lines.mapInArrow(run, f"{schema}, `{out_col}` {PARAMETERS}")


def parameter_list(lines: DataFrame, masker: Masker, **options) -> DataFrame:
    """``lines`` with the values only, of an inexact match; none if it fails."""
    out = extract_parameters(lines, masker, exact=False, **options)
    return out.withColumn("parameters", F.coalesce(F.transform("parameters", lambda p: p["value"]), F.array().cast("array<string>")))
