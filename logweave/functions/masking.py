"""Masking: ordered regular expressions, each replacing what it finds by a named mask."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes \d, \w, \s and \b Unicode-aware in Java.
UNICODE = "(?U)"


def replacement(text: str) -> str:
    """``text`` as a literal replacement for Java."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


@dataclass(frozen=True)
class MaskRule:
    """Replaces matches of ``pattern`` by the mask ``mask_with`` between prefix and suffix."""

    pattern: str
    mask_with: str

    def apply(self, content: Column, prefix: str = "<", suffix: str = ">") -> Column:
        return F.regexp_replace(content, UNICODE + java_groups(self.pattern), replacement(prefix + self.mask_with + suffix))


def java_groups(pattern: str) -> str:
    """A pattern with Python's named groups and named back-references in Java's spelling."""
    pattern = re.sub(r"\(\?P<([A-Za-z]\w*)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    return re.sub(r"\(\?P=([A-Za-z]\w*)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", pattern)


class Masker:
    """An ordered list of rules; a rule is a ``MaskRule`` or any callable from Column to Column."""

    def __init__(self, rules: Sequence[MaskRule | Callable[[Column], Column]], prefix: str = "<", suffix: str = ">") -> None:
        self.rules, self.prefix, self.suffix = list(rules), prefix, suffix
        self.by_name: dict[str, list[MaskRule]] = defaultdict(list)
        for rule in self.rules:
            if isinstance(rule, MaskRule):
                self.by_name[rule.mask_with].append(rule)

    @property
    def names(self) -> list[str]:
        return list(self.by_name)

    def mask(self, content: Column) -> Column:
        return reduce(lambda c, r: r.apply(c, self.prefix, self.suffix) if isinstance(r, MaskRule) else r(c), self.rules, content)


# The reference rule sets, patterns and order.
_DATE = r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+(\d{1,2}:\d{1,2}:\d{1,2})(?:\s+[A-Z]+)?\s+(\d{4})"
_SLOT = r"(?<=\s)[A-Z]\d{2}(?=\s)"
_REPEAT = r"(<\*>)(?:\s+<\*>)+"
_IPV6 = r"((?<=[^A-Za-z0-9])|^)(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})(:\d{1,5})?((?=[^A-Za-z0-9])|$)"
_IPV4 = r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(:\d{1,5})?((?=[^A-Za-z0-9])|$)"
_DOMAIN = r"([\w-]+\.){2,}(com|net|org|cn|io|edu)(:\d{1,5})?(?!\.)"
_PORT = r"(?:(?:https?|hdfs|ftp|tcp)://)?[\w.-]+:\d{1,5}(?=[\s:;.,\])]|$)"
_PATH = r"(://|//|\.?/)[^\s)]+(?:/[^\s)]*)*+/?(?<!:)(\?[^\s)]*)?"
_UUID = r"((?<=[^A-Za-z0-9])|^)(([0-9a-fA-F]{2,}:){3,}([0-9a-fA-F]{2,}))((?=[^A-Za-z0-9])|$)"
_HEX = r"((?<=[^A-Za-z0-9])|^)(?:0[X]([A-F0-9]+)|0[x]([a-f0-9]+))((?=[^A-Za-z0-9])|$)|((?<=[^A-Za-z0-9])|^)([A-F0-9]{6,})((?=[^A-Za-z0-9])|$)|((?<=[^A-Za-z0-9])|^)([a-f0-9]{6,})((?=[^A-Za-z0-9])|$)"
_NUM = r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)"
_EXECUTED = r'(?<=executed cmd )(".+?")'
_CMD = r"(?<=CMD [(])([^)]+)(?=[)])"
_NAMED_PORT = r"(?:(?:https?|hdfs|ftp)://)?[\w.-]+:\d{1,5}(?=[\s;.,\])]|$)"
_NAMED_PATH = r"(://|//|\.?/)[^\s.)]+(?:/[^\s.)]*)*+/?(?<!:)(\?[^\s).]*)?"
_UNIT = r"(?<![A-Za-z0-9])((B|KB|MB|GB|sec|secs|kbps))(?![A-Za-z0-9])"

#: The default set: everything becomes <*>.
WILDCARD_RULES = [MaskRule(p, "*") for p in (_DATE, _SLOT, _REPEAT, _IPV6, _IPV4, _DOMAIN, _PORT, _PATH, _UUID, _HEX, _NUM, _EXECUTED, _CMD)]
#: The named set, which keeps what kind of value it was.
NAMED_RULES = [
    MaskRule(_DATE, "DATE"),
    MaskRule(_SLOT, "SLOT"),
    MaskRule(_REPEAT, "*"),
    MaskRule(_IPV6, "IPV6"),
    MaskRule(_IPV4, "IPV4"),
    MaskRule(_DOMAIN, "DOMAIN"),
    MaskRule(_NAMED_PORT, "PORT"),
    MaskRule(_NAMED_PATH, "PATH"),
    MaskRule(_UUID, "UUID"),
    MaskRule(_HEX, "HEX"),
    MaskRule(_NUM, "NUM"),
    MaskRule(_UNIT, "UNIT"),
    MaskRule(_EXECUTED, "CMD"),
    MaskRule(_CMD, "CMD"),
]


def preprocess(content: Column, filters: Sequence[str] = (), patterns: Sequence[str] = ()) -> Column:
    """A dataset's own rules: what a filter matches goes, what a pattern matches becomes <*>."""
    for p in filters:
        content = F.regexp_replace(content, UNICODE + p, "")
    for p in patterns:
        content = F.regexp_replace(content, UNICODE + p, "<*>")
    return content


def or_wildcard(value: Column) -> Column:
    """A missing component or level becomes <*>."""
    return F.coalesce(F.trim(value), F.lit("<*>"))
