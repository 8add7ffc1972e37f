"""Folding and words, once for Column expressions and once for Python workers; both give the same result."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> dict[str, str]:
    """Letters of the Latin blocks to their base letter, by canonical decomposition."""
    out = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(cp).lower()
        base = unicodedata.normalize("NFD", c)
        if len(c) == 1 and len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            out[c] = base[0]
    return out


FOLDS = _folds()
_FROM, _TO = "".join(FOLDS), "".join(FOLDS.values())
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")
_USUAL = "\u0301\u0303\u0308\u0327\u0302\u0300"
_ASCII = frozenset(map(chr, range(128)))
_GAPS = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
_NO_LETTER = bytes(b for b in range(256) if not (97 <= b <= 122 or b == 10))


#: White space of Unicode, inside a character class of Java and of RE2 alike.
SPACE = r"\t\n\x0B\f\r\x{85}\p{Z}"


def strip(c: Column) -> Column:
    """The text without white space of any kind at both ends; trim() knows blanks only."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def fold(c: Column) -> Column:
    """Lower case without accents; null stays null. Combining marks are dropped, so both Unicode forms agree."""
    low = F.translate(F.lower(c), _FROM, _TO)
    return F.regexp_replace(low, r"[\u0300-\u036f]", "")


def fold_py(s: str) -> str:
    """As fold(), for Python workers."""
    s = s.lower()
    if s.isascii():
        return s
    s = unicodedata.normalize("NFD", s)
    for mark in _USUAL:
        s = s.replace(mark, "")
    return _MARKS.sub("", s) if any(unicodedata.combining(c) for c in set(s) - _ASCII) else s


def words_py(s: str | None) -> list[str]:
    """Maximal runs of letters or digits of the folded text; null and empty give none."""
    if not s:
        return []
    s = fold_py(s)
    if not s.isascii():
        if any(c.isalnum() for c in set(s) - _ASCII):
            return _WORD.findall(s)
        s = s.encode("ascii", "replace").decode()
    return s.translate(_GAPS).split()


def letters_py(s: str) -> str:
    """The letters a-z of the folded text and its line feeds, nothing else."""
    return unicodedata.normalize("NFD", s.lower()).encode("ascii", "ignore").translate(None, _NO_LETTER).decode()


def words(c: Column) -> Column:
    """As words_py(), as a Column: array<string>, null for null."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
