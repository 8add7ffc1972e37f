"""How texts of a collection end: an n-gram likelihood of the end of text, shared by P1 and P10.

The ends of all distinct texts are counted, and how often the same n-grams stand inside them
(every text is a labelled example of its own: its last place is an end, all others are not). For the last characters of a text the
model gives the chance that a text ends there; inside a word or a sentence it is small.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions.text import fold_py
from legajo.session import small, spread, written

ORDERS = (1, 2, 3, 4, 6, 8, 12, 18)
#: Ends and inner n-grams are counted in all texts, then brought to the scale of so many, on which WEIGHT and SUPPORT are stated. Ends are kept
#: from this share of the texts on, so a model has a fixed size.
PER, SHARE = 4_000, 1 / 20_000
#: Hashes of repeated texts up to which they are broadcast.
COPIES = 200_000
#: Weight of the shorter suffix in places, and the chance of an end at which a cut is as likely as not.
WEIGHT, EVEN = 20.0, 0.015
#: Places a suffix of three characters or more must have on that scale to count; ends count tenfold.
SUPPORT = 40

#: Marks that are put after a cut: blanks, dots, arrows, "[...]", an opened remark, an opened tag, an opened character reference, a broken character.
MARKS = re.compile(
    r"(?:[\s​‌‍⁠﻿\xa0\xad�]|…|\.{2,}|[\[(]\s*(?:\.{2,}|…)\s*[\])]?|[\[(<{]\s*(?:continua|sigue|cont|cortado|truncado|recortado|leer mas|ver mas|mas|more|truncated|cut|continued|continues)\b[^\])>}]{0,24}[\])>}]?|<[^<>]{0,200}|&#?[0-9a-z]{0,6}|(?:\.{2,}|…)\s*(?:leer mas|ver mas|seguir leyendo|read more|more|continua|sigue)|>{2,}|→|»{2,}|[-–—]+)+$"
)


def plain(text: str) -> str:
    """Folded, numbers with separators as one 9 and other digits as 9, blanks of one kind; the form in which endings are compared."""
    return re.sub(r"[ \t\xa0]+", " ", re.sub(r"\d", "9", re.sub(r"\d+(?:[.,/:]\d+)+", "9", fold_py(text).replace("\r\n", "\n"))))


def unmarked(text: str) -> tuple[str, bool]:
    """The text without marks after a cut, and whether a mark other than blanks was there."""
    tail = fold_py(text[-400:])
    if len(tail) != len(text[-400:]):
        tail = text[-400:].lower()
    m = MARKS.search(tail)
    if not m:
        return text, False
    mark = tail[m.start() :].strip(" \t\r\n​﻿\xa0")
    if mark and not mark.strip("-–—"):  # a dash alone may belong to the text
        mark = ""
    return text[: len(text) - (len(tail) - m.start())], bool(mark)


def tail(body: str) -> str:
    """The end of a text without marks, in the form that is counted."""
    return plain(body[-64:])


class Endings:
    """Counts of n-grams at ends, and anywhere else on a scale of their own: `scale` texts of it stand for each text with an end."""

    def __init__(self, ends: dict[str, int], inner: dict[str, float], n_ends: float, n_inner: float, scale: float = 1.0):
        self.ends, self.inner, self.n_ends, self.n_inner, self.scale = ends, inner, max(1.0, n_ends), max(1, n_inner), scale

    def chance(self, t: str) -> float:
        """P(a text ends here | its tail), from the longest suffix that enough texts have.

        The last two characters give the prior. One end is taken off each count, so that a text is not its own evidence. The
        search stops at the first suffix with which no text ends.
        """
        p = prior = self.n_ends / (self.n_ends + self.n_inner)
        for k in ORDERS:
            g = t[-k:]
            n, i = self.ends.get(g, 0), self.inner.get(g, 0)
            if len(t) < k or not n:
                break
            e, own = n * self.scale, (n - 1) * self.scale
            if k <= 2 or e >= SUPPORT // 10 or e + i >= SUPPORT:
                p = (own + WEIGHT * prior) / (own + i + WEIGHT)
            if k <= 2:
                prior = p
        return p

    def tail_odds(self, t: str) -> float:
        """Log odds of a cut after a tail, 0 where an end is as likely as not."""
        return math.log(EVEN) - math.log(max(self.chance(t), 1e-9))

    def cut_odds(self, body: str) -> float:
        return self.tail_odds(tail(body))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k characters before each place."""
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(-k, 0):
        h = h * _BASE + codes[at + j]
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _count_inner(grams: frozenset[str]):
    """Places of each gram inside texts, the end apart. The suffixes of a gram are grams too, so only places that hold the shorter one are looked at for the longer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {}
        for k in ORDERS:
            own = sorted((int(_hashes(_codes(g), np.array([k]), k)[0]), g) for g in grams if len(g) == k)
            known[k] = np.array([h for h, _ in own], dtype=np.uint64), [g for _, g in own]
        counts = {k: np.zeros(len(v[1]), dtype=np.int64) for k, v in known.items()}
        places = rows = 0
        for b in batches:
            for lo in range(0, len(b), 1000):
                texts = [plain(x) for x in b["t"].iloc[lo : lo + 1000]]
                size = np.array([len(t) for t in texts], dtype=np.int64)
                codes = _codes("".join(texts))
                start = np.cumsum(size) - size
                here = np.arange(len(codes)) - np.repeat(start, size)  # characters of the same text before each place
                at = np.flatnonzero(here > 0)
                places, rows = places + int(size.sum()), rows + len(texts)
                for k in ORDERS:
                    hashes = known[k][0]
                    at = at[here[at] >= k]
                    if not len(hashes) or not len(at):
                        break
                    h = _hashes(codes, at, k)
                    i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = hashes[i] == h
                    counts[k] += np.bincount(i[hit], minlength=len(hashes))
                    at = at[hit]
        if rows:
            found = [(g, int(n)) for k in ORDERS for g, n in zip(known[k][1], counts[k], strict=True) if n]
            yield pd.DataFrame([*found, ("\0", places), ("\1", rows)], columns=["g", "n"])

    return run


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"cola": [tail(unmarked(t)[0]) for t in b["t"]]})


def tails(texts: DataFrame, text_col: str) -> DataFrame:
    """(cola) of every distinct text; copies of a cut text prove nothing."""
    rows = texts.where(F.length(text_col) >= 20).select(F.xxhash64(text_col).alias("h"), F.expr(f"right(`{text_col}`, 400)").alias("t"))
    return rows.dropDuplicates(["h"]).select("t").mapInPandas(_tails, "cola string")


def _distinct(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(t) of every distinct text; only hashes are gathered, of the copies the one with the smallest id stays."""
    rows = texts.where(F.length(text_col) >= 20).select(F.xxhash64(text_col).alias("h"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    copies = written(rows.groupBy("h").agg(F.min("i").alias("_i"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "copias")
    rows = rows.join(F.broadcast(copies) if small(copies, COPIES) else copies, "h", "left")
    return rows.where(F.col("_n").isNull() | F.col("i").eqNullSafe(F.col("_i"))).select("t")


def fit(texts: DataFrame, id_col: str, text_col: str, ends: DataFrame | None = None, per: int = PER) -> Endings:
    """Ends (`ends`, as tails() gives, if they are known already) and inner places of all distinct texts, brought to the scale of `per` texts."""
    ends = tails(texts, text_col) if ends is None else ends
    grams = F.explode(F.array(*[F.when(F.length("cola") >= k, F.expr(f"right(cola, {k})")) for k in ORDERS]))
    # every tail that is not empty has one suffix of one character
    counted = written(ends.select(grams.alias("g")).where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n")), "finales")
    n = counted.where(F.length("g") == 1).agg(F.sum("n")).first()[0] or 0
    kept = {r.g: r.n for r in counted.where(F.col("n") >= SHARE * n).collect()}
    rows = spread(_distinct(texts, id_col, text_col))
    inner = {r.g: r.n for r in rows.mapInPandas(_count_inner(frozenset(kept)), "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    total, seen = inner.pop("\0", 0), inner.pop("\1", 0)
    scale = min(1.0, per / max(1, seen))
    return Endings(kept, {g: i * scale for g, i in inner.items()}, seen * scale, total * scale, seen * scale / max(1, n))
