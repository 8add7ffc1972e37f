"""P6. Long texts in pieces that end at natural boundaries.

Method: content-defined chunking. A rolling hash over the last `window` characters marks landmarks wherever its low bits
are zero; each landmark between the least and the greatest piece size snaps to the nearest natural boundary. The strongest
kind of boundary wins: page, paragraph, line, sentence, word; only a stretch without any is cut at the limit. Cuts depend on the
text around them alone, so an edit moves the pieces near it and the others return.

Defined cases: null and blank texts give no piece. A text within the limit is one piece. Pieces are slices of the text
after removal of spaces, tabs, CR and LF at both ends; each begins with up to `overlap` characters of the end of the one before
it, from a word's start. `pagina` is the first number in the field (1 where there is none) plus the form feeds before
the piece. Python touches only texts above the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST = 1800, 200, 600
_BREAKS = [re.compile(p) for p in (r"\f", r"\r?\n[ \t]*\r?\n\s*", r"\n", r"[.!?…][»”\")\]]*\s+", r"\s+")]
_EDGE = " \t\r\n"


def landmarks(text: str, window: int = 32, bits: int = 6) -> np.ndarray:
    """Ends of the windows whose rolling hash has `bits` low zero bits; one in 2**bits places on average."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(c) < window:
        return np.empty(0, dtype=np.int64)
    base = np.uint64(0x9E3779B97F4A7C15)
    mixed = (c + np.uint64(1)) * base
    mixed ^= mixed >> np.uint64(29)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(window, np.uint64(0x100000001B3), dtype=np.uint64))[::-1]
        h = np.zeros(len(c) - window + 1, dtype=np.uint64)
        for j in range(window):
            h += mixed[j : j + len(h)] * powers[j]
    h ^= h >> np.uint64(32)
    return np.flatnonzero((h & np.uint64((1 << bits) - 1)) == 0) + window


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text; start includes the overlap. Every piece has at most `limit` characters."""
    ends = [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in _BREAKS]
    marks = landmarks(text)
    out: list[tuple[int, int]] = []
    begin, start = 0, 0  # new text from begin; the piece from start, which may lie before it
    n = len(text)
    while n - start > limit:
        low, high = max(begin + 1, min(start + least, start + limit)), start + limit
        end = high
        for kind in ends:
            lo, hi = np.searchsorted(kind, low), np.searchsorted(kind, high, side="right")
            if hi > lo:
                own = kind[lo:hi]
                a, b = np.searchsorted(marks, low), np.searchsorted(marks, high, side="right")
                # the last landmark in reach snaps to its nearest boundary; without one the farthest boundary serves
                end = int(own[np.argmin(np.abs(own - marks[b - 1]))]) if b > a else int(own[-1])
                break
        out.append((start, end))
        begin = end
        start = max(end - overlap, out[-1][0] + 1)
        if end < n:
            words = ends[4]
            k = np.searchsorted(words, start)
            start = int(words[k]) if k < len(words) and words[k] <= end else end
    out.append((start, n))
    return out


def _first_page(page: str | None) -> int:
    m = re.search(r"\d+", page or "")
    return int(m.group()[:9]) if m else 1


def _pieces(limit: int, overlap: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for fila, page, text in zip(b["fila"], b["pagina"], b["texto"], strict=True):
                text = text.strip(_EDGE)
                first = _first_page(page)
                for i, (s, e) in enumerate(cuts(text, limit, overlap, least), 1):
                    rows.append((fila, i, first + text.count("\f", 0, s), s, text[s:e]))
            yield pd.DataFrame(rows, columns=["fila", "pieza", "pagina", "desde", "texto"])

    return run


def _trimmed(c):
    return F.expr(f"trim(BOTH ' \\t\\r\\n' FROM {c})")


def long_pieces(fragments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(fila, pieza, pagina, desde, texto) of the texts above the limit; desde counts the characters before the piece."""
    rows = fragments.select("fila", "pagina", "texto").where(F.length(_trimmed("texto")) > limit)
    return rows.mapInPandas(_pieces(limit, overlap, least), "fila bigint, pieza int, pagina bigint, desde int, texto string")


def pieces(fragments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """As long_pieces(), with every text within the limit as one piece."""
    t = _trimmed("texto")
    whole = fragments.where((F.length(t) > 0) & (F.length(t) <= limit)).select(
        "fila", F.lit(1).alias("pieza"), F.coalesce(F.expr("try_cast(nullif(substring(regexp_extract(pagina, '[0-9]+', 0), 1, 9), '') AS bigint)"), F.lit(1)).cast("bigint").alias("pagina"), F.lit(0).alias("desde"), t.alias("texto")
    )
    return whole.unionByName(long_pieces(fragments, limit, overlap, least))


def oversized(fragments: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(fila) of the texts that were cut."""
    return long_pieces(fragments, limit).where("pieza = 2").select("fila")


def checked(fragments: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(fila, piezas_mal, largo) of every text that is not blank: pieces that break a rule, and the characters that all of them cover.

    A piece is wrong if it is empty or too long, if it is not the slice of the text at its place, if it leaves a gap to the
    one before, repeats more than `overlap` characters of it or adds nothing, or if its page isn't the first one plus the form
    feeds before it.
    """
    body = fragments.select("fila", _trimmed("texto").alias("_t"), F.coalesce(F.expr("try_cast(nullif(substring(regexp_extract(pagina, '[0-9]+', 0), 1, 9), '') AS bigint)"), F.lit(1)).alias("_p"))
    p = pieces(fragments, limit, overlap, least).withColumn("_e", F.col("desde") + F.length("texto"))
    of_row = p.groupBy("fila").agg(F.array_sort(F.collect_list(F.struct("pieza", "desde", F.col("_e").alias("e"), "pagina", "texto"))).alias("_x"))  # one row's pieces
    before = lambda i: F.try_element_at(F.transform("_x", lambda y: y.e), i)
    feeds = lambda y: F.length(F.substring(F.col("_t"), F.lit(1), y.desde)) - F.length(F.replace(F.substring(F.col("_t"), F.lit(1), y.desde), F.lit("\f"), F.lit("")))
    wrong = lambda y, i: (
        (F.length(y.texto) == 0) | (F.length(y.texto) > limit) | (y.pieza != i + 1) | (F.substring(F.col("_t"), y.desde + 1, F.length(y.texto)) != y.texto) | (y.pagina != F.col("_p") + feeds(y))
        | F.when(i == 0, y.desde != 0).otherwise((y.desde > before(i)) | (before(i) - y.desde > overlap) | (y.e <= before(i)))
    )
    return body.where(F.length("_t") > 0).join(of_row, "fila", "left").select("fila", F.coalesce(F.size(F.filter("_x", wrong)), F.lit(-1)).alias("piezas_mal"), F.array_max(F.transform("_x", lambda y: y.e)).alias("largo"))
