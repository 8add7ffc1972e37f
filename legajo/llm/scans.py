"""P7. Noise in the text of scanned pages.

Method: the words of all texts are counted; rare words are linked to frequent ones that differ by plausible glyph edits. Skip-gram
vectors decide in each place, from the neighbouring words, which link holds or none: the chance of a word is its frequency
times what its vector and those of its neighbours give. Running headers are lines that repeat the file's title in capitals, or
its manual and title in any case; page numbers are lines with nothing else; both are removed, divided words are joined and the lines
flow together again.

Vocabulary, links and vectors cover all texts. The vectors factorise the table of positive pointwise mutual information of
words and their neighbours, which is what skip-gram with negative sampling does implicitly (Levy and Goldberg 2014): the
counts and the second moments are sums over all texts, so no model travels but a matrix of fixed size.

Defined cases: null and empty texts have no noise and stay as they are. A null title or manual is that of the file if all its
rows agree; a file without a title knows no header. One row comes out for each kind of noise in a text, however often it occurs.
Headers and page numbers are not searched for misread letters. Runs of more than 40 characters without a blank are data (keys,
addresses, encoded files), no words of the text; nothing in them is misread.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions.text import fold_py
from legajo.session import small, spread, written

#: Glyphs and what they are misread from (fixed values).
GLYPHS = {"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "@": "a", "€": "e", "†": "t", "|": "i", "rn": "m", "ri": "n", "cl": "d", "ii": "u", "vv": "w"}
#: Without context a word counts as the right form if it is so many times as frequent as the misread one, and in so many rows at least.
TIMES, LEAST = 10, 3
#: Skip-gram vectors: neighbours on each side, most frequent words that serve as neighbours, length, rows a word needs for a vector of its own.
AROUND, CONTEXTS, DIMENSION, OWN = 3, 256, 24, 5
#: Links that travel in one pass (about 200 bytes each, vectors included).
LINKS = 200_000
#: Files without a title in some rows up to which their titles are broadcast.
FILES = 50_000

_GAPS = "".join(c if c.isalnum() or c in "@|\x01\x02" else " " for c in map(chr, range(128)))
_BREAK = re.compile(r"(?<=[^\W\d_])[-\xad¬‐][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_PAGE = re.compile(r"(?:-\s*\d+\s*-|—\s*\d+\s*—|–\s*\d+\s*–|\[\s*\d+\s*\]|\d+\s*/\s*\d+|\d+|p(?:ag(?:ina)?)?\.?\s*\d+(?:\s*(?:de|/)\s*\d+)?)")
_CHAPTER = re.compile(r"^capitulo\s+\d+\.\s*")
_LONG = re.compile(r"\S{41,}")
_ITEM = re.compile(r"\s*(?:[-•*]|\d+[.)]|#+)\s")
_LOWER = re.compile(r"[^\W\d_A-ZÁÉÍÓÚÑÜÀÂÃÇÊÔÕ]")


def glyph_words(folded: str) -> list[str]:
    """Words of a folded text in which the glyphs of misread letters are letters too."""
    if not folded.isascii():
        folded = folded.replace("€", "\x01").replace("†", "\x02").encode("ascii", "replace").decode()
    out = folded.translate(_GAPS)
    if "|" in out or "@" in out:
        return [x for x in out.split() if any(c.isalnum() for c in x)]
    return out.split()


def _glyphs(word: str) -> str:
    return word.replace("\x01", "€").replace("\x02", "†")


def _inner(word: str) -> str:
    """The form glyph_words() gives; _glyphs() undoes it."""
    return word.replace("€", "\x01").replace("†", "\x02")


def _joined(text: str) -> str:
    """Words divided at line ends are made whole."""
    return _BREAK.sub("", text) if ("\xad" in text or "¬" in text or "‐" in text or "-\n" in text or "-\r" in text or "- " in text) else text


def skeleton(c: Column) -> Column:
    """A word with every letter written as the strokes it can be misread as. A misreading never changes the skeleton."""
    c = F.translate(c, "o|68@€†9sl", "0ibbaetg51")
    for letter, strokes in (("m", "rri"), ("n", "ri"), ("u", "ii"), ("w", "vv"), ("d", "c1")):
        c = F.replace(c, F.lit(letter), F.lit(strokes))
    return c


def misread(word: str, original: str) -> bool:
    """Whether `word` is `original` with one letter or more misread."""
    places, edits = {0: 0}, 0  # places in word that are reached with the letters of original so far, and edits made there
    for c in original:
        nxt: dict[int, int] = {}
        for at, n in places.items():
            if word[at : at + 1] == c:
                nxt[at + 1] = max(nxt.get(at + 1, 0), n)
            for g, o in GLYPHS.items():
                if o == c and word.startswith(g, at):
                    nxt[at + len(g)] = max(nxt.get(at + len(g), 0), n + 1)
        places = nxt
    edits = places.get(len(word), 0)
    return edits > 0


def _as_read(word: str, original: str) -> str | None:
    """`original` with the accents that `word`, in lower case, still has; None if it isn't a misreading of it."""
    ways = {0: ""}
    for c in original:
        nxt: dict[int, str] = {}
        for at, s in ways.items():
            if at < len(word) and fold_py(word[at]) == c:
                nxt.setdefault(at + 1, s + word[at])
            for g, o in GLYPHS.items():
                if o == c and word.startswith(g, at):
                    nxt.setdefault(at + len(g), s + c)
        ways = nxt
    return ways.get(len(word))


def _count_words(flush: int = 200_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b["texto"]:
                if t:
                    seen.update(set(glyph_words(fold_py(_joined(t)))))
            if len(seen) > flush:
                yield pd.DataFrame({"word": list(map(_glyphs, seen)), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(map(_glyphs, seen)), "n": list(seen.values())})

    return run


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, df) over all texts; numbers are left out, they are never the right form of a word."""
    parts = spread(texts.select("texto").where("texto is not null")).mapInPandas(_count_words(), "word string, n bigint")
    return parts.where(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(F.sum("n").alias("df"))


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [misread(w, o) for w, o in zip(b["word"], b["original"], strict=True)]
        yield b[keep]


def links(known: DataFrame) -> DataFrame:
    """(word, original, df, veces): words and the ones, at least as frequent, that they may be misread from.

    Words meet by their skeleton, so no misreading is lost, however long the word or many its edits.
    """
    keyed = known.withColumn("_k", skeleton(F.col("word")))
    right = keyed.where((F.col("df") >= LEAST) & F.col("word").rlike(r"^\p{L}{2,}$")).select("_k", F.col("word").alias("original"), F.col("df").alias("veces"))
    pairs = keyed.join(right, "_k").where("word <> original and veces >= df").select("word", "original", "df", "veces")
    return pairs.mapInPandas(_checked, "word string, original string, df bigint, veces bigint")


def _neighbours(centers: list[str], contexts: list[str]):
    """Counts of (center, context) within AROUND places, over whole batches at once."""
    width = len(contexts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = {w: i for i, w in enumerate(dict.fromkeys([*centers, *contexts]))}
        center = np.full(len(code) + 1, -1, dtype=np.int64)
        center[[code[w] for w in centers]] = np.arange(len(centers))
        context = np.full(len(code) + 1, -1, dtype=np.int64)
        context[[code[w] for w in contexts]] = np.arange(width)
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        get, gap = code.get, [len(code)] * AROUND
        for b in batches:
            ids: list[int] = []
            for t in b["texto"]:
                if t:
                    ids += [get(w, -1) for w in glyph_words(fold_py(_joined(t)))]
                    ids += gap
            at = np.array(ids, dtype=np.int64)
            at[at < 0] = len(code)
            c, x = center[at], context[at]
            found = []
            for off in range(1, AROUND + 1):
                for left, right in ((c[:-off], x[off:]), (c[off:], x[:-off])):
                    both = (left >= 0) & (right >= 0)
                    found.append(left[both] * width + right[both])
            k, n = np.unique(np.concatenate(found), return_counts=True)
            k, where = np.unique(np.concatenate([keys, k]), return_inverse=True)
            keys, counts = k, np.bincount(where, np.concatenate([counts, n]), len(k)).astype(np.int64)
        if len(keys):
            yield pd.DataFrame({"center": keys // width, "context": keys % width, "n": counts})

    return run


def _table(rows: pd.DataFrame, width: int) -> np.ndarray:
    m = np.zeros((len(rows), width))
    for i, cells in enumerate(rows["cells"]):
        for x in cells:
            m[i, x["context"]] = x["n"]
    return m


def _surprise(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Positive pointwise mutual information of each row with each neighbour, whose smoothed shares are given."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.maximum(0.0, np.nan_to_num(np.log(counts / (counts.sum(axis=1, keepdims=True) * share)), nan=0.0, neginf=0.0))


class Vectors:
    """Skip-gram vectors: of words, and of the frequent words that are their neighbours."""

    def __init__(self, words: dict[str, np.ndarray] | None = None, contexts: dict[str, np.ndarray] | None = None):
        self.words, self.contexts = words or {}, contexts or {}

    def fit(self, word: str, around: np.ndarray | None) -> float:
        """How much likelier than anywhere the word is among these neighbours, as a logarithm; 0 for a word without a vector."""
        v = self.words.get(word)
        return 0.0 if v is None or around is None else float(v @ around)


def word_vectors(texts: DataFrame, centers: list[str], contexts: list[str], dimension: int = DIMENSION) -> Vectors:
    """Vectors of `centers` from the counts of all texts."""
    if not centers or not contexts:
        return Vectors()
    width = len(contexts)
    parts = spread(texts.select("texto").where("texto is not null")).mapInPandas(_neighbours(centers, contexts), "center bigint, context bigint, n bigint")
    counts = written(parts.groupBy("center", "context").agg(F.sum("n").alias("n")), "vecinos")
    total = np.zeros(width)
    for r in counts.groupBy("context").agg(F.sum("n").alias("n")).collect():
        total[r.context] = r.n
    if not total.any():
        return Vectors()
    share = total**0.75 / (total**0.75).sum()
    share[share == 0] = 1.0
    rows = counts.groupBy("center").agg(F.collect_list(F.struct("context", "n")).alias("cells"))  # at most CONTEXTS cells each

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros((width, width))
        for b in batches:
            m = _surprise(_table(b, width), share)
            s += m.T @ m
        yield pd.DataFrame({"s": [s.tobytes()]})

    rows = written(rows, "filas")
    second = sum(np.frombuffer(r.s).reshape(width, width) for r in rows.coalesce(16).mapInPandas(moments, "s binary").collect())
    values, basis = np.linalg.eigh(second)
    basis = basis[:, np.argsort(-values)[:dimension]]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"center": b["center"], "v": list(_surprise(_table(b, width), share) @ basis)})

    words = {centers[r.center]: np.array(r.v, dtype=np.float32) for r in rows.mapInPandas(project, "center bigint, v array<double>").collect()}
    return Vectors(words, {w: basis[i].astype(np.float32) for i, w in enumerate(contexts)})


def _choose(at: int, ws: list[str], options: list[tuple[str, int, int]], vectors: Vectors) -> str | None:
    """The likeliest original of the word in this place, by frequency and neighbours; None if the word itself is likelier."""
    near = [vectors.contexts[x] for x in ws[max(0, at - AROUND) : at] + ws[at + 1 : at + 1 + AROUND] if x in vectors.contexts]
    around = np.sum(near, axis=0) if near else None
    own = vectors.fit(ws[at], around)
    best, score = None, 0.0
    for o, times, df in options:
        s = math.log(times / (TIMES * df)) + vectors.fit(o, around) - own
        if best is None and s >= 0.0 or s > score:
            best, score = o, s
    return best


def is_header(line: str, title: str, manual: str | None = None) -> bool:
    """A line that repeats at least 60 % of the title from its start, in capitals or after the manual; misread letters don't matter."""
    if len(line) < 8:
        return False
    for gl, c in (("|", "i"), ("@", "a"), ("€", "e"), ("†", "t")):
        if gl in line:
            line = line.replace(gl, c)
    capitals = not _LOWER.search(line)
    s = _CHAPTER.sub("", re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", fold_py(line)).strip())
    s = re.sub(r"\s+\d+$", "", s).split(" — ")[0]
    s = re.sub(r"(?<=[a-z])[015](?=[a-z])", lambda m: GLYPHS[m.group()], s)
    a, b = re.sub("[^a-z]", "", s), re.sub("[^a-z]", "", fold_py(title))
    if not capitals:
        m = re.sub("[^a-z]", "", fold_py(manual or ""))
        if not m or not a.startswith(m):
            return False
        a = a[len(m) :]
    return len(a) >= 6 and len(a) >= 0.6 * min(len(b), 34) and b.startswith(a)


def is_page(line: str) -> bool:
    """A line with nothing but a page number."""
    s = line.strip()
    return 0 < len(s) <= 24 and any(c.isdigit() for c in s) and _PAGE.fullmatch(fold_py(s)) is not None


def _divided(a: str, b: str) -> bool:
    """Whether line a ends inside a word that line b goes on with."""
    a = a.rstrip(" \t\r")
    b = b.lstrip(" \t")
    if len(a) < 2 or a[-1] not in "-\xad¬‐" or not a[-2].isalpha() or not b[:1].isalpha():
        return False
    return b[0].islower() if a[-2].islower() else b[0].isupper() and (len(b) < 2 or not b[1].islower())


def inspect(text: str, title: str | None, manual: str | None, bad: dict[str, list[tuple[str, int, int]]], vectors: Vectors, repair: bool, known: dict[str, str] | None = None, last: bool = True) -> tuple[list[str], str, dict[str, str]]:
    """(kinds of noise, repaired text; empty unless wanted, misread words and what they were).

    `known` are the words that former passes found. Only the last pass changes the text, with the words of all passes.
    """
    kinds, keep = [], []
    lines = text.split("\n")
    wide = float(np.median([len(x) for x in lines if x.strip()] or [0]))
    first = fold_py(manual)[:1] if title and manual and " / " in text else ""
    for line in lines:
        s = line.strip()
        if s and len(s) <= 24 and is_page(s):
            kinds.append("pagina")
        elif title and len(s) >= 8 and (first and " / " in s and fold_py(s[0]) == first or not _LOWER.search(s)) and is_header(s, title, manual):
            kinds.append("cabecera")
        else:
            keep.append(line)
    if "\xad" in text or "¬" in text or "‐" in text or "-" in text:
        i = 0
        while i < len(keep) - 1:
            if _divided(keep[i], keep[i + 1]):
                kinds.append("guion")
                keep[i : i + 2] = [keep[i].rstrip(" \t\r")[:-1] + keep[i + 1].lstrip(" \t")]
            else:
                i += 1
    body = "\n".join(keep)
    ws = glyph_words(fold_py(body))
    fixes = dict(known or {})
    if not bad.keys().isdisjoint(ws):
        ws = glyph_words(fold_py(_LONG.sub(" ", body)))
        for i, w in enumerate(ws):
            if (o := bad.get(w)) and (best := _choose(i, ws, o, vectors)):
                fixes[_glyphs(w)] = best
    if not last:
        return [], text, fixes
    if fixes:
        kinds.append("caracter")
    return list(dict.fromkeys(kinds)), _flow(body, fixes, wide) if repair and kinds else body if repair else "", fixes


def _flow(body: str, fixes: dict[str, str], wide: float) -> str:
    """Misread words replaced in their own case, wrapped lines joined to paragraphs."""
    if fixes:
        word = re.compile(r"[\w@€†|]+")

        def put(m: re.Match) -> str:
            w = m.group()
            best = fixes.get(fold_py(w))
            if best is None:
                return w
            best = _as_read(w.lower(), best) or best  # keeps the accents that were read
            return best.upper() if w.upper() == w and any(c.isalpha() for c in w[1:]) else best.capitalize() if w[0].isupper() else best

        body = word.sub(put, body)
    lines = body.split("\n")
    out: list[str] = []
    last = 0
    for line in lines:
        s = line.strip()
        wrapped = out and out[-1] and s and last >= 0.6 * wide and not _ITEM.match(s) and s.upper() != s
        if wrapped:
            out[-1] += " " + s
        else:
            out.append(s)
        last = len(s)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def _rows(bad: dict[str, list[tuple[str, int, int]]], vectors: Vectors, repair: bool, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [inspect(t, h, m, bad, vectors, repair, dict(x.split() for x in old), last) if t else ([], t, {}) for t, h, m, old in zip(b["texto"], b["titulo"], b["manual"], b["fallos"], strict=True)]
            texts = [t for _, t, _ in found] if repair or not last else [None] * len(b)
            out = {"fila": b["fila"], "titulo": pd.Series(b["titulo"], dtype=object), "manual": pd.Series(b["manual"], dtype=object), "ruidos": [k for k, _, _ in found], "texto": pd.Series(texts, dtype=object, index=b.index)}
            yield pd.DataFrame(out | {"fallos": pd.Series([[] if last else list(map(" ".join, f.items())) for _, _, f in found], dtype=object, index=b.index)})

    return run


def titled(texts: DataFrame) -> DataFrame:
    """(fila, titulo, manual, texto); a null title or manual is taken from the file's other rows if they all agree."""
    rows = texts.select("fila", "documento", "titulo", "manual", "texto")
    bare = rows.where("documento is not null and texto is not null and (titulo is null or manual is null)").select("documento").distinct()
    few = small(bare, FILES)
    of_file = rows.select("documento", "titulo", "manual").join(F.broadcast(bare) if few else bare, "documento", "left_semi").groupBy("documento")
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(f"_{c}")
    known = of_file.agg(same("titulo"), same("manual"))
    return rows.join(F.broadcast(known) if few else known, "documento", "left").select("fila", F.coalesce("titulo", "_titulo").alias("titulo"), F.coalesce("manual", "_manual").alias("manual"), "texto")


def inspected(texts: DataFrame, repair: bool = False, vectors: Vectors | None = None) -> DataFrame:
    """(fila, ruidos, texto) of every row. `vectors` replaces the learned ones."""
    known = written(vocabulary(texts), "vocabulario")
    linked = written(links(known), "enlaces")
    contexts = [_inner(r.word) for r in known.orderBy(F.desc("df"), "word").limit(CONTEXTS).collect()]
    # Links beyond the bound go over the texts in further passes, all links of one word in the same pass; the last one repairs.
    passes = 1 if small(linked, LINKS) else 2 + linked.count() // LINKS
    rows = spread(titled(texts)).withColumn("fallos", F.array().cast("array<string>"))
    for i in range(passes):
        bad: dict[str, list[tuple[str, int, int]]] = {}
        own = {}
        for r in linked.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == i).orderBy("word", "original").collect():
            bad.setdefault(_inner(r.word), []).append((r.original, r.veces, r.df))
            own[r.original] = None
            if r.df >= OWN:
                own[_inner(r.word)] = None
        model = (word_vectors(texts, list(own), contexts) if vectors is None else vectors) if bad else Vectors()
        rows = rows.select("fila", "titulo", "manual", "texto", "fallos").mapInPandas(_rows(bad, model, repair, i == passes - 1), "fila bigint, titulo string, manual string, ruidos array<string>, texto string, fallos array<string>")
    return rows.select("fila", "ruidos", "texto")


def noise(texts: DataFrame) -> DataFrame:
    """(fila, ruido): one row for each kind of noise in a text."""
    return inspected(texts).select("fila", F.explode("ruidos").alias("ruido"))


def repaired(texts: DataFrame) -> DataFrame:
    """(fila, texto) of every row; texts without noise come out as they are."""
    return inspected(texts, repair=True).select("fila", "texto")
