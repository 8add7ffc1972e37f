"""Building fragments from pages and manuals: numbered sections, cuts between steps, contents, summaries, index fields, passages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.text import strip
from legajo.operators.chunking import blocks, clean_html, is_login_page

MAX_SECTION = 1800
# Lines that begin like an instruction are no headings, lines that pages leave behind are passed over.
IMPERATIVES = ("haga ", "haga clic", "ingrese ", "registre ", "seleccione ", "elija ", "ubique ", "use ", "abra ", "pulse ", "presione ", "marque ", "primero ", "segundo ", "luego ", "despues ", "después ", "se debe ", "para ", "si ", "sí ", "no ")
PASSED = {"table of contents", "toggle"}
_DOTTED = re.compile(r"\s*(\d+(?:\.\d+)+)\.?\s+(.+?)\s*")
_MAIN = re.compile(r"\s*(\d+)\.?\s+(.+?)\s*")


def heading(line: str) -> tuple[str, int] | None:
    """(title, level) of a numbered heading: 1.2 is of level 2; sentences and instructions are none."""
    if m := _DOTTED.fullmatch(line):
        number, title = m.groups()
        return (f"{number} {title}", number.count(".") + 1) if len(title) <= 140 and title[-1] not in ".;?!" else None
    if not (m := _MAIN.fullmatch(line)):
        return None
    number, title = m.groups()
    if len(title) > 120 or title[-1] in ".;?!":
        return None
    shown = title.isupper() or (title[0].isupper() and not title.lower().startswith(IMPERATIVES))
    return (f"{number} {title}", 1) if shown else None


def numbered_sections(text: str | None) -> list[tuple[str, list[str]]]:
    """(path of titles, lines) of each section with lines; what stands before the first heading is left out."""
    out: list[tuple[str, list[str]]] = []
    path: list[tuple[int, str]] = []
    for raw in (text or "").splitlines():
        line = " ".join(raw.split())
        if not line or line.lower() in PASSED:
            continue
        if h := heading(line):
            path = [*(p for p in path if p[0] < h[1]), (h[1], h[0])]
            out.append((" › ".join(t for _, t in path), []))
        elif out and (not out[-1][1] or out[-1][1][-1] != line):
            out[-1][1].append(line)
    return [s for s in out if s[1]]


def split_section(title: str, steps: list[str], most: int = MAX_SECTION) -> list[tuple[str, list[str]]]:
    """A section cut between steps into parts of up to `most` characters; the parts of a cut section are numbered in their titles."""
    parts: list[list[str]] = [[]]
    size = 0
    for s in steps:
        if parts[-1] and size + len(s) > most:
            parts.append([])
            size = 0
        parts[-1].append(s)
        size += len(s) + 1
    return [(title, steps)] if len(parts) == 1 else [(f"{title} ({i})", p) for i, p in enumerate(parts, 1)]


def text_sections(texts: DataFrame, key: str, text: str, most: int = MAX_SECTION) -> DataFrame:
    """(key, n, titulo, pasos) of texts with numbered headings. The path of titles is a stack, so texts are read in Arrow batches."""
    kind = f"{key} {texts.schema[key].dataType.simpleString()}, n int, titulo string, pasos array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *p) for k, t in zip(b[key], b[text], strict=True) for i, p in enumerate((p for s in numbered_sections(t) for p in split_section(*s, most)), 1)]
            yield pd.DataFrame(rows, columns=[key, "n", "titulo", "pasos"])

    return texts.select(key, text).mapInPandas(run, kind)


def section_text(title: Column, steps: Column) -> Column:
    """A section as text: the title as a heading, each step a line."""
    return F.concat(F.lit("## "), title, F.lit("\n"), F.array_join(steps, "\n"))


def prepared(path: Column, content: Column) -> Column:
    """Blocks to be chunked: pages of HTML are cleaned and cut into blocks, pages that ask to log in give none, other texts are one block."""
    html = F.lower(path).rlike(r"\.html?$")
    clean = clean_html(content)
    return F.when(html, F.when(is_login_page(clean), F.array().cast("array<string>")).otherwise(blocks(clean))).otherwise(F.when(strip(content) == "", F.array().cast("array<string>")).otherwise(F.array(content)))


def contents(texts: DataFrame, key: str, text: str, most: int = 25) -> DataFrame:
    """(key, n, titulo): numbered headings of a text, dot leaders and page numbers off, each once, at most `most`."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r\n|[\n\r\f]")).alias("p", "l"))
    found = lines.select(key, "p", F.regexp_extract("l", r"^\s*((\d+(\.\d+){0,2})[.)]?\s+[A-ZÁÉÍÓÚÑ][^\n]{3,70})\s*$", 1).alias("t")).where("t <> ''")
    named = found.select(key, "p", strip(F.regexp_replace("t", r"[ .]{3,}\s*\d+$", "")).alias("titulo")).where(F.length("titulo") >= 6)
    first = named.groupBy(key, F.lower("titulo").alias("_k")).agg(F.min(F.struct("p", "titulo")).alias("x"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("x.p"))
    return first.select(key, n.alias("n"), F.col("x.titulo").alias("titulo")).where(F.col("n") <= most)


def summary(text: Column, title: Column, most: int = 280) -> Column:
    """Lines of more than 40 characters without headings, sources and the title, cut at a blank before `most`; the title's own line where nothing is left."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\f]"), lambda x: (F.length(strip(x)) > 40) & ~x.startswith("#") & ~x.startswith("Fuente:") & ~x.contains(title))
    s = F.array_join(F.transform(lines, strip), " ")
    cut = F.substring(s, 1, most)
    kept = F.when(cut.contains(" "), F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(s) > most, F.concat(kept, F.lit("…"))).when(s == "", F.concat(F.lit("Manual oficial: "), title, F.lit("."))).otherwise(s)


def index_fields(fragments: DataFrame) -> DataFrame:
    """(id, titulo, seccion, texto, ocr, manual) as the index weighs them.

    The tail of a title after › is the section, the text of a picture is recognised text, and the title of a file that has no
    manual of its own stands for it.
    """
    path = F.transform(F.split("titulo", "›"), strip)
    picture = F.coalesce(F.col("tipo") == "imagen", F.lit(False))
    section = F.coalesce(F.nullif(strip(F.col("seccion")), F.lit("")), F.when(F.size(path) > 1, F.element_at(path, -1)))
    return fragments.select(
        "fila", F.element_at(path, 1).alias("titulo"), section.alias("seccion"), F.when(~picture, F.col("texto")).alias("texto"), F.when(picture, F.col("texto")).alias("ocr"), F.coalesce(F.nullif(strip(F.col("manual")), F.lit("")), F.element_at(path, 1)).alias("manual")
    )


def squeezed(c: Column, most: int) -> Column:
    """White space squeezed and the text cut at `most` characters, with a sign where something is missing."""
    s = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def citation_key(citation: Column, title: Column, page: Column, ident: Column) -> Column:
    """What makes two citations the same: lower case, single blanks; title and page where there is none, else the id."""
    norm = lambda c: F.nullif(F.lower(strip(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
    return F.coalesce(norm(citation), norm(F.concat(F.nullif(strip(title), F.lit("")), F.lit(":"), F.coalesce(page, F.lit("")))), ident)


def first_json(text: str | None) -> str | None:
    """The first balanced JSON object in a text, None if no braces balance to one."""
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            return text[at:end]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def json_in(c: Column) -> Column:
    """first_json() of a column, in batches; balancing braces outside of strings needs a scanner."""

    @F.pandas_udf("string")
    def f(texts: pd.Series) -> pd.Series:
        return pd.Series([first_json(t) for t in texts], dtype=object)

    return f(c)


def window_passages(scored: DataFrame, key: str, most: int = 1200) -> DataFrame:
    """(key, desde, hasta, texto): the contiguous blocks around the best one that fit into `most` characters, the better neighbour first.

    scored: (key, n, texto, nota) with the blocks of a text in order. Grown greedily, so the blocks of one text are one group.
    """
    kind = f"{key} {scored.schema[key].dataType.simpleString()}, desde int, hasta int, texto string"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        texts, notes, ns = pdf["texto"].tolist(), pdf["nota"].tolist(), pdf["n"].tolist()
        a = b = max(range(len(texts)), key=lambda i: (notes[i], -i))
        size = len(texts[a])
        while True:
            sides = [i for i in (a - 1, b + 1) if 0 <= i < len(texts) and size + 1 + len(texts[i]) <= most]
            if not sides:
                break
            i = max(sides, key=lambda j: (notes[j], -j))
            size += 1 + len(texts[i])
            a, b = min(a, i), max(b, i)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "desde": [ns[a]], "hasta": [ns[b]], "texto": ["\n".join(texts[a : b + 1])]})

    return scored.groupBy(key).applyInPandas(grow, kind)


def carried(before: DataFrame, now: DataFrame, source: str, present: DataFrame) -> DataFrame:
    """The rows of now, and those of before whose source file is missing at present, so a file that cannot be read loses nothing."""
    lost = before.join(present.select(source).distinct(), source, "left_anti")
    return now.unionByName(lost, allowMissingColumns=True)
