"""Evidence, citations, steps, sections and question-bank rows, as constraint queries and projections."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.analysis import phonetic, plain, roots, tokens


def supported(text: Column, source: Column, share: float = 0.6) -> Column:
    """Whether text shares at least min(2, n) of its n roots and 60 % of them with source; no roots, no support."""
    a = F.array_distinct(roots(text))
    n = F.size(a)
    both = F.size(F.array_intersect(a, roots(source)))
    return (n > 0) & (both >= F.least(n, F.lit(2))) & (both >= share * n)


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the tokens of phrase stand side by side in text."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return (F.size(tokens(phrase)) > 0) & line(text).contains(line(phrase))


def bold_terms(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\*\*([^*\n]+)\*\*"), 1), lambda x: F.trim(x))


def exact_forms(c: Column) -> Column:
    """Shortcuts, function keys, acronyms, codes and quoted words of a text, each once, lower case, sorted."""
    parts = [r"(?i)\b(?:ctrl|alt|shift)\+[a-z0-9áéíóú]+(?:\+[a-z0-9]+)*", r"\bF(?:1[0-2]|[1-9])\b", r"\b[A-Z]{2,}-\d+\b", r"\b\d+(?:\.\d+)+\b", r"«([^»]+)»"]
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), 1 if "(" in p and p[0] == "«" else 0) for p in parts])
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def quoted(body: Column, quote: Column, least: int = 12) -> Column:
    """Whether a quotation of at least `least` characters stands in the body, accents and blanks apart."""
    norm = lambda c: F.trim(F.regexp_replace(plain(c), r"\s+", " "))
    return (F.length(norm(quote)) >= least) & norm(body).contains(norm(quote))


def resolve_citations(cites: DataFrame, base: DataFrame, most: int = 3) -> DataFrame:
    """cites (cita, id, manual) with `estado`: ok, ambigua (the pair names more than `most` rows), otro-manual or falta."""
    pairs = base.groupBy("id", "manual").agg(F.count(F.lit(1)).alias("_n"))
    ids = base.groupBy("id").agg(F.count(F.lit(1)).alias("_m"))
    state = F.when(F.col("_n") > most, "ambigua").when(F.col("_n").isNotNull(), "ok").when(F.col("_m").isNotNull(), "otro-manual").otherwise("falta")
    return cites.join(pairs, ["id", "manual"], "left").join(ids, "id", "left").select("cita", state.alias("estado"))


def same_sound(vocabulary: DataFrame, least: int = 3) -> DataFrame:
    """(word, correcta): words whose sound a more frequent word (df >= least) shares. vocabulary: (word, df)."""
    v = vocabulary.withColumn("s", phonetic(F.col("word")))
    best = v.where(F.col("df") >= least).groupBy("s").agg(F.max_by("word", F.struct("df", "word")).alias("correcta"), F.max("df").alias("_b"))
    return v.join(best, "s").where((F.col("word") != F.col("correcta")) & (F.col("df") < F.col("_b"))).select("word", "correcta")


def sections(texts: DataFrame, key: str, text: str, title: str = r"^## ") -> DataFrame:
    """(key, seccion, titulo, pasos): lines after each title line, running numbers; consecutive repeats of a line count once."""
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("p", "l")).where(F.trim("l") != "")
    w = Window.partitionBy(key).orderBy("p")
    marked = lines.withColumn("t", F.col("l").rlike(title)).withColumn("seccion", F.sum(F.col("t").cast("int")).over(w)).withColumn("_prev", F.lag("l").over(w))
    kept = marked.where(F.col("t") | F.col("_prev").isNull() | (F.col("l") != F.col("_prev")))
    return kept.groupBy(key, "seccion").agg(F.max(F.when(F.col("t"), F.regexp_replace("l", title, ""))).alias("titulo"), F.count_if(~F.col("t")).alias("pasos"))


def numbered_steps(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, paso): the numbered lines of an answer."""
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("l")).where(F.col("l").rlike(r"^\s*\d+[.)]\s+\S"))
    return lines.select(key, F.regexp_extract("l", r"^\s*(\d+)", 1).cast("int").alias("n"), F.trim(F.regexp_replace("l", r"^\s*\d+[.)]\s+", "")).alias("paso"))


def misnumbered(steps: DataFrame, key: str) -> DataFrame:
    """Keys whose step numbers are not 1, 2, 3 …"""
    g = steps.groupBy(key).agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count(F.lit(1)).alias("c"), F.countDistinct("n").alias("d"))
    return g.where((F.col("a") != 1) | (F.col("b") != F.col("c")) | (F.col("d") != F.col("c"))).select(key)


def nodes(rows: DataFrame, key: str, title: str, text: str, least: int = 40) -> DataFrame:
    """(key, modulo, seccion): path of a title split at ›, for texts of at least `least` characters."""
    p = F.transform(F.split(title, "›"), lambda x: F.trim(x))
    return rows.where(F.length(text) >= least).select(key, F.element_at(p, 1).alias("modulo"), F.when(F.size(p) > 1, F.element_at(p, -1)).alias("seccion"))


def place_photos(lines: DataFrame, steps: DataFrame, shared: int = 2, share: float = 0.5) -> DataFrame:
    """(key, paso, linea): the best line of each step of the same answer; a step without one is left out. Both have (key, n, texto)."""
    a = lines.select("key", F.col("n").alias("linea"), F.array_distinct(roots(F.col("texto"))).alias("a"))
    b = steps.select("key", F.col("n").alias("paso"), F.array_distinct(roots(F.col("texto"))).alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    m = a.join(b, "key").withColumn("_s", both).where((F.col("_s") >= shared) & (F.col("_s") >= share * F.least(F.size("a"), F.size("b"))))
    return m.groupBy("key", "paso").agg(F.max_by("linea", F.struct(F.col("_s"), -F.col("linea"))).alias("linea"))


def pooled(lists: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """(qid, doc_id, metodos): union of the first k of several rankings with the methods that gave each row."""
    out = None
    for name, df in lists.items():
        part = df.where(F.col("rank") <= k).select("qid", "doc_id", F.struct(F.lit(name).alias("m"), F.col("rank").alias("r")).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("qid", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(":", x["m"], x["r"].cast("string"))), ",").alias("metodos"))


class _Events(HTMLParser):
    """Titles, texts and photos of a page in reading order; navigation, scripts and forms are passed over."""

    SKIP = {"nav", "script", "style", "form", "footer", "header", "aside", "noscript", "svg"}
    BLOCK = {"p", "div", "li", "br", "tr", "section", "article", "ul", "ol", "table"}

    def __init__(self):
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.skip, self.title, self.buf = 0, False, ""

    def flush(self, kind="texto"):
        s = " ".join(self.buf.split())
        if s:
            self.out.append((kind, s))
        self.buf = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif not self.skip:
            if tag in ("h1", "h2", "h3", "h4"):
                self.flush()
                self.title = True
            elif tag == "img" and (src := dict(attrs).get("src")):
                self.flush()
                self.out.append(("foto", src))
            elif tag in self.BLOCK:
                self.flush()

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif not self.skip:
            if tag in ("h1", "h2", "h3", "h4"):
                self.flush("titulo")
                self.title = False
            elif tag in self.BLOCK:
                self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.buf += data


def html_steps(html: str | None) -> list[dict]:
    """Sections of a page: {titulo, pasos: [{texto, fotos}]}; a photo goes with the step before it, or waits for the first one."""
    p = _Events()
    p.feed(html or "")
    p.flush()
    out: list[dict] = []
    waiting: list[str] = []
    for kind, s in p.out:
        if kind == "titulo":
            out.append({"titulo": s, "pasos": []})
            continue
        if not out:
            out.append({"titulo": "", "pasos": []})
        steps = out[-1]["pasos"]
        if kind == "foto":
            (steps[-1]["fotos"] if steps else waiting).append(s)
        elif not steps or steps[-1]["texto"] != s:
            steps.append({"texto": s, "fotos": waiting})
            waiting = []
    return [x for x in out if x["pasos"]]


def html_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, titulo, pasos) of every page; parsing needs a stack, so it runs in Arrow batches."""
    kind = f"{key} {pages.schema[key].dataType.simpleString()}, n int, titulo string, pasos array<struct<texto:string,fotos:array<string>>>"

    def run(batches):
        for b in batches:
            rows = [(k, i, s["titulo"], s["pasos"]) for k, h in zip(b[key], b[html], strict=True) for i, s in enumerate(html_steps(h), 1)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "n", "titulo", "pasos"])

    return pages.select(key, html).mapInPandas(run, kind)


def transcript_chunks(segments: DataFrame, key: str, size: int = 1500) -> DataFrame:
    """(key, n, desde, hasta, texto): consecutive segments (ini, fin, texto) up to `size` characters, with their times."""
    arr = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ini", "fin", "texto"))).alias("s"))
    zero = F.expr("named_struct('ini', cast(null as double), 'fin', cast(null as double), 'texto', '', 'out', cast(array() as array<struct<ini:double,fin:double,texto:string>>))")

    def step(a, x):
        full = (a["texto"] != "") & (F.length(a["texto"]) + 1 + F.length(x["texto"]) > size)
        out = F.when(full, F.concat(a["out"], F.array(F.struct(a["ini"].alias("ini"), a["fin"].alias("fin"), a["texto"].alias("texto"))))).otherwise(a["out"])
        fresh = full | (a["texto"] == "")
        return F.struct(F.when(fresh, x["ini"]).otherwise(a["ini"]).alias("ini"), x["fin"].alias("fin"), F.when(fresh, x["texto"]).otherwise(F.concat_ws(" ", a["texto"], x["texto"])).alias("texto"), out.alias("out"))

    done = F.aggregate("s", zero, step, lambda a: F.concat(a["out"], F.array(F.struct(a["ini"].alias("ini"), a["fin"].alias("fin"), a["texto"].alias("texto")))))
    mark = lambda c: F.format_string("%d:%02d", F.floor(c / 60).cast("bigint"), F.floor(c % 60).cast("bigint"))
    return arr.select(key, F.posexplode(done).alias("n", "x")).select(key, "n", mark(F.col("x.ini")).alias("desde"), mark(F.col("x.fin")).alias("hasta"), "x.texto")
