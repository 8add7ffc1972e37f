"""Chunkers and cleaners that build fragments, as native expressions; folds run over one row's array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions.text import strip

# Entities that the cleaner decodes.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&ntilde;": "ñ", "&euro;": "€", "&copy;": "©"}
# How a line begins that counts as a heading.
_HEADING = r"(?i)^(?:cap[íi]tulo|secci[óo]n|paso|tema|gu[íi]a|p[aá]gina|manual|subsecci[óo]n)\b|^\d+(?:[.)]|\s+(?-i:[A-ZÁÉÍÓÚÑ]))"


def sliding(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 150) -> DataFrame:
    """(key, n, trozo): windows of `size` characters, each sharing `overlap` with the one before; trimmed, blank ones dropped.

    An overlap outside [0, size) counts as 0. Null and blank texts give nothing.
    """
    overlap = overlap if 0 <= overlap < size else 0
    t = strip(F.col(text))
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("_t") - size) / F.lit(step))).cast("int")
    rows = df.select(key, t.alias("_t")).where(F.length("_t") > 0).select(key, "_t", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    return rows.select(key, "n", strip(F.substring(F.col("_t"), F.col("n") * step + 1, F.lit(size))).alias("trozo")).where(F.length("trozo") > 0)


def folded_chunks(pieces: Column, size: int, overlap: int, separator: str) -> Column:
    """Array of chunks built from an array of pieces: a chunk is closed when the next piece would pass `size`, the next begins with its tail."""
    sep = F.lit(separator)
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        full = (s["buf"] != "") & (F.length(s["buf"]) + F.length(p) + len(separator) > size)
        tail = F.substring(s["buf"], F.greatest(F.lit(1), F.length(s["buf"]) - overlap + 1), F.lit(overlap)) if overlap else F.lit("")
        nxt = F.when(s["buf"] == "", p).when(full, F.trim(F.concat(tail, sep, p))).otherwise(F.concat(s["buf"], sep, p))
        return F.struct(nxt.alias("buf"), F.when(full, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))))


def paragraphs(c: Column) -> Column:
    """Paragraphs of a text, runs of blanks as one, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda p: p != "")


def pages_of(c: Column) -> Column:
    """(pagina, parrafo) of the paragraphs of a text whose pages are parted by form feeds."""
    return F.flatten(F.transform(F.split(c, "\f"), lambda p, i: F.transform(paragraphs(p), lambda x: F.struct((i + 1).alias("pagina"), x.alias("parrafo")))))


def page_chunks(parts: Column, size: int = 1500, overlap: int = 200) -> Column:
    """(pagina, texto) chunks of (pagina, parrafo): closed when the next paragraph would pass `size`; the next begins with the tail.

    A chunk carries the page of its first paragraph; after a tail that is the page of the paragraph behind the tail.
    """
    zero = F.expr("named_struct('buf', '', 'pagina', 1, 'out', cast(array() as array<struct<pagina:int,texto:string>>))")

    def step(s: Column, p: Column) -> Column:
        full = (s["buf"] != "") & (F.length(s["buf"]) + F.length(p["parrafo"]) + 1 > size)
        tail = F.concat(F.substring(s["buf"], F.greatest(F.lit(1), F.length(s["buf"]) - overlap + 1), F.lit(overlap)), F.lit("\n"))
        out = F.when(full, F.concat(s["out"], F.array(F.struct(s["pagina"].alias("pagina"), strip(s["buf"]).alias("texto"))))).otherwise(s["out"])
        page = F.when(full | (s["buf"] == ""), p["pagina"]).otherwise(s["pagina"])
        return F.struct(F.concat(F.when(full, tail).otherwise(s["buf"]), p["parrafo"], F.lit("\n")).alias("buf"), page.alias("pagina"), out.alias("out"))

    return F.aggregate(parts, zero, step, lambda s: F.when(strip(s["buf"]) == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["pagina"].alias("pagina"), strip(s["buf"]).alias("texto"))))))


def line_chunks(c: Column, size: int = 1400, overlap: int = 150) -> Column:
    """Chunks of whole lines: a text within `size` is one chunk as it stands; else closed when the next line would pass it."""
    start = F.expr("named_struct('buf', '', 'out', cast(array() as array<string>))")

    def step(s: Column, x: Column) -> Column:
        full = (s["buf"] != "") & (F.length(s["buf"]) + F.length(x) + 1 > size)
        tail = F.concat(F.substring(s["buf"], F.greatest(F.lit(1), F.length(s["buf"]) - overlap + 1), F.lit(overlap)), F.lit("\n"))
        return F.struct(F.concat(F.when(full, tail).otherwise(s["buf"]), x, F.lit("\n")).alias("buf"), F.when(full, F.concat(s["out"], F.array(strip(s["buf"])))).otherwise(s["out"]).alias("out"))

    cut = F.aggregate(F.split(c, "\n"), start, step, lambda s: F.when(strip(s["buf"]) == "", s["out"]).otherwise(F.concat(s["out"], F.array(strip(s["buf"])))))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(cut)


def clean_html(c: Column) -> Column:
    """Visible text: comments and script-like blocks go, block tags become line ends, entities are decoded, blanks squeezed."""
    s = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?is)<(script|style|noscript|template|svg)\b[^>]*>.*?</(script|style|noscript|template|svg)\s*>", " ")
    s = F.regexp_replace(s, r"(?i)</?(p|div|section|article|header|footer|main|nav|li|ul|ol|h[1-6]|br|tr|table|form|label|details|summary|dt|dd)\b[^>]*>", "\n")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    for k, v in ENTITIES.items():
        s = F.replace(s, F.lit(k), F.lit(v))
    s = F.regexp_replace(s, r"[ \t\r\f\x0B]+", " ")
    s = F.array_join(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\n\s*\n+", "\n"), r"^\s+|\s+$", ""))


def is_heading(c: Column) -> Column:
    """Lines of up to 120 characters that begin like a heading, hold a colon with few blanks, or stand in capitals."""
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (F.length(c) > 0) & (F.length(c) <= 120) & (c.rlike(_HEADING) | (c.contains(":") & (blanks <= 8)) | ((F.upper(c) == c) & c.rlike("[A-ZÁÉÍÓÚÑ]")))


def blocks(c: Column) -> Column:
    """Array of blocks: split at blank lines and before heading-like lines."""
    lines = F.transform(F.split(c, "\n"), strip)
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        close = (s["buf"] != "") & ((x == "") | is_heading(x))
        out = F.when(close, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])
        buf = F.when(close | (s["buf"] == ""), x).otherwise(F.concat(s["buf"], F.lit("\n"), x))
        return F.struct(buf.alias("buf"), out.alias("out"))

    return F.aggregate(lines, start, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["buf"]))))


def is_login_page(c: Column) -> Column:
    """Pages that ask to log in, name no manual and have at most 80 words."""
    low = F.lower(c)
    asks = low.rlike("iniciar sesión|ingresar|login|simple membership")
    return asks & ~low.rlike("manual|capítulo|sección") & (F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")) <= 80)


def chunk_id(key: Column, n: Column) -> Column:
    return F.sha1(F.concat(key, F.lit(":"), n.cast("string")))


def citation(title: Column, since: Column, page: Column) -> Column:
    """Title with its time mark or page."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.concat(title, F.coalesce(F.concat(F.lit(", "), blank(since)), F.concat(F.lit(", p. "), blank(page)), F.lit("")))


def document_kind(path: Column) -> Column:
    """Kind of a document from its extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("html", "htm"), "html").when(ext == "pdf", "pdf").when(ext.isin("md", "txt"), "texto").when(ext.isin("jsonl", "json"), "datos").when(ext == "", "otro").otherwise(ext)


def slug(c: Column, length: int = 80) -> Column:
    """Lower case, anything but letters and digits as a hyphen, cut; 'sin-nombre' for nothing."""
    from legajo.functions.analysis import plain

    s = F.regexp_replace(F.regexp_replace(plain(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(s, 1, length), r"-+$", ""), F.lit("")), F.lit("sin-nombre"))


def normal_url(c: Column) -> Column:
    """https, lower-case host, a final slash unless the last segment has a dot; the query stays, the fragment goes."""
    u = F.trim(c)
    host = F.lower(F.regexp_extract(u, r"^(?i:https?)://([^/?#]+)", 1))
    path = F.regexp_extract(u, r"^(?i:https?)://[^/?#]+([^?#]*)", 1)
    q = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    end = F.when(path.rlike(r"\.[^/]*$") | path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.when(host != "", F.concat(F.lit("https://"), host, end, q))
