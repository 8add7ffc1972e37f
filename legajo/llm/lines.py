"""P4. Lines repeated over the texts of one source.

Method: suffix arrays over each source's line identifiers. A line's identifier is the hash of its letters; lines too short to
count have one too, since they may stand inside a block. A first pass counts identifiers by source; lines too rare to belong
to any wanted block are dropped (a block cannot be more frequent than its rarest line), the rest of each text forms runs of
neighbouring lines. All suffixes of the runs, equal ones counted once with their number of texts, are sorted within
(source, first identifier), the first bucket of a suffix array, so a source that holds a third of the rows is spread over many
tasks. Common prefixes of neighbours in that order are the repeated blocks; they start and end with lines that count.

The lines of p4_found are those of the blocks that span enough rows. Texts are cleaned by whole blocks: short and blank
lines inside a block go with it.

Defined cases: null or empty texts and rows without a source have no lines (they still count as rows of a source if it is
not null). Lines with fewer than `min_letters` letters are never listed and make no block of their own. A line that occurs
twice in a row is listed twice and counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.text import letters_py
from legajo.session import small, spread, written

MIN_LETTERS, MIN_ROWS, MIN_SHARE = 15, 8, 0.1
#: Identifiers of a suffix that are compared first; as long as a wanted block fills them, twice as many are compared.
DEPTH = 16
#: Rows of (source, identifier) up to which the frequent lines are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def _keyed(min_letters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for b in batches:
            ks = []
            for t in b["texto"]:
                k = []
                for x, raw in zip(letters_py(t).split("\n"), t.split("\n"), strict=True):
                    # identifiers of lines that count are odd, others even
                    k.append(((xxh64_intdigest(x) | 1) if len(x) >= min_letters else (xxh64_intdigest(raw.strip(" \t\r").lower()) & ~1)) - (1 << 63))
                ks.append(k)
            yield pd.DataFrame({"fila": b["fila"], "m": b["m"], "k": ks})

    return run


def _counts(k: Column) -> Column:
    return k.bitwiseAND(F.lit(1)) == 1


def keyed_lines(fragments: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(fila, m, k): for each row the identifiers of its lines in order; m is the hashed source."""
    rows = fragments.where(F.col("manual").isNotNull() & (F.length("texto") > 0)).select("fila", F.xxhash64("manual").alias("m"), "texto")
    return spread(rows).mapInPandas(_keyed(min_letters), "fila bigint, m bigint, k array<bigint>")


def source_sizes(fragments: DataFrame) -> DataFrame:
    return fragments.where(F.col("manual").isNotNull()).groupBy(F.xxhash64("manual").alias("m")).agg(F.count(F.lit(1)).alias("_total"))


def frequent_lines(keyed: DataFrame, sizes: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(m, k): identifiers that are frequent enough to belong to a wanted block."""
    counts = keyed.select("m", F.explode(F.array_distinct(F.filter("k", _counts))).alias("k")).groupBy("m", "k").agg(F.count(F.lit(1)).alias("filas")).where(F.col("filas") >= min_rows)
    return counts.join(sizes, "m").where(F.col("filas") >= min_share * F.col("_total")).select("m", "k")


def line_runs(keyed: DataFrame, frequent: DataFrame) -> DataFrame:
    """(fila, m, s): the frequent and the short lines of each row that has a frequent one, as (number, identifier) in order."""
    lines = keyed.select("fila", "m", F.posexplode("k").alias("p", "k"))
    keys = frequent.withColumn("f", F.lit(True))
    lines = lines.join(F.broadcast(keys) if small(keys, BROADCAST_ROWS) else keys, ["m", "k"], "left").where(F.col("f") | ~_counts(F.col("k")))
    return lines.groupBy("fila", "m").agg(F.array_sort(F.collect_list(F.struct((F.col("p") + 1).alias("n"), "k"))).alias("s"), F.max("f").alias("f")).where("f").select("fila", "m", "s")


def _stretches(s) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring lines that start and end with a line that counts: lists of (number, identifier)."""
    runs: list[list[tuple[int, int]]] = []
    last = None
    for x in s:
        n, k = x["n"], x["k"]
        if last is None or n != last + 1:
            runs.append([])
        if runs[-1] or k & 1:
            runs[-1].append((n, k))
        last = n
    for r in runs:
        while r and not r[-1][1] & 1:
            r.pop()
    return [r for r in runs if r]


def _suffixes(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, marks = [], []
            for s in b["s"]:
                of_row: dict[tuple[int, ...], list[int]] = {}
                for r in _stretches(s):
                    ids = [k for _, k in r]
                    for i, first in enumerate(ids):
                        if first & 1 and (t := tuple(ids[i : i + depth])) not in of_row:
                            h, of_row[t] = 0, []
                            for k in t:
                                h = (h * 0x9E3779B97F4A7C15 + k + 1) & 0xFFFFFFFFFFFFFFFF
                                of_row[t].append(h - (1 << 63))
                out.append([{"suf": list(t), "h": h} for t, h in of_row.items()])
                marks.append(list({x for t, h in of_row.items() for k, x in zip(t, h, strict=True) if k & 1}))
            yield pd.DataFrame({"m": b["m"], "sufs": out, "marks": marks})

    return run


def blocks(runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(m, bloque, filas, ancho): blocks of neighbouring lines found in the suffix array, the rows that hold them, and the prefix they end.

    They are the common prefixes of neighbouring suffixes, up to their last line that counts. Prefixes travel as a hash
    of their identifiers, as whole arrays they would take the third power of a run's length.
    """
    per_row = written(runs.select("m", "s").mapInPandas(_suffixes(depth), "m bigint, sufs array<struct<suf: array<bigint>, h: array<bigint>>>, marks array<bigint>"), "sufijos")
    array = per_row.select("m", F.explode("sufs").alias("x")).select("m", "x.suf", "x.h").groupBy("m", "suf").agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("veces"))
    w = Window.partitionBy("m", F.col("suf")[0]).orderBy("suf")
    array = array.withColumn("_prev", F.lag("h").over(w))
    # Equal hashes of prefixes come first, so the common prefix is as long as there are equal places.
    array = array.withColumn("_lcp", F.coalesce(F.size(F.filter(F.arrays_zip(F.col("h").alias("a"), F.col("_prev").alias("b")), lambda x: x.a == x.b)), F.lit(0)))
    lengths = F.array_distinct(F.array(F.when(F.col("veces") > 1, F.size("suf")).otherwise(0), F.col("_lcp")))
    prefixes = array.select("m", "suf", "h", F.explode(lengths).alias("n")).where("n > 0").select("m", "h", "n", F.slice("suf", F.lit(1), F.col("n")).alias("bloque"))
    back = F.array_position(F.transform(F.reverse("bloque"), lambda k: k.bitwiseAND(F.lit(1))), 1).cast("int")  # short lines at the end of a prefix are no part of it
    prefixes = prefixes.select("m", "h", "n", F.slice("bloque", F.lit(1), F.size("bloque") - back + 1).alias("bloque"))
    found = prefixes.groupBy("m", "bloque", F.element_at("h", F.size("bloque")).alias("marca")).agg(F.max("n").alias("ancho"))
    # A row holds a block if one of its suffixes starts with it; each row's prefixes are made distinct before counting.
    return per_row.select("m", F.explode("marks").alias("marca")).groupBy("m", "marca").agg(F.count(F.lit(1)).alias("filas")).join(found, ["m", "marca"]).select("m", "bloque", "filas", "ancho")


def repeated_blocks(fragments: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, min_letters: int = MIN_LETTERS) -> tuple[DataFrame, DataFrame]:
    """(blocks, runs): blocks spanning enough rows of their source, and the lines of each row that may belong to one."""
    keyed = written(keyed_lines(fragments, min_letters), "claves")
    sizes = written(source_sizes(fragments), "fuentes")
    runs = written(line_runs(keyed, written(frequent_lines(keyed, sizes, min_rows, min_share), "lineas")), "tramos")
    depth = DEPTH
    while True:
        found = blocks(runs, depth).join(sizes, "m").where((F.col("filas") >= min_rows) & (F.col("filas") >= min_share * F.col("_total"))).drop("_total")
        found = written(found, "bloques")
        if found.where(F.col("ancho") >= depth).isEmpty():
            return found.drop("ancho"), runs
        depth *= 2


def block_lines(found: DataFrame, runs: DataFrame) -> DataFrame:
    """(fila, linea) of the lines that count and belong to a found block."""
    lines = runs.select("fila", "m", F.explode(F.filter("s", lambda x: _counts(x.k))).alias("x")).select("fila", "m", F.col("x.n").cast("bigint").alias("linea"), F.col("x.k").alias("k"))
    keys = found.select("m", F.explode("bloque").alias("k")).where(_counts(F.col("k"))).distinct()
    return lines.join(F.broadcast(keys) if small(keys, BROADCAST_ROWS) else keys, ["m", "k"], "left_semi").select("fila", "linea")


def _gaps(run: list[tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """Stretches of short lines between two that count: (hash of both lines and what lies between, numbers of the short lines)."""
    out, at = [], 0
    for i in range(1, len(run)):
        if run[i][1] & 1:
            if i > at + 1:
                h = 0
                for _, k in run[at : i + 1]:
                    h = (h * 0x9E3779B97F4A7C15 + k + 1) & 0xFFFFFFFFFFFFFFFF
                out.append((h - (1 << 63), [n for n, _ in run[at + 1 : i]]))
            at = i
    return out


def _row_gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, m, h, n) for f, m, s in zip(b["fila"], b["m"], b["s"], strict=True) for r in _stretches(s) for h, n in _gaps(r)]
        yield pd.DataFrame(rows, columns=["fila", "m", "g", "ns"])


def _block_gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = {(m, h) for m, block in zip(b["m"], b["bloque"], strict=True) for h, _ in _gaps(list(enumerate(map(int, block))))}
        yield pd.DataFrame(list(rows), columns=["m", "g"])


def inner_lines(found: DataFrame, runs: DataFrame) -> DataFrame:
    """(fila, linea) of the short lines inside occurrences of found blocks."""
    gaps = found.where(F.exists("bloque", lambda k: ~_counts(k))).mapInPandas(_block_gaps, "m bigint, g bigint").distinct()
    rows = runs.mapInPandas(_row_gaps, "fila bigint, m bigint, g bigint, ns array<bigint>")
    return rows.join(F.broadcast(gaps) if small(gaps, BROADCAST_ROWS) else gaps, ["m", "g"], "left_semi").select("fila", F.explode("ns").alias("linea"))


def repeated_lines(fragments: DataFrame, **limits) -> DataFrame:
    """(fila, linea) of every line that belongs to a block spanning enough rows of its source."""
    return block_lines(*repeated_blocks(fragments, **limits))


def cleaned(fragments: DataFrame, **limits) -> DataFrame:
    """(fila, texto): the texts without the blocks that span enough rows of their source."""
    found, runs = repeated_blocks(fragments, **limits)
    return without_lines(fragments, block_lines(found, runs).union(inner_lines(found, runs)))


def without_lines(fragments: DataFrame, found: DataFrame) -> DataFrame:
    """(fila, texto): the texts without the lines of `found`; texts without such lines come out unchanged, null as null."""
    gone = found.groupBy("fila").agg(F.collect_set("linea").alias("_l"))
    kept = F.array_join(F.filter(F.split("texto", "\n", -1), lambda x, i: ~F.array_contains(F.col("_l"), (i + 1).cast("bigint"))), "\n")
    return fragments.select("fila", "texto").join(gone, "fila", "left").select("fila", F.when(F.col("_l").isNull(), F.col("texto")).otherwise(kept).alias("texto"))
