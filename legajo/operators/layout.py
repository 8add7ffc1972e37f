"""Boxes on pages and screens: merged boxes, lines and grids of recognised words, word runs with their box, groups of screens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length of two stretches over the shorter one; 0 where they don't meet or one has no length."""
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / short).otherwise(0.0)


def lines(words: DataFrame, gap: float = 0.6) -> DataFrame:
    """(pagina, linea, x0, y0, x1, y1, texto): words (pagina, x0, y0, x1, y1, texto) whose middles lie closer than `gap` of the height.

    Words are taken from top to bottom; a new line begins where the middle jumps. Each page is a window of its own.
    """
    mid, high = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    w = Window.partitionBy("pagina").orderBy("_m", "x0")
    rows = words.withColumn("_m", mid).withColumn("_j", F.coalesce((F.col("_m") - F.lag("_m").over(w) > gap * F.least(high, F.lag(high).over(w))).cast("int"), F.lit(1)))
    rows = rows.withColumn("linea", F.sum("_j").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "texto"))), lambda x: x.texto), " ")
    return rows.groupBy("pagina", "linea").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("texto"))


def columns(boxes: DataFrame, share: float = 0.55) -> DataFrame:
    """(pagina, columna, x0, y0, x1, y1, cajas): boxes joined into one where each overlaps the stretch of the ones before by `share`.

    Taken from left to right; the stretch grows with its boxes. The fold needs the boxes of a page in order.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[float]] = []
        for r in pdf.sort_values(["x0", "y0", "x1", "y1"]).itertuples():
            if out:
                c = out[-1]
                short = min(r.x1 - r.x0, c[2] - c[0])
                if short > 0 and (min(r.x1, c[2]) - max(r.x0, c[0])) / short >= share:
                    out[-1] = [min(c[0], r.x0), min(c[1], r.y0), max(c[2], r.x1), max(c[3], r.y1), c[4] + 1]
                    continue
            out.append([r.x0, r.y0, r.x1, r.y1, 1])
        page = pdf["pagina"].iloc[0]
        return pd.DataFrame([(page, i, *c) for i, c in enumerate(out, 1)], columns=["pagina", "columna", "x0", "y0", "x1", "y1", "cajas"])

    kind = f"pagina {boxes.schema['pagina'].dataType.simpleString()}, columna int, x0 double, y0 double, x1 double, y1 double, cajas bigint"
    return boxes.groupBy("pagina").applyInPandas(fold, kind)


def grids(columned: DataFrame, least: int = 2) -> DataFrame:
    """(pagina, columnas, filas, rejilla): whether a page holds a grid, that is at least so many columns of at least so many boxes."""
    full = F.col("cajas") >= least
    g = columned.groupBy("pagina").agg(F.count_if(full).alias("columnas"), F.max(F.when(full, F.col("cajas")).otherwise(0)).alias("filas"))
    return g.withColumn("rejilla", F.col("columnas") >= least)


def word_runs(words: DataFrame, most: int = 6) -> DataFrame:
    """(pagina, linea, desde, n, texto, x0, x1): runs of up to `most` neighbouring words of a line with their box.

    words: (pagina, linea, n, x0, x1, texto) with n from 1 in each line.
    """
    arr = words.groupBy("pagina", "linea").agg(F.array_sort(F.collect_list(F.struct("n", "x0", "x1", "texto"))).alias("w"))
    at = arr.select("*", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("desde")).select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("desde") + 1))).alias("k"))
    run = F.slice("w", F.col("desde"), F.col("k"))
    return at.select("pagina", "linea", "desde", F.col("k").alias("n"), F.array_join(F.transform(run, lambda x: x.texto), " ").alias("texto"), F.array_min(F.transform(run, lambda x: x.x0)).alias("x0"), F.array_max(F.transform(run, lambda x: x.x1)).alias("x1"))


def screen_groups(screens: DataFrame, bits: int = 8, share: float = 0.5) -> DataFrame:
    """(video, pantalla, grupo): screens (video, pantalla, huella, palabras) in order; a screen joins the first group whose first screen is like it.

    Like are picture hashes of up to `bits` differing bits, or word sets with at least `share` in common. Greedy, so the screens of
    one video are one group.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[int, int, set]] = []
        out = []
        for r in pdf.sort_values("pantalla").itertuples():
            words = set(r.palabras) if r.palabras is not None else set()
            for g, h, w in heads:
                if (int(h) ^ int(r.huella)).bit_count() <= bits or (words and w and len(words & w) / len(words | w) >= share):
                    out.append((r.video, r.pantalla, g))
                    break
            else:
                heads.append((r.pantalla, r.huella, words))
                out.append((r.video, r.pantalla, r.pantalla))
        return pd.DataFrame(out, columns=["video", "pantalla", "grupo"])

    kind = f"video {screens.schema['video'].dataType.simpleString()}, pantalla bigint, grupo bigint"
    return screens.groupBy("video").applyInPandas(fold, kind)


def field_kind(c: Column) -> Column:
    """Kind of a recognised field by its form: fecha, monto, numero, codigo or texto; blank ones null."""
    t = F.trim(c)
    return F.when(t == "", None).when(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"), "fecha").when(t.rlike(r"^(?:S/|\$|€)?\s*-?\d{1,3}(?:,\d{3})*\.\d{2}$"), "monto").when(t.rlike(r"^-?\d+$"), "numero").when(t.rlike(r"^[A-Z]{1,4}-?\d+[\w.-]*$|^\d+(?:\.\d+)+$"), "codigo").otherwise("texto")


def fused_labels(read: DataFrame, seen: DataFrame, ratio: float = 0.7, within: float = 0.02) -> DataFrame:
    """(pagina, etiqueta, leido, parecido): for each label seen on a page the run of read words that is most like it.

    read: (pagina, texto, n), seen: (pagina, etiqueta). Of runs within `within` of the best the longest wins; below `ratio` none does.
    """
    from legajo.operators.spelling import similarity

    both = seen.select("pagina", "etiqueta").distinct().join(read, "pagina").withColumn("parecido", F.round(similarity(F.col("etiqueta"), F.col("texto")), 6)).where(F.col("parecido") >= ratio)
    best = both.groupBy("pagina", "etiqueta").agg(F.max("parecido").alias("_b"))
    near = both.join(best, ["pagina", "etiqueta"]).where(F.col("parecido") >= F.col("_b") - within)
    return near.groupBy("pagina", "etiqueta").agg(F.max(F.struct("n", "parecido", "texto")).alias("x")).select("pagina", "etiqueta", F.col("x.texto").alias("leido"), "x.parecido")
