"""Statistics, histograms, pages and nesting of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, range and nearest-rank percentiles of each group; null values count as rows only."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(value), 6).alias("media"),
        F.min(value).alias("minimo"),
        F.max(value).alias("maximo"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
    )


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(i, tramo, n): buckets closed below, empty ones included; null values fall out."""
    e = [f"{x:g}" for x in edges]
    names = [f"<{e[0]}", *[f"{a}–{b}" for a, b in zip(e, e[1:], strict=False)], f"≥{e[-1]}"]
    at = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        at = F.when(F.col(value) < edges[i], F.lit(i)).otherwise(at)
    counts = df.where(F.col(value).isNotNull()).groupBy(at.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    buckets = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, tramo string")
    return buckets.join(F.broadcast(counts), "i", "left").select("i", "tramo", F.coalesce("n", F.lit(0)).alias("n"))


def page(df: DataFrame, when: str, tie: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; limit is held between 1 and 200, offset at 0 or more."""
    return df.orderBy(F.desc(when), F.desc(tie)).offset(max(0, offset)).limit(min(200, max(1, limit)))


def nested(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, filas): the rows of each key as an ordered array."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("filas"))


def matching(df: DataFrame, text: str | None = None, kind: str | None = None, model: str | None = None, failed: bool = False) -> DataFrame:
    """Traces (modelo, correcta, estado, preguntas array of structs with tipo) that hold a text anywhere in state and questions, a kind, a model, or that failed.

    A trace that nobody has judged has not failed. Arguments that are None or empty filter nothing.
    """
    if kind:
        df = df.where(F.exists("preguntas", lambda p: F.lower(p.tipo) == kind.lower()))
    if model:
        df = df.where(F.col("modelo") == model)
    if failed:
        df = df.where(F.coalesce(~F.col("correcta"), F.lit(False)))
    if text and text.strip():
        df = df.where(F.lower(F.concat_ws(" ", F.to_json(F.struct("estado")), F.to_json(F.struct("preguntas")))).contains(text.strip().lower()))
    return df


def summaries(df: DataFrame) -> DataFrame:
    """(id, n_preguntas, tipos, confianza, titulo) of traces (id, preguntas array<struct<tipo, instrucciones, confianza>>).

    The mean confidence leaves out questions without one; the title is the first instruction that is not blank.
    """
    own = F.filter(F.transform("preguntas", lambda p: p.confianza), lambda c: c.isNotNull())
    mean = F.when(F.size(own) > 0, F.round(F.aggregate(own, F.lit(0.0), lambda s, c: s + c) / F.size(own), 3))
    title = F.try_element_at(F.filter(F.transform("preguntas", lambda p: F.trim(p.instrucciones)), lambda t: t.isNotNull() & (t != "")), F.lit(1))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("preguntas", lambda p: p.tipo))), ",")
    return df.select("id", F.size("preguntas").alias("n_preguntas"), kinds.alias("tipos"), mean.alias("confianza"), F.coalesce(title, F.lit("traza sin instrucciones")).alias("titulo"))


def hit_rate(df: DataFrame, by: str, correct: str) -> DataFrame:
    """(by, evaluadas, aciertos, pct): share of the judged rows that are right; null where none is judged."""
    n = df.groupBy(by).agg(F.count(correct).alias("evaluadas"), F.count_if(F.col(correct)).alias("aciertos"))
    return n.withColumn("pct", F.round(100 * F.try_divide("aciertos", "evaluadas"), 1))


def rank_percentiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, q, valor): nearest-rank percentiles through counts of distinct values, so no group's values meet in one buffer.

    Running counts are a window over the distinct values of a group; null values fall out.
    """
    from pyspark.sql.window import Window

    n = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by)
    run = n.withColumn("_c", F.sum("_n").over(w.orderBy("_v"))).withColumn("_t", F.sum("_n").over(w))
    ends = run.select(by, "_v", "_c", "_t", F.explode(F.array(*map(F.lit, shares))).alias("q")).where(F.col("_c") >= F.ceil(F.round(F.col("q") * F.col("_t"), 9)))
    return ends.groupBy(by, "q").agg(F.min("_v").alias("valor"))


def limited(df: DataFrame, most: int = 16 * 1024, kept: int = 5, chars: int = 120) -> DataFrame:
    """Traces (id, fragmentos, descartados) held to `most` bytes of JSON: first `kept` fragments, then without the discarded ones, then neither.

    Strings are cut at `chars` first; `truncada` says whether anything was left out.
    """
    from legajo.operators.fragments import squeezed

    cut = df.withColumn("fragmentos", F.transform("fragmentos", lambda x: squeezed(x, chars))).withColumn("descartados", F.transform("descartados", lambda x: squeezed(x, chars)))
    size = lambda a, b: F.octet_length(F.to_json(F.struct("id", a.alias("fragmentos"), b.alias("descartados"))))
    f, d, none = F.col("fragmentos"), F.col("descartados"), F.array().cast("array<string>")
    few = F.slice(f, 1, kept)
    step = F.when(size(f, d) <= most, 0).when(size(few, d) <= most, 1).when(size(few, none) <= most, 2).otherwise(3)
    out = cut.withColumn("_s", step)
    return out.select("id", F.when(F.col("_s") == 0, f).when(F.col("_s") == 3, none).otherwise(few).alias("fragmentos"), F.when(F.col("_s") < 2, d).otherwise(none).alias("descartados"), (F.col("_s") > 0).alias("truncada"))
