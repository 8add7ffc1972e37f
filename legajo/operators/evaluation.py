"""Ranking and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prf(df: DataFrame, real: str, said: str) -> DataFrame:
    """(clase, soporte, precision, recall, f1) of every class that is real or said; one aggregation over both roles."""
    hit = F.col(real).eqNullSafe(F.col(said)).cast("int")
    roles = df.select(F.explode(F.array(F.struct(F.col(real).alias("clase"), F.lit(1).alias("r"), F.lit(0).alias("d"), hit.alias("vp")), F.struct(F.col(said).alias("clase"), F.lit(0).alias("r"), F.lit(1).alias("d"), F.lit(0).alias("vp")))).alias("x")).select("x.*")
    n = roles.groupBy("clase").agg(F.sum("r").alias("r"), F.sum("d").alias("d"), F.sum("vp").alias("vp"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 9)
    return n.select("clase", F.col("r").alias("soporte"), ratio(F.col("vp"), F.col("d")).alias("precision"), ratio(F.col("vp"), F.col("r")).alias("recall"), ratio(2 * F.col("vp"), F.col("d") + F.col("r")).alias("f1"))


def coverage_curve(df: DataFrame, real: str, said: str, score: str, thresholds: list[float]) -> DataFrame:
    """(umbral, cubiertos, cobertura, precision); one pass with one aggregate for each threshold."""
    aggs = [F.struct(F.lit(u).alias("umbral"), F.count_if(F.col(score) >= u).alias("c"), F.count_if((F.col(score) >= u) & (F.col(real) == F.col(said))).alias("h"), F.count(F.lit(1)).alias("n")) for u in thresholds]
    rows = df.agg(*[a.alias(f"u{i}") for i, a in enumerate(aggs)]).select(F.explode(F.array(*[f"u{i}" for i in range(len(aggs))])).alias("x")).select("x.*")
    return rows.select("umbral", F.col("c").alias("cubiertos"), F.round(F.col("c") / F.col("n"), 9).alias("cobertura"), F.round(F.try_divide("h", "c"), 9).alias("precision"))


def graded(ranked: DataFrame, k: int = 10) -> DataFrame:
    """(q, recall, mrr, ndcg) at k with gains 2**g - 1. ranked: (q, i, r, g); queries without relevant items fall out."""
    gain = (F.pow(F.lit(2.0), "g") - 1)
    x = ranked.groupBy("q").agg(
        F.sum(F.when(F.col("r") <= k, gain / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("dcg"),
        F.max(F.when((F.col("r") <= k) & (F.col("g") > 0), 1.0 / F.col("r")).otherwise(0.0)).alias("mrr"),
        F.count_if((F.col("g") > 0) & (F.col("r") <= k)).alias("hit"),
        F.count_if(F.col("g") > 0).alias("rel"),
    )
    best = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("g")))).where(F.col("_k") <= k)
    ideal = best.groupBy("q").agg(F.sum(gain / F.log2(F.col("_k") + 1)).alias("ideal"))
    return x.join(ideal, "q").where("rel > 0").select("q", F.round(F.col("hit") / F.least("rel", F.lit(k)), 9).alias("recall"), F.round("mrr", 9).alias("mrr"), F.round(F.col("dcg") / F.col("ideal"), 9).alias("ndcg"))


def binary(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(q, recall, mrr, ndcg), unbounded recall. ranked: (q, i, r); relevant: (q, entry, i). An item scores once, an entry is found once."""
    hits = ranked.where(F.col("r") <= k).join(relevant, ["q", "i"])
    found = hits.groupBy("q").agg(F.countDistinct("entry").alias("found"), F.min("r").alias("first"))
    by_rank = hits.select("q", "r").distinct().groupBy("q").agg(F.sum(1 / F.log2(F.col("r") + 1)).alias("dcg"))
    n = relevant.groupBy("q").agg(F.countDistinct("entry").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return n.join(found, "q", "left").join(by_rank, "q", "left").select("q", F.round(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)), 9).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 9).alias("ndcg"))


def entropy_confidence(df: DataFrame, column: str) -> DataFrame:
    """One row: 1 - H(p) / ln N of the distribution of a column; 1 for a single value."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return t.select(F.round(F.when(F.col("k") > 1, 1 - (F.log("t") - F.col("s") / F.col("t")) / F.log("k")).otherwise(1.0), 9).alias("confianza"))


def macro_f1(per_class: DataFrame, supported: bool = True) -> DataFrame:
    """(macro_f1, clases): mean F1 of prf() over the classes with support, or over all; 0 without any."""
    rows = per_class.where("soporte > 0") if supported else per_class
    return rows.agg(F.coalesce(F.round(F.avg("f1"), 9), F.lit(0.0)).alias("macro_f1"), F.count(F.lit(1)).alias("clases"))


def thresholds(df: DataFrame, real: str, said: str, score: str, cost: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(by, umbral, cobertura, precision, utilidad) of each score, rounded to four places, and of 0: what is said from it on.

    Running sums over the distinct scores, so rows are aggregated before the window.
    """
    by = by or []
    s = df.select(*by, F.round(score, 4).alias("umbral"), (F.col(real) == F.col(said)).cast("int").alias("_h"), F.lit(1).alias("_c"))
    s = s.unionByName(df.select(*by).distinct().select(*by, F.lit(0.0).alias("umbral"), F.lit(0).alias("_h"), F.lit(0).alias("_c"))) if by else s.unionByName(df.sparkSession.createDataFrame([(0.0, 0, 0)], "umbral double, _h int, _c int"))
    g = s.groupBy(*by, "umbral").agg(F.sum("_h").alias("_h"), F.sum("_c").alias("_c"))
    w = Window.partitionBy(*by)
    down = w.orderBy(F.desc("umbral"))
    r = g.withColumn("_hit", F.sum("_h").over(down)).withColumn("_n", F.sum("_c").over(down)).withColumn("_t", F.sum("_c").over(w))
    return r.select(*by, "umbral", F.round(F.try_divide("_n", "_t"), 9).alias("cobertura"), F.round(F.try_divide("_hit", "_n"), 9).alias("precision"), F.round(F.col("_hit") - cost * (F.col("_n") - F.col("_hit")), 9).alias("utilidad"))


def best_threshold(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold of greatest use, the smallest of equals."""
    by = by or []
    return curve.groupBy(*by).agg(F.min(F.struct((-F.col("utilidad")).alias("u"), "umbral", "cobertura", "precision")).alias("x")).select(*by, "x.umbral", "x.cobertura", "x.precision", (-F.col("x.u")).alias("utilidad"))


def target_point(curve: DataFrame, precision: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """The threshold of greatest coverage whose precision reaches the target, the smallest of equals."""
    by = by or []
    rows = curve.where(F.col("precision") >= precision)
    return rows.groupBy(*by).agg(F.min(F.struct((-F.col("cobertura")).alias("c"), "umbral", "precision")).alias("x")).where("x is not null").select(*by, "x.umbral", (-F.col("x.c")).alias("cobertura"), "x.precision")


def cross_calibrated(df: DataFrame, key: str, real: str, said: str, score: str, repeats: int = 10, cost: float = 1.0) -> DataFrame:
    """(vuelta, mitad, umbral, cobertura, precision): the threshold of one half of each class, applied to the other half.

    Halves by the hash of repeat and key within each class; every repeat gives both directions.
    """
    r = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("vuelta"))
    order = F.md5(F.concat_ws(":", F.col("vuelta").cast("string"), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy("vuelta", real).orderBy(order, key))
    size = F.count(F.lit(1)).over(Window.partitionBy("vuelta", real))
    halves = r.withColumn("mitad", (place <= F.floor(size / 2)).cast("int"))
    chosen = best_threshold(thresholds(halves, real, said, score, cost, ["vuelta", "mitad"]), ["vuelta", "mitad"]).select("vuelta", "mitad", "umbral")
    other = halves.withColumn("mitad", 1 - F.col("mitad")).join(chosen, ["vuelta", "mitad"])
    hit = (F.col(score) >= F.col("umbral")) & (F.col(real) == F.col(said))
    return other.groupBy("vuelta", "mitad", "umbral").agg(F.round(F.avg((F.col(score) >= F.col("umbral")).cast("int")), 9).alias("cobertura"), F.round(F.try_divide(F.count_if(hit), F.count_if(F.col(score) >= F.col("umbral"))), 9).alias("precision"))


def top_n(scores: DataFrame, truth: DataFrame, n: int = 3) -> DataFrame:
    """(casos, exactitud, en_n, margen): share of cases whose class is first, among the first n, and the mean gap of the first two scores.

    scores: (id, clase, nota), truth: (id, real). Ties go to the smaller class.
    """
    w = Window.partitionBy("id").orderBy(F.desc("nota"), "clase")
    r = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(2, n))
    one = r.join(truth, "id").groupBy("id").agg(F.min(F.when(F.col("clase") == F.col("real"), F.col("_r"))).alias("p"), F.max(F.when(F.col("_r") == 1, F.col("nota"))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col("nota"))).alias("b"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 9)
    return one.agg(F.count(F.lit(1)).alias("casos"), share(F.col("p") == 1).alias("exactitud"), share(F.col("p") <= n).alias("en_n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("margen"))


def confusions(df: DataFrame, real: str, said: str, n: int = 10) -> DataFrame:
    """(real, dicho, n, parte): the n most frequent mistakes and their share of the rows of the real class."""
    whole = df.groupBy(F.col(real).alias("real")).agg(F.count(F.lit(1)).alias("_t"))
    wrong = df.where(F.col(real) != F.col(said)).groupBy(F.col(real).alias("real"), F.col(said).alias("dicho")).agg(F.count(F.lit(1)).alias("n"))
    return wrong.join(whole, "real").select("real", "dicho", "n", F.round(F.col("n") / F.col("_t"), 9).alias("parte")).orderBy(F.desc("n"), "real", "dicho").limit(n)


def generation_checks(rows: DataFrame, prompt: str, answer: str) -> DataFrame:
    """rows with `vacia`, `copia` (share of the answer's distinct words that the prompt has) and `largo` (characters of the answer for each of the prompt)."""
    from legajo.functions.text import words

    a, p = F.array_distinct(words(F.col(answer))), F.array_distinct(words(F.col(prompt)))
    copied = F.round(F.try_divide(F.size(F.array_intersect(a, F.coalesce(p, F.array().cast("array<string>")))), F.size(a)), 9)
    return rows.select("*", F.coalesce(F.size(a) == 0, F.lit(True)).alias("vacia"), F.coalesce(copied, F.lit(0.0)).alias("copia"), F.round(F.try_divide(F.length(F.coalesce(F.col(answer), F.lit(""))), F.length(prompt)), 9).alias("largo"))


def proportions(df: DataFrame, by: str, conditions: list[str]) -> DataFrame:
    """(by, condicion, si, total, parte): how often each boolean column holds, nulls not counted; the row with null in `by` is the whole."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("condicion"), F.col(c).alias("v")) for c in conditions])).alias("x")
    long = df.select(by, parts).select(by, "x.condicion", "x.v").where("v is not null")
    g = long.groupBy("condicion", by).agg(F.count_if("v").alias("si"), F.count(F.lit(1)).alias("total")).where(F.col(by).isNotNull())
    whole = long.groupBy("condicion").agg(F.count_if("v").alias("si"), F.count(F.lit(1)).alias("total")).select("condicion", F.lit(None).cast(df.schema[by].dataType).alias(by), "si", "total")
    return g.unionByName(whole).select(by, "condicion", "si", "total", F.round(F.col("si") / F.col("total"), 9).alias("parte"))


def verdict(before: DataFrame, now: DataFrame, success: str, invention: str) -> DataFrame:
    """(exito_antes, exito, invencion_antes, invencion, pasa): a change passes if success grows and invention does not."""
    rate = lambda df, s, i: df.agg(F.round(F.avg(F.col(success).cast("int")), 9).alias(s), F.round(F.avg(F.col(invention).cast("int")), 9).alias(i))
    both = rate(before, "exito_antes", "invencion_antes").crossJoin(rate(now, "exito", "invencion"))  # one row each
    return both.select("exito_antes", "exito", "invencion_antes", "invencion", ((F.col("exito") > F.col("exito_antes")) & (F.col("invencion") <= F.col("invencion_antes"))).alias("pasa"))


def aligned(steps: DataFrame) -> DataFrame:
    """(caso, n, m): greedy alignment in order of wanted step n with delivered step m; steps: (caso, n, m) of the pairs alike enough.

    Each wanted step takes the first delivered one behind the last one taken; the pairs of one case are one array.
    """
    pairs = steps.groupBy("caso").agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("bigint").alias("n"), F.col("m").cast("bigint").alias("m")))).alias("x"))
    zero = F.expr("cast(array() as array<struct<n:bigint,m:bigint>>)")
    last = lambda s, c: F.coalesce(F.try_element_at(s, F.lit(-1))[c], F.lit(-1))
    taken = F.aggregate("x", zero, lambda s, p: F.when((p["n"] > last(s, "n")) & (p["m"] > last(s, "m")), F.concat(s, F.array(p))).otherwise(s))
    return pairs.select("caso", F.explode(taken).alias("x")).select("caso", "x.n", "x.m")


def expected_level(probabilities: str) -> Column:
    """Mean level of an array of probabilities of levels 0, 1, 2 …"""
    return F.aggregate(F.transform(probabilities, lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x)
