"""Classes of short texts and decisions: small talk, intents from similarities, staged choice, stable versions, second rounds, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.analysis import bucket, plain
from legajo.functions.text import strip

LAUGHTER = r"^(?:a|e|i)?(?:[jh][aeio]){2,}[jh]?$"


def small_talk(c: Column, vocabulary: list[str], most: int = 8) -> Column:
    """Share of the words of a message that are small talk: words of the vocabulary or laughter, letters drawn out or not.

    Empty messages and those of more than `most` words give 0. Vocabulary in the folded form, ñ as n.
    """
    ws = F.filter(F.split(F.regexp_replace(plain(c), "[^a-z]+", " "), " "), lambda w: w != "")
    known = F.array(*map(F.lit, vocabulary))
    once = lambda w: F.regexp_replace(w, r"(.)\1+", "$1")
    ours = lambda w: F.array_contains(known, w) | w.rlike(LAUGHTER) | F.array_contains(known, once(w)) | once(w).rlike(LAUGHTER)
    n = F.size(ws)
    return F.when((n > 0) & (n <= most), F.size(F.filter(ws, ours)) / n).otherwise(0.0)


def intents(scores: DataFrame, chat: DataFrame, threshold: float = 0.4, work: str = "trabajo", social: str = "social") -> DataFrame:
    """(qid, clase, nota): the best class of (qid, label, score) from the threshold on; else small talk where (qid, charla) is 1, else work."""
    best = scores.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("x"))
    j = chat.join(best, "qid", "left")
    sure = F.coalesce((-F.col("x.s") >= threshold) & (F.col("x.label") != work), F.lit(False))
    pure = F.coalesce(F.col("charla") == 1, F.lit(False))
    return j.select("qid", F.when(sure, F.col("x.label")).when(pure, F.lit(social)).otherwise(F.lit(work)).alias("clase"), F.when(sure | ~pure, -F.col("x.s")).otherwise(1.0).alias("nota"))


def staged(rules: DataFrame, scores: DataFrame, threshold: float = 0.4, margin: float = 0.08, sure: float = 0.9) -> DataFrame:
    """(qid, tipo, metodo): a clear rule decides; else the nearest class, if similar enough, ahead of the next and among the rules that met; else the rule.

    rules: (qid, tipo, candidatos, confianza), scores: (qid, label, score).
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "label")
    two = scores.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("qid").agg(F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("_l"), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("_a"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("score"))), F.lit(0.0)).alias("_b"))
    j = rules.join(two, "qid", "left")
    clear = F.coalesce(F.col("confianza") >= sure, F.lit(False))
    knn = F.coalesce((F.col("_a") >= threshold) & (F.round(F.col("_a") - F.col("_b"), 9) >= margin) & (F.col("tipo").isNull() | F.array_contains("candidatos", F.col("_l"))), F.lit(False))
    kind = F.when(clear, F.col("tipo")).when(knn, F.col("_l")).otherwise(F.coalesce("tipo", F.lit("desconocido")))
    return j.select("qid", kind.alias("tipo"), F.when(clear, "reglas").when(knn, "knn").when(F.col("tipo").isNotNull(), "reglas").otherwise("ninguno").alias("metodo"))


def decided(options: Column, proposal: Column) -> Column:
    """The proposal if it is among the options, else the first option; null without options."""
    return F.when(F.coalesce(F.array_contains(options, proposal), F.lit(False)), proposal).otherwise(F.try_element_at(options, F.lit(1)))


def version(asked: Column, key: Column, enabled: bool, fixed: str = "v1", percent: int = 0) -> Column:
    """v1 or v2: what is asked for where choosing is enabled, else a fixed v2, else v2 for a stable share of the keys."""
    want = F.lower(strip(asked))
    share = bucket(F.lower(strip(F.regexp_replace(key, r"\s+", " ")))) < percent
    out = F.when(F.lit(fixed == "v2"), "v2").when(F.lit(enabled and percent > 0) & share, "v2").otherwise("v1")
    return F.when(F.coalesce(F.lit(enabled) & want.isin("v1", "v2"), F.lit(False)), want).otherwise(out)


def sufficient(candidates: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(qid, mejor, basta): whether the best candidate of a query reaches `least`; queries without candidates don't."""
    best = candidates.groupBy("qid").agg(F.max("score").alias("mejor"))
    return queries.select("qid").distinct().join(best, "qid", "left").select("qid", "mejor", F.coalesce(F.col("mejor") >= least, F.lit(False)).alias("basta"))


def second_round(first: DataFrame, more: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(qid, doc_id, score, ronda): the first candidates, and for queries that they don't suffice for, those of `more` that are new."""
    short = sufficient(first, queries, least).where("not basta").select("qid")
    extra = more.join(short, "qid", "left_semi").join(first, ["qid", "doc_id"], "left_anti")
    return first.select("qid", "doc_id", "score", F.lit(1).alias("ronda")).unionByName(extra.select("qid", "doc_id", "score", F.lit(2).alias("ronda")))


def effective(score: Column, logit: Column, coverage: Column) -> Column:
    """Score of a candidate: its own, or the greater one of the logistic of an outside logit and its coverage where it has a logit."""
    s = 1 / (1 + F.exp(-logit))
    return F.when(logit.isNull(), score).otherwise(F.greatest(s, F.coalesce(coverage, s)))


def half_up(c: Column, places: int = 3) -> Column:
    """Cut after adding one half of the last place, as whole-number rounding does."""
    m = 10**places
    return F.floor(c * m + 0.5) / m


def half_even(c: Column, places: int = 3) -> Column:
    return F.bround(c, places)
