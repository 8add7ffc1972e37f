"""Rules over questions: kind of question, compact form, follow-up, evidence tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.text import SPACE, strip

# Cues of each kind of question, tested in this order; connectors that the compact form drops.
CUES = {
    "problema": ["error", "falla", "fallo", "problema", "no funciona", "no aparece", "no permite", "se bloquea", "no carga"],
    "comparacion": ["diferencia", "comparar", "compara", "comparacion", "versus", " frente a ", "cual conviene", "cual es mejor"],
    "procedimiento": ["cómo", "como ", "pasos", "paso a paso", "crear", "calcular", "guía", "guia", "tutorial", "cómo se", "como se", "ayúdame a", "ayudame a", "enséñame", "ensename a", "que debo hacer", "qué debo hacer", "dónde", "donde", "muéstrame", "muestrame", "ubicar", "encontrar", "me guías", "me guias"],
    "concepto": ["que es", "que significa", "para que sirve", "en que consiste", "define", "definicion", "concepto de"],
    "aclaracion": ["no entiendo", "no me queda claro", "explicame de otra forma", "reformula", "mas sencillo", "mas simple"],
}
FOLLOWS = [" eso ", " esto ", " aquello ", " ese ", " esa ", " lo anterior", " lo que dijiste", " despues", " siguiente", " ahi", " aqui", " su ", " continua", " continua desde"]
CONNECTORS = "a al algo como con cual cuales cuando de del desde donde el ella en es esa ese eso esta este hay la las lo los me mi o para pero por que se si sin su sus un una unos unas y yo manual manuales modulo segun significa".split()
PENALTY = {"tercero-sin-verificar": 0.04, "estado-2013": 0.04, "academico": 0.02}


def _signs(c: Column) -> Column:
    """Lower case, blanks squeezed, vowels without accents, signs as blanks."""
    return F.translate(F.lower(strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))), "áéíóúü¿?¡!,.:;", "aeiouu        ")


def simple(c: Column) -> Column:
    """As _signs(), blanks squeezed again."""
    return strip(F.regexp_replace(_signs(c), r"\s+", " "))


def _any(t: Column, cues: list[str]) -> Column:
    hit = F.lit(False)
    for x in cues:
        hit = hit | t.contains(x)
    return hit


def question_kind(c: Column, follows: Column | None = None) -> Column:
    """Kind of a question, the first whose cue it holds. `follows` says whether turns went before it."""
    t = F.concat(F.lit(" "), strip(_signs(c)), F.lit(" "))
    out = None
    if follows is not None:
        out = F.when(F.coalesce(follows, F.lit(False)) & _any(t, FOLLOWS), "seguimiento")
    for kind, cues in CUES.items():
        # the cues of a procedure are sought with one more blank at both ends
        hit = _any(F.concat(F.lit(" "), t, F.lit(" ")) if kind == "procedimiento" else t, cues)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("informacion_directa")


def compact(c: Column) -> Column:
    """Words of three letters or more that are no connectors; the trimmed question if none is left."""
    stop = F.array(*map(F.lit, CONNECTORS))
    keep = F.array_join(F.filter(F.split(simple(c), " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)), " ")
    return F.when(keep == "", strip(c)).otherwise(keep)


def select_context(found: DataFrame, most: float = 0.8, window: float = 0.18, n: int = 5) -> DataFrame:
    """(qid, doc_id, d, orden): nearest passages after the trust penalty, within the window of the best, one for each citation.

    found: (qid, doc_id, distancia, cita, confianza).
    """
    p = F.lit(0.0)
    for k, v in PENALTY.items():
        p = F.when(F.col("confianza") == k, F.lit(v)).otherwise(p)
    d = found.withColumn("d", F.round(F.col("distancia") + p, 9))
    best = F.min("d").over(Window.partitionBy("qid"))
    near = d.withColumn("_b", best).where(F.col("d") <= F.least(F.lit(most), F.col("_b") + window + 1e-9))
    one = near.withColumn("_c", F.row_number().over(Window.partitionBy("qid", "cita").orderBy("d", "doc_id"))).where("_c = 1")
    return one.withColumn("orden", F.row_number().over(Window.partitionBy("qid").orderBy("d", "doc_id"))).where(F.col("orden") <= n).select("qid", "doc_id", "d", "orden")


def accepted(candidates: DataFrame, threshold: float = 0.6, floor: float = 0.3, dominance: float = 1.4) -> DataFrame:
    """candidates (qid, doc_id, score, lexico, elemento) with `rival` and `aceptado`: at the threshold, or dominant.

    The rival is the best lexical score of another element in the query. Dominant is a candidate from the floor on whose lexical
    score is `dominance` times the rival's; without a rival the score must reach the middle between floor and threshold.
    """
    best = candidates.groupBy("qid", "elemento").agg(F.max("lexico").alias("l"))
    w = Window.partitionBy("qid").orderBy(F.desc("l"), "elemento")
    side = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    two = best.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("qid").agg(side(1, "elemento").alias("_e"), side(1, "l").alias("_a"), side(2, "l").alias("_b"))
    rival = F.greatest(F.lit(0.0), F.coalesce(F.when(F.col("_e") == F.col("elemento"), F.col("_b")).otherwise(F.col("_a")), F.lit(0.0)))
    rows = candidates.join(two, "qid").withColumn("rival", rival)
    lone = F.when(F.col("rival") == 0, F.col("score") >= (floor + threshold) / 2).otherwise(F.col("lexico") >= dominance * F.col("rival"))
    return rows.withColumn("aceptado", (F.col("score") >= threshold) | ((F.col("score") >= floor) & (F.col("lexico") > 0) & lone)).drop("_e", "_a", "_b")


def ambiguous(ranked: DataFrame, threshold: float = 0.6, gap: float = 0.05, share: float = 0.95) -> DataFrame:
    """(qid, ambigua): whether the two best candidates tie in score and lexical score, and the second reaches the threshold.

    ranked: (qid, doc_id, rank, score, lexico).
    """
    side = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    two = ranked.where("rank <= 2").groupBy("qid").agg(side(1, "score").alias("s1"), side(2, "score").alias("s2"), side(1, "lexico").alias("l1"), side(2, "lexico").alias("l2"))
    tie = (F.col("s2") >= threshold) & (F.col("s2") >= F.col("s1") - gap) & ~((F.col("l1") > 0) & (F.col("l2") < share * F.col("l1")))
    return two.select("qid", F.coalesce(tie, F.lit(False)).alias("ambigua"))


def rerank(ranked: DataFrame, scores: DataFrame, n: int = 30) -> DataFrame:
    """The first n of each query by an outside score, the rest behind in their order; without a finite score a row stays as it was."""
    s = ranked.join(scores, ["qid", "doc_id"], "left").withColumn("_ok", (F.col("rank") <= n) & F.col("nota").isNotNull() & ~F.isnan("nota") & (F.abs("nota") < float("inf")))
    w = Window.partitionBy("qid").orderBy(F.desc("_ok"), F.when(F.col("_ok"), -F.col("nota")), "rank")
    return s.withColumn("nuevo", F.row_number().over(w)).select("qid", "doc_id", "rank", "nuevo", F.col("_ok").alias("reordenado"))


def rubric(scores: DataFrame, weights: dict[str, float], least: dict[str, float]) -> DataFrame:
    """(id, puntaje, veredicto): weighted rubric of wide probabilities; every one at its least accepts from .80, review from .65."""
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    every = F.lit(True)
    for k, v in least.items():
        every = every & (F.col(k) >= v)
    p = F.round(total, 9)
    return scores.select("id", p.alias("puntaje"), F.when(every & (p >= 0.8), "aceptada").when(p >= 0.65, "revision").otherwise("rechazada").alias("veredicto"))
