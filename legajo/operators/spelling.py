"""Vocabulary and wording: close words, corrections, expansion, similarity, aliases, traces of another language, variants."""

from __future__ import annotations

import difflib
import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.analysis import deletions_udf, osa_udf, phonetic, plain, roots
from legajo.session import written

#: Words up to two letters longer are looked up by what deletions leave of them; those strings grow with the square of the length.
_DELETED = 40


def close_words(rare: DataFrame, common: DataFrame, most: int = 2) -> DataFrame:
    """(raro, comun, d): words of (raro) and (comun) up to `most` restricted edits apart; every such pair, from deletion neighbourhoods.

    `most` edits take at most so many letters from either word, so close words leave a common string of the longer one's length
    less `most`. Words that are too long for that, and words up to `most` letters shorter, are paired by length alone.
    """
    a = rare.select("raro").distinct().withColumn("la", F.length("raro"))
    b = common.select("comun").distinct().withColumn("lb", F.length("comun"))
    left = lambda x, w, n: x.where(F.col(n) <= _DELETED + most).withColumn("k", F.explode(deletions_udf(most)(w)))
    short = left(a, "raro", "la").join(left(b, "comun", "lb"), "k").where(F.length("k") == F.greatest(F.lit(0), F.greatest("la", "lb") - most)).drop("k")
    # Pairs with a word above _DELETED + most, so that both are above _DELETED; all others leave a common string.
    band = b.where(F.col("lb") > _DELETED).withColumn("l", F.explode(F.sequence(F.col("lb") - most, F.col("lb") + most)))
    long = a.where(F.col("la") > _DELETED).join(band, F.col("la") == F.col("l")).where(F.greatest("la", "lb") > _DELETED + most).drop("l")
    # A transposition counts as two plain edits at most, so the cheap bound loses nothing.
    p = short.distinct().unionByName(long).where(F.levenshtein("raro", "comun", 2 * most) >= 0)
    return p.withColumn("d", osa_udf(most)("raro", "comun")).where((F.col("d") <= most) & (F.col("raro") != F.col("comun"))).select("raro", "comun", "d")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words are equal or one insertion, deletion or substitution apart; null if one is null."""
    return F.levenshtein(a, b, 1) >= 0


def corrections(vocabulary: DataFrame, seen: int = 3, letters: int = 6) -> DataFrame:
    """(word, correcta, por): the most frequent word of the same sound, else, from `letters` letters on, one edit away and seen so often.

    vocabulary: (word, df). A word is never corrected to a rarer one. Ties go to the first in the alphabet.
    """
    v = vocabulary.where(F.col("word").rlike(r"^\p{L}+$")).withColumn("s", phonetic(F.col("word")))
    best = v.where(F.col("df") >= seen).groupBy("s").agg(F.min(F.struct((-F.col("df")).alias("n"), "word")).alias("x"))
    by_sound = v.join(best, "s").where((F.col("word") != F.col("x.word")) & (F.col("df") < -F.col("x.n"))).select("word", F.col("x.word").alias("correcta"), F.lit("sonido").alias("por"))
    rest = written(v.join(by_sound.select("word"), "word", "left_anti").where(F.length("word") >= letters).select("word", "df"), "restos")
    pairs = close_words(rest.where(F.col("df") < seen).select(F.col("word").alias("raro")), v.where(F.col("df") >= seen).select(F.col("word").alias("comun")), 1)
    pairs = pairs.where(F.levenshtein("raro", "comun", 1) == 1).join(vocabulary.select(F.col("word").alias("comun"), "df"), "comun")
    by_edit = pairs.groupBy(F.col("raro").alias("word")).agg(F.min(F.struct((-F.col("df")).alias("n"), "comun")).alias("x")).select("word", F.col("x.comun").alias("correcta"), F.lit("letra").alias("por"))
    return by_sound.unionByName(by_edit)


def expansions(vocabulary: DataFrame, rare: int = 3, times: int = 10, n: int = 2, weight: float = 0.7) -> DataFrame:
    """(raro, vecino, d, r, peso): for words with df < rare the n closest ones with df >= times * max(df, 1).

    vocabulary: (w, df). One edit, two from eight letters on; nearest first, then most frequent, then by name. Letters only, four at least.
    """
    v = written(vocabulary.where(F.col("w").rlike(r"^\p{L}{4,}$")).where((F.col("df") < rare) | (F.col("df") >= times)), "vocabulario")
    d = close_words(v.where(F.col("df") < rare).select(F.col("w").alias("raro")), v.where(F.col("df") >= times).select(F.col("w").alias("comun")), 2)
    d = d.where((F.col("d") <= 1) | (F.length("raro") >= 8)).join(v.select(F.col("w").alias("raro"), F.col("df").alias("n")), "raro").join(v.select(F.col("w").alias("comun"), F.col("df").alias("m")), "comun").where(F.col("m") >= times * F.greatest("n", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("raro").orderBy("d", F.desc("m"), "comun"))
    return d.withColumn("r", rank).where(F.col("r") <= n).select("raro", F.col("comun").alias("vecino"), "d", "r", F.lit(weight).alias("peso"))


def key_form(c: Column) -> Column:
    """Key of duplicates: folded, signs as blanks, single blanks; what holds nothing but signs stays as it is, trimmed."""
    s = F.trim(F.regexp_replace(F.regexp_replace(plain(c), r"[^a-z0-9\s]", " "), r"\s+", " "))
    return F.when(s == "", F.trim(F.coalesce(c, F.lit("")))).otherwise(s)


def _ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return f(a, b)


def similarity(a: Column, b: Column) -> Column:
    """Greater one of the words' Jaccard index and the matching-blocks ratio, over key forms. Matching blocks have no native form."""
    x, y = key_form(a), key_form(b)
    p, q = (F.array_distinct(F.filter(F.split(k, " "), lambda w: w != "")) for k in (x, y))
    jaccard = F.when((F.size(p) > 0) & (F.size(q) > 0), F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))).otherwise(0.0)
    return F.greatest(jaccard, _ratio(x, y))


# Letters and words that Portuguese has and Spanish has not.
PORTUGUESE_LETTERS = "àãõç"
PORTUGUESE = ["também", "tambem", " uma ", " umas ", " não ", " nao ", " dos ", " das ", " dum ", " num ", " numa ", " neste ", " nesta ", "desse ", " dessa ", " disso ", " você ", " voce ", " obrigado", " muito ", " foi ", " têm ", " são ", " sao ", " pois ", " através ", "atráves", " estão ", " estão"]


def leaks_portuguese(c: Column) -> Column:
    """Whether a Spanish text has slipped into Portuguese, by letters and a closed list of words."""
    t = F.lower(F.concat(F.lit(" "), c, F.lit(" ")))
    hit = t.rlike(f"[{PORTUGUESE_LETTERS}]")
    for w in PORTUGUESE:
        hit = hit | t.contains(w)
    return hit


def aliases(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, alias, destino, desde): names found in (id, texto) as whole words; of overlapping ones the longest, then the first.

    names: (alias, destino), a hand-made list that is broadcast.
    """
    n = names.select("alias", "destino", key_form(F.col("alias")).alias("_k")).where("_k <> ''")
    t = texts.select("id", F.concat(F.lit(" "), key_form(F.col("texto")), F.lit(" ")).alias("_t"))
    hits = t.join(F.broadcast(n), F.col("_t").contains(F.concat(F.lit(" "), F.col("_k"), F.lit(" ")))).select("id", "alias", "destino", F.expr("locate(concat(' ', _k, ' '), _t)").alias("desde"), F.length("_k").alias("largo"))
    over = F.col("a.id") == F.col("b.id")
    better = (F.col("b.largo") > F.col("a.largo")) | ((F.col("b.largo") == F.col("a.largo")) & ((F.col("b.desde") < F.col("a.desde")) | ((F.col("b.desde") == F.col("a.desde")) & (F.col("b.alias") < F.col("a.alias")))))
    meets = (F.col("b.desde") < F.col("a.desde") + F.col("a.largo") + 1) & (F.col("a.desde") < F.col("b.desde") + F.col("b.largo") + 1)
    return hits.alias("a").join(hits.alias("b"), over & meets & better, "left_anti").select("id", "alias", "destino", "desde")


def single_target(found: DataFrame) -> DataFrame:
    """(id, destino) where all names of a text point to one target."""
    return found.groupBy("id").agg(F.min("destino").alias("destino"), F.max("destino").alias("_b")).where(F.col("destino") == F.col("_b")).select("id", "destino")


def _noised(text: str, level: int, rng: random.Random) -> str:
    words = text.split(" ")
    for i, w in enumerate(words):
        if level >= 1:
            w = w.translate(str.maketrans("áéíóúü", "aeiouu"))
        if level >= 2 and len(w) > 4 and rng.random() < 0.3:
            k = rng.randrange(1, len(w) - 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[: k - 1] + w[k] + w[k - 1] + w[k + 1 :], w[:k] + w[k] + w[k:]])
        if level >= 3 and rng.random() < 0.4:
            w = w.replace("qu", "k").replace("v", "b").replace("h", "").lower()
        words[i] = w
    return " ".join(words)


def variants(texts: DataFrame, levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(id, nivel, texto): spellings of (id, texto) as people type them: without accents, with slips, as heard. The id is the seed."""
    kind = f"id {texts.schema['id'].dataType.simpleString()}, nivel int, texto string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, _noised(t, n, random.Random(hashlib.sha256(f"{i}:{n}".encode()).hexdigest()))) for i, t in zip(b["id"], b["texto"], strict=True) if t for n in levels]
            yield pd.DataFrame(rows, columns=["id", "nivel", "texto"])

    return texts.select("id", "texto").mapInPandas(run, kind)


def shares_roots(a: Column, b: Column) -> Column:
    """Mean of the shares of roots that two questions have in common; 0 where one has none."""
    x, y = F.array_distinct(roots(a)), F.array_distinct(roots(b))
    n = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), (n / F.size(x) + n / F.size(y)) / 2).otherwise(0.0)
