"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm import cuts, leaks, lines, mixes, near, pairs, scans, splits, survivors, tokens
from legajo.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark, d):
    return leaks.leaked(table(spark, d, "artifacts"), table(spark, d, "reserva"))


@query
def p2_near(spark, d):
    """Messages that hold 12 words of an item nearly in their places, one of them may be missing."""
    m = leaks.near_matches(table(spark, d, "artifacts"), table(spark, d, "reserva"))
    return m.select(F.col("doc").alias("artifact_id"), F.col("item").alias("item_id"), "desde", "palabras", "movidas")


@query
def p3_found(spark, d):
    return survivors.best_rows(table(spark, d, "fragmentos"), table(spark, d, "niveles_confianza"))


@query
def p3_survivor(spark, d):
    s = survivors.survivors(table(spark, d, "fragmentos"), table(spark, d, "niveles_confianza"))
    return s.select("grupo", "filas", "id", "manual", "confianza", "fuente", "titulo", "pagina", "texto")


@query
def p4_found(spark, d):
    return lines.repeated_lines(table(spark, d, "fragmentos"))


@query
def p4_blocks(spark, d):
    found, _ = lines.repeated_blocks(table(spark, d, "fragmentos"))
    return found.select("m", F.size("bloque").alias("lineas"), F.array_join(F.transform("bloque", lambda x: x.cast("string")), ",").alias("bloque"), "filas")


@query
def p4_clean(spark, d):
    return lines.cleaned(table(spark, d, "fragmentos"))


@query
def p5_found(spark, d):
    return near.near_pairs(table(spark, d, "fragmentos"))


@query
def p6_found(spark, d):
    return splits.oversized(table(spark, d, "fragmentos"))


@query
def p6_pieces(spark, d):
    return splits.pieces(table(spark, d, "fragmentos")).drop("desde")


@query
def p6_check(spark, d):
    """Every rule of the pieces, held against the whole texts."""
    return splits.checked(table(spark, d, "fragmentos"))


@query
def p8_ids(spark, d):
    docs = table(spark, d, "documents")
    return tokens.encode(docs, written(tokens.word_table(docs), "palabras"))


_FOLD = "strip_accents(lower({}))"
_LEVEL = "regexp_replace(strip_accents(lower({})), '[\\s\\xA0_-]+', '', 'g')"

ORACLES["p3_found"] = f"""
WITH n AS (SELECT {_LEVEL.format("confianza")} AS k, min(rango) AS rango FROM niveles_confianza GROUP BY 1),
r AS (SELECT f.id, f.manual, f.fila, f.visto, n.rango,
  regexp_matches(f.fuente, '(?i)^\\s*(https?|manual)://\\p{{L}}') AS ok
  FROM fragmentos f LEFT JOIN n ON n.k = {_LEVEL.format("f.confianza")} WHERE f.manual IS NOT NULL AND f.id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY id, manual ORDER BY coalesce(rango, 99), visto DESC NULLS LAST, fila DESC) AS p FROM r)
SELECT min(fila) AS grupo, coalesce(arg_min(fila, p) FILTER (WHERE rango IS NOT NULL), 0) AS fila_confianza,
  coalesce(arg_min(fila, p) FILTER (WHERE ok), 0) AS fila_fuente
FROM o GROUP BY id, manual HAVING count(*) >= 2"""

ORACLES["p4_found"] = f"""
WITH l AS (SELECT fila, manual, unnest(string_split(texto, chr(10))) AS t, generate_subscripts(string_split(texto, chr(10)), 1) AS linea
  FROM fragmentos WHERE texto IS NOT NULL AND manual IS NOT NULL),
k AS (SELECT fila, manual, linea, regexp_replace({_FOLD.format("t")}, '[^a-z]', '', 'g') AS c FROM l),
n AS (SELECT manual, count(*) AS total FROM fragmentos WHERE manual IS NOT NULL GROUP BY 1),
g AS (SELECT manual, c FROM k JOIN n USING (manual) WHERE length(c) >= 15 GROUP BY manual, c, total
  HAVING count(DISTINCT fila) >= 8 AND count(DISTINCT fila) >= 0.1 * total)
SELECT fila, linea::BIGINT AS linea FROM k JOIN g USING (manual, c)"""

ORACLES["p6_found"] = """
SELECT fila FROM fragmentos WHERE length(trim(texto, ' ' || chr(9) || chr(10) || chr(13))) > 1800"""


@query
def p7_found(spark, d):
    return scans.noise(table(spark, d, "fragmentos"))


@query
def p7_text(spark, d):
    return scans.repaired(table(spark, d, "fragmentos"))


@query
def p1_found(spark, d):
    return pairs.broken(table(spark, d, "linea_base"), table(spark, d, "documents"))


@query
def p10_found(spark, d):
    return cuts.cut_texts(table(spark, d, "documents"))


@query
def p10_rates(spark, d):
    return cuts.rates(table(spark, d, "documents"))


def _sized(spark, d):
    docs = table(spark, d, "documents")
    return written(tokens.token_counts(docs, written(tokens.word_table(docs), "palabras"), keep=["source"]), "medidas")


@query
def p9_mix(spark, d):
    drawn, _ = mixes.mix(_sized(spark, d), table(spark, d, "mezcla"))
    return drawn


@query
def p9_shares(spark, d):
    return mixes.shares(*mixes.mix(_sized(spark, d), table(spark, d, "mezcla")))


@query
def p9_check(spark, d):
    """For each source of each plan the documents drawn beyond the cap, drawn twice or foreign, and whether its tokens are the wanted ones up to the two longest documents."""
    sized, plans = _sized(spark, d), table(spark, d, "mezcla")
    drawn, want = mixes.mix(sized, plans)
    drawn = written(drawn, "mezcla")
    own = drawn.groupBy("plan", "source").agg(F.sum(F.col("tokens") * F.col("repeticiones")).alias("_t"), F.max("repeticiones").alias("_r"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("_d"))
    real = drawn.join(sized, ["doc_id", "source", "tokens"], "left_anti").groupBy("plan", "source").agg(F.count(F.lit(1)).alias("_a"))
    long = sized.groupBy("source").agg(F.max("tokens").alias("_m"))
    rows = want.join(own, ["plan", "source"], "left").join(real, ["plan", "source"], "left").join(long, "source", "left").fillna(0, ["_t", "_r", "_d", "_a", "_m"])
    return rows.select("plan", "source", F.greatest(F.lit(0), F.col("_r") - F.col("max_repeticiones")).cast("int").alias("sobre_tope"), F.col("_d").alias("dobles"), F.col("_a").alias("ajenos"), (F.abs(F.col("_t") - F.col("meta")) <= 2 * F.col("_m")).alias("cerca"))


@query
def p5_groups(spark, d):
    return near.near_groups(table(spark, d, "fragmentos"))


_WORDS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "SELECT {0}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {0}, {1} AS w FROM {2} WHERE content IS NOT NULL))"

ORACLES["p2_found"] = f"""
WITH a AS ({_GRAMS.format("artifact_id", _WORDS.format("content"), "artifacts")}), r AS ({_GRAMS.format("item_id", _WORDS.format("content"), "reserva")})
SELECT DISTINCT artifact_id, item_id FROM a JOIN r USING (g)"""

ORACLES["p4_clean"] = f"""
WITH found AS ({ORACLES["p4_found"]}),
l AS (SELECT fila, manual, unnest(string_split(texto, chr(10))) AS t, generate_subscripts(string_split(texto, chr(10)), 1) AS linea FROM fragmentos WHERE texto IS NOT NULL),
k AS (SELECT *, regexp_replace({_FOLD.format("t")}, '[^a-z]', '', 'g') AS c FROM l),
pairs AS (SELECT fila, linea AS a, lead(linea) OVER (PARTITION BY fila ORDER BY linea) AS b FROM found),
gaps AS (SELECT p.fila, p.a, p.b, any_value(k.manual) AS manual, string_agg(CASE WHEN k.linea IN (p.a, p.b) THEN k.c ELSE lower(trim(k.t, ' ' || chr(9) || chr(13))) END, chr(10) ORDER BY k.linea) AS g
  FROM pairs p JOIN k ON k.fila = p.fila AND k.linea BETWEEN p.a AND p.b WHERE p.b > p.a + 1
  GROUP BY 1, 2, 3 HAVING max(CASE WHEN k.linea > p.a AND k.linea < p.b THEN length(k.c) ELSE 0 END) < 15),
n AS (SELECT manual, count(*) AS total FROM fragmentos WHERE manual IS NOT NULL GROUP BY 1),
wide AS (SELECT manual, g FROM gaps JOIN n USING (manual) GROUP BY manual, g, total HAVING count(DISTINCT fila) >= 8 AND count(DISTINCT fila) >= 0.1 * total),
gone AS (SELECT fila, linea FROM found UNION SELECT gaps.fila, k.linea FROM gaps JOIN wide USING (manual, g) JOIN k ON k.fila = gaps.fila AND k.linea > gaps.a AND k.linea < gaps.b),
kept AS (SELECT fila, string_agg(t, chr(10) ORDER BY linea) AS s FROM l ANTI JOIN gone USING (fila, linea) GROUP BY 1)
SELECT f.fila, CASE WHEN f.fila IN (SELECT fila FROM gone) THEN coalesce(s, '') ELSE f.texto END AS texto FROM fragmentos f LEFT JOIN kept USING (fila)"""

ORACLES["p6_check"] = f"""
SELECT fila, 0::INT AS piezas_mal, length({(T := "trim(texto, ' ' || chr(9) || chr(10) || chr(13))")})::INT AS largo FROM fragmentos WHERE length({T}) > 0"""

ORACLES["p9_check"] = """
SELECT DISTINCT plan, source, 0::INT AS sobre_tope, 0::BIGINT AS dobles, 0::BIGINT AS ajenos, true AS cerca FROM mezcla WHERE plan IS NOT NULL AND source IS NOT NULL"""

ORACLES["p5_found"] = f"""
WITH w AS (SELECT fila, {_WORDS.format("texto")} AS w FROM fragmentos WHERE texto IS NOT NULL), g AS (SELECT fila, list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 30),
c AS (SELECT g, min(fila) AS c, len(g) AS n FROM g GROUP BY g), u AS (SELECT c, n, unnest(g) AS s FROM c), b AS (SELECT x.c AS a, y.c AS b, x.n AS na, y.n AS nb, count(*) AS k FROM u x JOIN u y ON x.s = y.s AND x.c < y.c AND x.n <= 2 * y.n AND y.n <= 2 * x.n GROUP BY 1, 2, 3, 4),
p AS (SELECT a, b FROM b WHERE k >= 0.6 * (na + nb - k) UNION ALL SELECT c, c FROM c), f AS (SELECT g.fila, c.c FROM g JOIN c USING (g))
SELECT least(x.fila, y.fila) AS fila_a, greatest(x.fila, y.fila) AS fila_b FROM p JOIN f x ON x.c = p.a JOIN f y ON y.c = p.b WHERE p.a <> p.b OR x.fila < y.fila"""
