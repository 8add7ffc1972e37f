"""Evidence, citations, steps and question-bank queries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions import analysis
from legajo.operators import quality, retrieval, routing, sampling, spelling, vectors
from legajo.plans.registry import query
from legajo.plans.textual import _NEAR, _ROOTS, _lists, _questions, _roots, _vectors, bm25_sql, tokens_sql

_RP, _RR = (f"list_distinct({_ROOTS.replace('lower(text)', f'lower({c})')})" for c in ("prompt", "respuesta"))


@query(f"""WITH r AS (SELECT id, {_RP} AS p, {_RR} AS r FROM linea_base WHERE prompt IS NOT NULL AND respuesta IS NOT NULL)
SELECT id, len(p) > 0 AND len(list_intersect(p, r)) >= least(len(p), 2) AND len(list_intersect(p, r)) >= 0.6 * len(p) AS apoyo FROM r""")
def lexical_support(t):
    p = t.linea_base.where("prompt is not null and respuesta is not null")
    return p.select("id", quality.supported(F.col("prompt"), F.col("respuesta")).alias("apoyo"))


@query()
def exact_forms(t):
    return t.linea_base.where("prompt is not null").select("id", F.explode(quality.exact_forms(F.col("prompt"))).alias("forma"))


@query("""WITH b AS (SELECT id, manual FROM fragmentos), c AS (SELECT fila AS cita, id, CASE WHEN fila % 11 = 0 THEN 'otro' ELSE manual END AS manual, fila FROM fragmentos WHERE fila % 50 = 0 AND manual IS NOT NULL),
d AS (SELECT cita, CASE WHEN fila % 150 = 0 THEN 'x-' || id ELSE id END AS id, manual FROM c),
n AS (SELECT id, manual, count(*) AS n FROM b GROUP BY 1, 2), m AS (SELECT id, count(*) AS m FROM b GROUP BY 1)
SELECT cita, CASE WHEN n > 3 THEN 'ambigua' WHEN n IS NOT NULL THEN 'ok' WHEN m IS NOT NULL THEN 'otro-manual' ELSE 'falta' END AS estado
FROM d LEFT JOIN n ON n.id = d.id AND n.manual = d.manual LEFT JOIN m ON m.id = d.id""")
def citation_states(t):
    c = t.fragmentos.where("fila % 50 = 0 and manual is not null")
    c = c.select(F.col("fila").alias("cita"), F.when(F.col("fila") % 150 == 0, F.concat(F.lit("x-"), F.col("id"))).otherwise(F.col("id")).alias("id"), F.when(F.col("fila") % 11 == 0, "otro").otherwise(F.col("manual")).alias("manual"))
    return quality.resolve_citations(c, t.fragmentos)


@query(r"""WITH l AS (SELECT id, unnest(string_split(respuesta, chr(10))) AS l FROM linea_base)
SELECT id, regexp_extract(l, '^\s*(\d+)', 1)::INT AS n, trim(regexp_replace(l, '^\s*\d+[.)]\s+', ''), ' ') AS paso FROM l WHERE regexp_matches(l, '^\s*\d+[.)]\s+\S')""")
def answer_steps(t):
    return quality.numbered_steps(t.linea_base, "id", "respuesta")


@query(r"""WITH l AS (SELECT id, unnest(string_split(respuesta, chr(10))) AS l FROM linea_base), s AS (SELECT id, regexp_extract(l, '^\s*(\d+)', 1)::INT AS n FROM l WHERE regexp_matches(l, '^\s*\d+[.)]\s+\S'))
SELECT id FROM s WHERE NOT (n = 2 AND id % 2 = 0) GROUP BY 1 HAVING min(n) <> 1 OR max(n) <> count(*) OR count(DISTINCT n) <> count(*)""")
def misnumbered_steps(t):
    """Answers of even number lose their second step, so that some are out of order."""
    steps = quality.numbered_steps(t.linea_base, "id", "respuesta")
    return quality.misnumbered(steps.where("not (n = 2 and id % 2 = 0)"), "id")


@query("""SELECT fila, trim(string_split(titulo, '›')[1], ' ') AS modulo, CASE WHEN len(string_split(titulo, '›')) > 1 THEN trim(string_split(titulo, '›')[-1], ' ') END AS seccion FROM fragmentos WHERE length(texto) >= 40""")
def question_nodes(t):
    return quality.nodes(t.fragmentos, "fila", "titulo", "texto")


@query(r"""WITH l AS (SELECT fila, unnest(string_split(replace(texto, chr(13), ''), chr(10))) AS l, generate_subscripts(string_split(replace(texto, chr(13), ''), chr(10)), 1) AS p FROM fragmentos WHERE texto IS NOT NULL),
k AS (SELECT *, starts_with(l, '## ') AS t FROM l WHERE trim(l, ' ') <> ''), s AS (SELECT *, (sum(t::INT) OVER (PARTITION BY fila ORDER BY p))::BIGINT AS seccion, lag(l) OVER (PARTITION BY fila ORDER BY p) AS a FROM k)
SELECT fila, seccion, max(CASE WHEN t THEN substring(l, 4) END) AS titulo, count(*) FILTER (WHERE NOT t) AS pasos FROM s WHERE t OR a IS NULL OR a <> l GROUP BY 1, 2""")
def text_sections(t):
    return quality.sections(t.fragmentos.where("texto is not null"), "fila", "texto")


def _sound(c: str) -> str:
    """The sound of a word: letters that sound alike written alike, doubles once."""
    for a, b in (("qu", "k"), ("ce", "se"), ("ci", "si"), ("ch", "x"), ("c", "k"), ("ll", "y"), ("h", ""), ("v", "b"), ("z", "s"), ("ge", "je"), ("gi", "ji")):
        c = f"replace({c}, '{a}', '{b}')"
    for x in "abdefgijklmnopqrstuwxy":
        c = f"regexp_replace({c}, '{x}{x}+', '{x}', 'g')"
    return c


@query(f"""WITH v AS (SELECT w AS word, {_sound("w")} AS s, count(*) AS df FROM (SELECT unnest(list_distinct({tokens_sql("text")})) AS w FROM documents) WHERE regexp_full_match(w, '\\p{{L}}{{4,}}') GROUP BY 1, 2),
b AS (SELECT s, arg_max(word, (df, word)) AS correcta, max(df) AS b FROM v WHERE df >= 3 GROUP BY 1) SELECT word, correcta FROM v JOIN b USING (s) WHERE word <> correcta AND df < b""")
def spelling_by_sound(t):
    w = t.documents.select("doc_id", F.explode(F.array_distinct(analysis.tokens(F.col("text")))).alias("word")).where(F.col("word").rlike(r"^\p{L}{4,}$"))
    return quality.same_sound(w.groupBy("word").agg(F.count(F.lit(1)).alias("df")))


@query(f"""WITH v AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct({tokens_sql("text")})) AS w FROM documents) WHERE regexp_full_match(w, '\\p{{L}}{{4,}}') GROUP BY 1),
p AS (SELECT r.w AS raro, c.w AS vecino, damerau_levenshtein(r.w, c.w)::INT AS d, c.df FROM v r, v c WHERE r.df < 3 AND c.df >= 10 * r.df AND abs(length(r.w) - length(c.w)) <= 2 AND damerau_levenshtein(r.w, c.w) BETWEEN 1 AND 2),
k AS (SELECT *, row_number() OVER (PARTITION BY raro ORDER BY d, df DESC, vecino)::INT AS r FROM p WHERE d = 1 OR length(raro) >= 8) SELECT raro, vecino, d, r, 0.7 AS peso FROM k WHERE r <= 2""")
def fuzzy_terms(t):
    """Rare words and their two closest frequent ones: nearest first, then most frequent, then by name."""
    w = t.documents.select("doc_id", F.explode(F.array_distinct(analysis.tokens(F.col("text")))).alias("w"))
    return spelling.expansions(w.groupBy("w").agg(F.count(F.lit(1)).alias("df")))


@query()
def corrected_words(t):
    w = t.documents.select("doc_id", F.explode(F.array_distinct(analysis.tokens(F.col("text")))).alias("word"))
    return spelling.corrections(w.groupBy("word").agg(F.count(F.lit(1)).alias("df")))


@query("""WITH s AS (SELECT vec_id AS id, (vec_id % 41) / 40.0 AS a, (vec_id % 37) / 36.0 AS b, (vec_id % 29) / 28.0 AS c FROM embeddings)
SELECT id, round(0.5 * a + 0.3 * b + 0.2 * c, 9) AS puntaje, CASE WHEN a >= 0.8 AND b >= 0.7 AND c >= 0.5 AND round(0.5 * a + 0.3 * b + 0.2 * c, 9) >= 0.8 THEN 'aceptada'
WHEN round(0.5 * a + 0.3 * b + 0.2 * c, 9) >= 0.65 THEN 'revision' ELSE 'rechazada' END AS veredicto FROM s""")
def rubric_verdicts(t):
    s = t.embeddings.select(F.col("vec_id").alias("id"), *[((F.col("vec_id") % (n + 1)) / F.lit(float(n))).alias(c) for c, n in (("a", 40), ("b", 36), ("c", 28))])
    return routing.rubric(s, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.8, "b": 0.7, "c": 0.5})


@query(f"""WITH {_NEAR}, lex AS ({bm25_sql(10)}), x AS (SELECT qid, doc_id, 'coseno:' || rank AS m FROM vec WHERE rank <= 10 UNION ALL SELECT qid, doc_id, 'lexico:' || rank FROM lex)
SELECT qid, doc_id, string_agg(m, ',' ORDER BY m) AS metodos FROM x GROUP BY 1, 2""")
def pooled_judgments(t):
    lex, vec = _lists(t, 10)
    return quality.pooled({"coseno": vec, "lexico": lex})


_SETTINGS = [(0.9, 0.4), (1.2, 0.75), (1.6, 0.75)]


@query(" UNION ALL ".join(f"SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, qid, doc_id, score, rank FROM ({bm25_sql(10, k1, b)})" for k1, b in _SETTINGS))
def bm25_sweep(t):
    """The ranking under several constants from one index."""
    index = retrieval.build(t.documents, {"texto": F.col("text")}, _roots, _questions(t))
    return retrieval.sweep(index, _questions(t), _SETTINGS, analyzer=_roots).select("k1", "b", "qid", "doc_id", "score", "rank")


@query("""WITH s AS (SELECT source, sqrt(sum(coalesce(n_chars, 0))) AS r FROM documents WHERE source IS NOT NULL GROUP BY 1), x AS (SELECT source, (500 - count(*) OVER ()) * r / sum(r) OVER () AS x, count(*) OVER () AS n FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 6) DESC, source) AS k, 500 - n - sum(floor(x)) OVER () AS resto FROM x) SELECT source, (1 + floor(x) + (k <= resto)::INT)::BIGINT AS cupo FROM k""")
def proportional_quota(t):
    sizes = t.documents.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("n"))
    return sampling.proportional(sizes, "source", "n", 500)


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS clase, i, sum(x) AS s FROM e GROUP BY 1, 2),
d AS (SELECT vec_id, label, clase, sum(x * (s - CASE WHEN label = clase THEN x ELSE 0 END)) AS p, sqrt(sum((s - CASE WHEN label = clase THEN x ELSE 0 END) ** 2)) AS n FROM e JOIN c USING (i) GROUP BY 1, 2, 3),
r AS (SELECT vec_id, label, clase, round(p / n, 6) AS nota, row_number() OVER (PARTITION BY vec_id ORDER BY round(p / n, 6) DESC, clase) AS k FROM d WHERE n > 1e-9)
SELECT vec_id AS doc_id, clase, nota FROM r WHERE k = 1""")
def leave_one_out(t):
    """The closest class of every vector when its own vector is taken out of its class."""
    base, _ = _vectors(t)
    return vectors.leave_one_out(base)


@query("""SELECT n_regionkey AS region, n_name AS nodo FROM nation EXCEPT SELECT r_regionkey, r_name FROM region""")
def class_difference(t):
    return t.nation.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nodo")).subtract(t.region.select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("nodo")))
