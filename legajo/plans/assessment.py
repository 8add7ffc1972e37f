"""Retrieval from the stored index, fragments, layout, traces, evaluation and the question bank over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions import analysis
from legajo.operators import bank, classify, evaluation, fragments, layout, lexical, maintenance, retrieval, routing, sampling, spelling, traces, vectors
from legajo.plans.registry import query
from legajo.plans.relational import _JUDGED, _judged
from legajo.plans.textual import _COMPACT, _NEAR, _PLAIN, _ROOTS, _lists, _questions, _roots, _strip, _vectors, bm25_sql

# --- retrieval -------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND b.label = 3)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 10""")
def cosine_filtered(t):
    base, q = _vectors(t)
    return vectors.cosine_topk(base, q, allowed=F.col("label") == 3)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS k FROM s), d AS (SELECT qid, doc_id // 4 AS d, min(k) AS k, arg_min(score, k) AS score FROM r WHERE k <= 30 GROUP BY 1, 2)
SELECT qid, d AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k)::INT AS rank FROM d) WHERE rank <= 10""")
def best_chunk_topk(t):
    """Four neighbouring numbers are the chunks of one document."""
    base, q = _vectors(t)
    return retrieval.best_chunks(vectors.cosine_topk(base.drop("label"), q, 30), F.floor(F.col("doc_id") / 4), 10)


_SHORT = f"(SELECT id, coalesce(nullif({_COMPACT}, ''), {_strip('prompt')}) AS prompt FROM linea_base)"


@query(f"""WITH g AS ({bm25_sql(10)}), o AS ({bm25_sql(20, where="source = 'guias-pdf'")}), c AS ({bm25_sql(10).replace("FROM linea_base", f"FROM {_SHORT}")}), k AS ({bm25_sql(8, where="source = 'portal-ayuda'")}),
u AS (SELECT qid, doc_id, 0 AS i, rank, 'oficial' AS pase FROM o UNION ALL SELECT qid, doc_id, 1, rank, 'general' FROM g UNION ALL SELECT qid, doc_id, 2, rank, 'compacta' FROM c UNION ALL SELECT qid, doc_id, 3, rank, 'curada' FROM k),
m AS (SELECT qid, doc_id, min((i, rank, pase)) AS x FROM u GROUP BY 1, 2)
SELECT qid, doc_id, x[3] AS pase, row_number() OVER (PARTITION BY qid ORDER BY x[1], x[2], doc_id)::INT AS orden FROM m""")
def multi_pass(t):
    """Official documents first, then all, then all by the compact question, then a curated source."""
    index = retrieval.build(t.documents, {"texto": F.col("text")}, _roots)
    q = _questions(t)
    of = lambda s: t.documents.where(F.col("source") == s).select("doc_id")
    run = lambda q, k, allowed=None: retrieval.search(index, q, k, analyzer=_roots, allowed=allowed)
    return retrieval.passes([("oficial", run(q, 20, of("guias-pdf")), 20), ("general", run(q, 10), 10), ("compacta", run(q.withColumn("query", routing.compact(F.col("query"))), 10), 10), ("curada", run(q, 8, of("portal-ayuda")), 8)])


@query(f"""WITH r AS ({bm25_sql(10)}) SELECT a.qid, round((a.score - b.score) / a.score, 9) AS margen, coalesce(round((a.score - b.score) / a.score, 9) < 0.1, false) AS reordenar FROM r a LEFT JOIN r b ON b.qid = a.qid AND b.rank = 2 WHERE a.rank = 1""")
def cascade_flags(t):
    index = retrieval.build(t.documents, {"texto": F.col("text")}, _roots)
    return retrieval.cascade(retrieval.search(index, _questions(t), 10, analyzer=_roots))


@query(f"""WITH {_NEAR}, r AS (SELECT qid, doc_id, rank, (doc_id % 41 - 20) / 5.0 AS logit FROM vec), i AS (SELECT *, rank <= 20 AND doc_id % 9 <> 0 AS dentro FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dentro DESC, CASE WHEN dentro THEN -logit END, rank)::INT AS nuevo FROM i)
SELECT n.qid, doc_id, rank, CASE WHEN dentro THEN round(1 / (1 + exp(-logit)), 9) END AS puntaje, nuevo, coalesce(e.empate, false) AS empate FROM n LEFT JOIN
(SELECT a.qid, a.logit - b.logit < ln(0.6 / 0.4) AS empate FROM n a JOIN n b ON a.qid = b.qid AND a.nuevo = 1 AND b.nuevo = 2 AND a.dentro AND b.dentro) e ON e.qid = n.qid""")
def class_rerank(t):
    base, q = _vectors(t)
    near = vectors.cosine_topk(base.drop("label"), q, 50)
    logits = near.where("doc_id % 9 <> 0").select("qid", "doc_id", ((F.col("doc_id") % 41 - 20) / F.lit(5.0)).alias("logit"))
    return retrieval.class_rerank(near, logits)


_COVER = f"""have AS (SELECT DISTINCT doc_id, unnest({_ROOTS}) AS term FROM documents), q AS (SELECT DISTINCT id AS qid, unnest({_ROOTS.replace("lower(text)", "lower(prompt)")}) AS term FROM linea_base WHERE id % 50 = 0),
dfs AS (SELECT term, count(*) AS df FROM have SEMI JOIN q USING (term) GROUP BY 1), w AS (SELECT qid, term, ln(1 + ((SELECT count(*) FROM documents) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM q LEFT JOIN dfs USING (term)),
cover AS (SELECT qid, doc_id, round(sum(idf) / any_value(todo), 6) AS cobertura FROM have JOIN w USING (term) JOIN (SELECT qid, sum(idf) AS todo FROM w GROUP BY 1) USING (qid) GROUP BY 1, 2)"""


@query(f"""WITH {_COVER} SELECT qid, doc_id, cobertura, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cobertura DESC, doc_id)::INT AS rank FROM cover) WHERE rank <= 10""")
def coverage_topk(t):
    return lexical.coverage_topk(t.documents, F.col("text"), _questions(t), analyzer=_roots)


@query(f"""WITH {_NEAR}, {_COVER}, lex AS ({bm25_sql(30)}), z AS (SELECT qid, doc_id, lex.rank AS r1, v.rank AS r2, v.score AS s FROM lex FULL OUTER JOIN (SELECT * FROM vec WHERE rank <= 30) v USING (qid, doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0), 9) DESC, least(coalesce(r1, 999), coalesce(r2, 999)), doc_id)::INT AS rank FROM z)
SELECT qid, doc_id, round(CASE WHEN s IS NULL THEN coalesce(cobertura, 0) ELSE 0.5 * coalesce(cobertura, 0) + 0.5 * greatest(0, s) END, 6) AS puntaje, rank FROM f LEFT JOIN cover USING (qid, doc_id) WHERE rank <= 10""")
def class_retrieval(t):
    lex, vec = _lists(t, 50)
    pairs = lex.unionByName(vec).where("rank <= 30")
    return retrieval.class_retrieval(lex, vec, lexical.coverage(t.documents, F.col("text"), _questions(t), analyzer=_roots, among=pairs))


@query(f"""WITH lex AS ({bm25_sql(30)}), {_NEAR}, z AS (SELECT qid, doc_id, lex.rank AS r1, vec.rank AS r2 FROM lex FULL OUTER JOIN vec USING (qid, doc_id)),
f AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(1.0 / (60 + r1), 0) + coalesce(0.1 / (60 + r2), 0), 9) DESC, least(coalesce(r1, 999), coalesce(r2, 999)), doc_id) AS rank FROM z),
u AS (SELECT qid, doc_id, min((i, rank)) AS x FROM (SELECT qid, doc_id, 0 AS i, rank FROM f WHERE rank <= 10 UNION ALL SELECT qid, doc_id, 1, rank FROM lex) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'es') GROUP BY 1, 2)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY x, doc_id)::INT AS orden FROM u""")
def eligible_topk(t):
    lex, vec = _lists(t, 50)
    return retrieval.eligible_first(retrieval.hybrid(lex.where("rank <= 30"), vec), lex.where("rank <= 30"), t.documents.where("lang = 'es'").select("doc_id"))


_BOOST = bm25_sql(10).replace("left(x, 5)", "left(x, 7)").replace("* s * 2.2 / (1.2 + s)), 6)", "* s * 2.2 / (1.2 + s)) * any_value(CASE WHEN doc_id IN (SELECT doc_id FROM documents WHERE source = 'guias-pdf') THEN 1.15 ELSE 1 END), 6)")


@query(_BOOST)
def bm25_boost(t):
    """Roots of seven letters, documents of the official source count 15 % more."""
    seven = lambda c: analysis.roots(c, 7)
    index = retrieval.build(t.documents, {"texto": F.col("text")}, seven)
    return retrieval.search(index, _questions(t), analyzer=seven, boost=t.documents.where("source = 'guias-pdf'").select("doc_id", F.lit(1.15).alias("factor")))


# --- words -------------------------------------------------------------------------------------------------------------

_KEY = "coalesce(nullif(trim(regexp_replace(regexp_replace({p}, '[^a-z0-9[:space:]]', ' ', 'g'), '[[:space:]]+', ' ', 'g')), ''), trim(coalesce({c}, '')))"


def _key_sql(c: str) -> str:
    return _KEY.replace("{p}", _PLAIN.format(c)).replace("{c}", c)


@query(f"SELECT id, {_key_sql('prompt')} AS clave FROM linea_base")
def duplicate_keys(t):
    return t.linea_base.select("id", F.coalesce(spelling.key_form(F.col("prompt")), F.lit("")).alias("clave"))


@query("SELECT id, (" + " OR ".join(["regexp_matches(s, '[àãõç]')", *[f"contains(s, '{w}')" for w in spelling.PORTUGUESE]]) + ") AS portugues FROM (SELECT id, lower(' ' || respuesta || ' ') AS s FROM linea_base WHERE respuesta IS NOT NULL)")
def portuguese_leaks(t):
    return t.linea_base.where("respuesta is not null").select("id", spelling.leaks_portuguese(F.col("respuesta")).alias("portugues"))


_NAMES = [("caja chica", "tesoreria"), ("caja", "compras"), ("orden de compra", "compras"), ("línea de base", "planes"), ("base", "datos"), ("almacén central", "almacen"), ("almacén", "almacen")]


def _alias_sql() -> str:
    values = ", ".join(f"('{a}', '{d}')" for a, d in _NAMES)
    return f"""WITH n AS (SELECT a AS alias, d AS destino, {_key_sql('a')} AS k FROM (VALUES {values}) v(a, d)), t AS (SELECT id, ' ' || {_key_sql('prompt')} || ' ' AS t FROM linea_base WHERE prompt IS NOT NULL),
h AS (SELECT id, alias, destino, instr(t, ' ' || k || ' ') AS desde, length(k) AS largo FROM t, n WHERE contains(t, ' ' || k || ' '))
SELECT id, alias, destino, desde FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.id = a.id AND (b.largo > a.largo OR (b.largo = a.largo AND (b.desde < a.desde OR (b.desde = a.desde AND b.alias < a.alias)))) AND b.desde < a.desde + a.largo + 1 AND a.desde < b.desde + b.largo + 1)"""


@query(_alias_sql())
def alias_hits(t):
    names = t.spark.createDataFrame(_NAMES, "alias string, destino string")
    return spelling.aliases(t.linea_base.where("prompt is not null").select("id", F.col("prompt").alias("texto")), names)


@query(f"WITH h AS ({_alias_sql()}) SELECT id, min(destino) AS destino FROM h GROUP BY id HAVING count(DISTINCT destino) = 1")
def alias_targets(t):
    names = t.spark.createDataFrame(_NAMES, "alias string, destino string")
    return spelling.single_target(spelling.aliases(t.linea_base.where("prompt is not null").select("id", F.col("prompt").alias("texto")), names))


@query()
def spelling_variants(t):
    return spelling.variants(t.linea_base.where("prompt is not null").select("id", F.col("prompt").alias("texto")))


@query()
def wording_similarity(t):
    """Similarity of each prompt with the prompt of the next number."""
    a, b = t.linea_base.select("id", "prompt"), t.linea_base.select((F.col("id") - 1).alias("id"), F.col("prompt").alias("otro"))
    return a.join(b, "id").select("id", F.round(spelling.similarity(F.col("prompt"), F.col("otro")), 6).alias("parecido"))


# --- fragments -----------------------------------------------------------------------------------------------------------


@query()
def numbered_sections(t):
    return fragments.text_sections(t.fragmentos.where("texto is not null"), "fila", "texto").select("fila", "n", "titulo", F.size("pasos").alias("pasos"))


@query(r"""WITH l AS (SELECT fila, unnest(regexp_split_to_array(texto, '\r\n|[\n\r\f]')) AS l, generate_subscripts(regexp_split_to_array(texto, '\r\n|[\n\r\f]'), 1) AS p FROM fragmentos WHERE texto IS NOT NULL),
f AS (SELECT fila, p, regexp_extract(l, '^\s*((\d+(\.\d+){0,2})[.)]?\s+[A-ZÁÉÍÓÚÑ][^\n]{3,70})\s*$', 1) AS t FROM l), g AS (SELECT fila, p, trim(regexp_replace(t, '[ .]{3,}\s*\d+$', '')) AS titulo FROM f WHERE t <> ''),
k AS (SELECT fila, lower(titulo) AS c, min(p) AS p, arg_min(titulo, p) AS titulo FROM g WHERE length(titulo) >= 6 GROUP BY 1, 2)
SELECT fila, n, titulo FROM (SELECT fila, row_number() OVER (PARTITION BY fila ORDER BY p)::INT AS n, titulo FROM k) WHERE n <= 25""")
def table_of_contents(t):
    return fragments.contents(t.fragmentos.where("texto is not null"), "fila", "texto")


@query(rf"""WITH s AS (SELECT fila, titulo, array_to_string(list_transform(list_filter(regexp_split_to_array(texto, '\r\n|[\n\r\f]'), lambda x: length({_strip("x")}) > 40 AND NOT starts_with(x, '#') AND NOT starts_with(x, 'Fuente:') AND NOT contains(x, titulo)), lambda x: {_strip("x")}), ' ') AS s FROM fragmentos WHERE texto IS NOT NULL AND titulo IS NOT NULL)
SELECT fila, CASE WHEN length(s) > 280 THEN CASE WHEN contains(left(s, 280), ' ') THEN regexp_replace(left(s, 280), '(?s) [^ ]*$', '') ELSE left(s, 280) END || '…' WHEN s = '' THEN 'Manual oficial: ' || titulo || '.' ELSE s END AS resumen FROM s""")
def extractive_summary(t):
    return t.fragmentos.where("texto is not null and titulo is not null").select("fila", fragments.summary(F.col("texto"), F.col("titulo")).alias("resumen"))


@query(f"""WITH p AS (SELECT *, list_transform(string_split(titulo, '›'), lambda x: {_strip("x")}) AS ps FROM fragmentos)
SELECT fila, ps[1] AS titulo, coalesce(nullif({_strip("seccion")}, ''), CASE WHEN len(ps) > 1 THEN ps[-1] END) AS seccion, CASE WHEN tipo IS DISTINCT FROM 'imagen' THEN texto END AS texto, CASE WHEN tipo = 'imagen' THEN texto END AS ocr, coalesce(nullif({_strip("manual")}, ''), ps[1]) AS manual FROM p""")
def index_fields(t):
    return fragments.index_fields(t.fragmentos)


@query(f"""SELECT fila, CASE WHEN length(s) > 120 THEN left(s, 119) || '…' ELSE s END AS corto FROM (SELECT fila, {_strip("regexp_replace(texto, '[[:space:]]+', ' ', 'g')")} AS s FROM fragmentos WHERE texto IS NOT NULL)""")
def clipped_texts(t):
    return t.fragmentos.where("texto is not null").select("fila", fragments.squeezed(F.col("texto"), 120).alias("corto"))


@query(f"""WITH n AS (SELECT fila, id, lower({_strip("regexp_replace(fuente, '[[:space:]]+', ' ', 'g')")}) AS c, lower({_strip("regexp_replace(nullif(" + _strip("titulo") + ", '') || ':' || coalesce(pagina, ''), '[[:space:]]+', ' ', 'g')")}) AS t FROM fragmentos)
SELECT fila, coalesce(nullif(c, ''), nullif(t, ''), id) AS clave FROM n""")
def citation_keys(t):
    return t.fragmentos.select("fila", fragments.citation_key(F.col("fuente"), F.col("titulo"), F.col("pagina"), F.col("id")).alias("clave"))


@query("""SELECT event_id, regexp_extract('antes ' || props || ' {sin cierre', '(\\{[^{}]*\\})', 1) AS objeto FROM events WHERE props IS NOT NULL""")
def embedded_json(t):
    return t.events.where("props is not null").select("event_id", fragments.json_in(F.concat(F.lit("antes "), F.col("props"), F.lit(" {sin cierre"))).alias("objeto"))


# --- layout: words of the fragments laid out as if each word were as wide as its letters -----------------------------------

_WORDS = r"""WITH w AS (SELECT fila AS pagina, unnest(list_filter(string_split(titulo, ' '), lambda x: x <> '')) AS texto, generate_subscripts(list_filter(string_split(titulo, ' '), lambda x: x <> ''), 1) AS n FROM fragmentos WHERE titulo IS NOT NULL)"""


@query(_WORDS + """, x AS (SELECT pagina, n, texto, (n % 3) * 100.0 AS x0, (n % 3) * 100.0 + length(texto) AS x1 FROM w), r AS (SELECT a.pagina, a.n AS desde, k.k AS n FROM w a, range(1, 7) k(k) WHERE EXISTS (SELECT 1 FROM w b WHERE b.pagina = a.pagina AND b.n = a.n + k.k - 1))
SELECT r.pagina, 1 AS linea, r.desde::INT AS desde, r.n::INT AS n, string_agg(x.texto, ' ' ORDER BY x.n) AS texto, min(x0)::DOUBLE AS x0, max(x1)::DOUBLE AS x1 FROM r JOIN x ON x.pagina = r.pagina AND x.n BETWEEN r.desde AND r.desde + r.n - 1 GROUP BY 1, 2, 3, 4""")
def word_runs(t):
    w = t.fragmentos.where("titulo is not null").select(F.col("fila").alias("pagina"), F.posexplode(F.filter(F.split("titulo", " "), lambda x: x != "")).alias("n", "texto")).withColumn("n", F.col("n") + 1)
    x0 = (F.col("n") % 3) * F.lit(100.0)
    return layout.word_runs(w.select("pagina", F.lit(1).alias("linea"), "n", x0.alias("x0"), (x0 + F.length("texto")).alias("x1"), "texto"))


@query(_WORDS + """, x AS (SELECT pagina, texto, (n // 4) * 20.0 + (n % 3) AS y0, (n % 4) * 100.0 AS x0 , n // 4 AS l FROM w)
SELECT pagina, row_number() OVER (PARTITION BY pagina ORDER BY min(y0)) AS linea, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x0 + length(texto))::DOUBLE AS x1, max(y0 + 10)::DOUBLE AS y1, string_agg(texto, ' ' ORDER BY x0) AS texto FROM x GROUP BY pagina, l""")
def text_lines(t):
    w = t.fragmentos.where("titulo is not null").select(F.col("fila").alias("pagina"), F.posexplode(F.filter(F.split("titulo", " "), lambda x: x != "")).alias("n", "texto")).withColumn("n", F.col("n") + 1)
    y0, x0 = F.floor(F.col("n") / 4) * F.lit(20.0) + F.col("n") % 3, (F.col("n") % 4) * F.lit(100.0)
    return layout.lines(w.select("pagina", x0.alias("x0"), y0.alias("y0"), (x0 + F.length("texto")).alias("x1"), (y0 + 10).alias("y1"), "texto"))


@query(r"""SELECT fila, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$') THEN 'fecha' WHEN regexp_matches(t, '^(?:S/|\$|€)?\s*-?\d{1,3}(?:,\d{3})*\.\d{2}$') THEN 'monto' WHEN regexp_matches(t, '^-?\d+$') THEN 'numero'
WHEN regexp_matches(t, '^[A-Z]{1,4}-?\d+[\w.-]*$|^\d+(?:\.\d+)+$') THEN 'codigo' ELSE 'texto' END AS clase FROM (SELECT fila, trim(pagina, ' ') AS t FROM fragmentos WHERE pagina IS NOT NULL)""")
def field_kinds(t):
    return t.fragmentos.where("pagina is not null").select("fila", layout.field_kind(F.col("pagina")).alias("clase"))


# --- traces ----------------------------------------------------------------------------------------------------------------

_TRACES = """(SELECT user_id AS id, list({'tipo': event_type, 'instrucciones': CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN 'ver ' || event_id END, 'confianza': CASE WHEN event_id % 4 > 0 THEN (event_id % 97) / 97.0 END} ORDER BY event_id) AS preguntas,
CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 2 = 0 END AS correcta, 'm' || user_id % 3 AS modelo FROM events GROUP BY user_id)"""


def _traces(t):
    q = F.struct("event_id", F.col("event_type").alias("tipo"), F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, F.concat(F.lit("ver "), F.col("event_id").cast("string"))).alias("instrucciones"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 97) / F.lit(97.0)).alias("confianza"))
    g = t.events.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(q)).alias("preguntas"))
    return g.select("id", "preguntas", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2 == 0).alias("correcta"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("modelo"), F.lit("").alias("estado"))


@query(f"""SELECT id, len(preguntas)::INT AS n_preguntas, array_to_string(list_sort(list_distinct(list_transform(preguntas, lambda p: p.tipo))), ',') AS tipos, round(list_avg(list_filter(list_transform(preguntas, lambda p: p.confianza), lambda c: c IS NOT NULL)), 3) AS confianza,
coalesce(list_filter(list_transform(preguntas, lambda p: trim(p.instrucciones)), lambda x: x IS NOT NULL AND x <> '')[1], 'traza sin instrucciones') AS titulo FROM {_TRACES}""")
def trace_summaries(t):
    return traces.summaries(_traces(t))


@query(f"SELECT id FROM {_TRACES} WHERE modelo = 'm1' AND correcta = false AND len(list_filter(preguntas, lambda p: p.tipo = 'click')) > 0 AND len(list_filter(preguntas, lambda p: p.instrucciones LIKE '%ver 1%')) > 0")
def trace_filter(t):
    return traces.matching(_traces(t), text="VER 1", kind="click", model="m1", failed=True).select("id")


@query(f"SELECT modelo, count(correcta) AS evaluadas, count(*) FILTER (WHERE correcta) AS aciertos, round(100 * count(*) FILTER (WHERE correcta) / count(correcta), 1) AS pct FROM {_TRACES} GROUP BY 1")
def trace_hits(t):
    return traces.hit_rate(_traces(t), "modelo", "correcta")


@query("SELECT event_type, q, quantile_disc(value, q) AS valor FROM events, (VALUES (0.5), (0.9), (0.95)) v(q) GROUP BY event_type, q".replace("quantile_disc(value, q)", "CASE q WHEN 0.5 THEN quantile_disc(value, 0.5) WHEN 0.9 THEN quantile_disc(value, 0.9) ELSE quantile_disc(value, 0.95) END"))
def trace_percentiles(t):
    return traces.rank_percentiles(t.events, "event_type", "value", [0.5, 0.9, 0.95])


@query()
def trace_limits(t):
    f = t.fragmentos.where("manual is not null and texto is not null").groupBy(F.col("documento").alias("id")).agg(F.array_sort(F.collect_list("texto")).alias("fragmentos"))
    return traces.limited(f.select("id", "fragmentos", F.slice("fragmentos", 1, 200).alias("descartados"))).select("id", F.size("fragmentos").alias("fragmentos"), F.size("descartados").alias("descartados"), "truncada")


# --- evaluation ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH j AS {_JUDGED}, c AS (SELECT DISTINCT real AS clase FROM j), n AS (SELECT (SELECT count(*) FROM j WHERE real = clase AND dicho = clase) AS vp, (SELECT count(*) FROM j WHERE dicho = clase) AS d, (SELECT count(*) FROM j WHERE real = clase) AS r FROM c)
SELECT round(avg(round(2 * vp / (d + r), 9)), 9) AS macro_f1, count(*) AS clases FROM n""")
def macro_f1(t):
    return evaluation.macro_f1(evaluation.prf(_judged(t), "real", "dicho"))


_CURVE = f"""j AS (SELECT round(p, 4) AS p, (real = dicho)::INT AS h FROM {_JUDGED}), u AS (SELECT DISTINCT p AS umbral FROM j UNION SELECT 0.0),
c AS (SELECT umbral, round(count(p) / (SELECT count(*) FROM j), 9) AS cobertura, round(sum(h) / count(p), 9) AS precision, coalesce(sum(h), 0) - 1.0 * (count(p) - coalesce(sum(h), 0)) AS utilidad FROM u LEFT JOIN j ON p >= umbral GROUP BY 1)"""


@query(f"WITH {_CURVE} SELECT umbral, cobertura, precision, utilidad FROM c ORDER BY utilidad DESC, umbral LIMIT 1")
def best_threshold(t):
    return evaluation.best_threshold(evaluation.thresholds(_judged(t), "real", "dicho", "p"))


@query(f"WITH {_CURVE} SELECT umbral, cobertura, precision FROM c WHERE precision >= 0.79 ORDER BY cobertura DESC, umbral LIMIT 1")
def target_precision(t):
    return evaluation.target_point(evaluation.thresholds(_judged(t), "real", "dicho", "p"), 0.79)


@query(f"""WITH j AS {_JUDGED}, o AS (SELECT vuelta, real, dicho, p, row_number() OVER (PARTITION BY vuelta, real ORDER BY md5(vuelta || ':' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY vuelta, real) AS n FROM j, range(10) r(vuelta)),
h AS (SELECT vuelta, (k <= n // 2)::INT AS mitad, (real = dicho)::INT AS h, p, round(p, 4) AS q FROM o), u AS (SELECT DISTINCT vuelta, mitad, q AS umbral FROM h UNION SELECT DISTINCT vuelta, mitad, 0.0 FROM h),
c AS (SELECT u.vuelta, u.mitad, umbral, coalesce(sum(h), 0) - (count(q) - coalesce(sum(h), 0)) AS utilidad FROM u LEFT JOIN h ON h.vuelta = u.vuelta AND h.mitad = u.mitad AND q >= umbral GROUP BY 1, 2, 3),
b AS (SELECT vuelta, mitad, arg_min(umbral, (-utilidad, umbral)) AS umbral FROM c GROUP BY 1, 2)
SELECT b.vuelta::INT AS vuelta, b.mitad, b.umbral, round(avg((p >= umbral)::INT), 9) AS cobertura, round(count(*) FILTER (WHERE p >= umbral AND h = 1) / nullif(count(*) FILTER (WHERE p >= umbral), 0), 9) AS precision FROM b JOIN h ON h.vuelta = b.vuelta AND h.mitad = 1 - b.mitad GROUP BY 1, 2, 3""")
def cross_calibration(t):
    return evaluation.cross_calibrated(_judged(t), "vec_id", "real", "dicho", "p")


_SCORES = "(SELECT vec_id AS id, clase, ((vec_id * 7 + clase * 13) % 101) / 101.0 AS nota FROM embeddings, range(10) r(clase))"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nota DESC, clase) AS k FROM {_SCORES}), c AS (SELECT r.id, min(CASE WHEN clase = label AND k <= 3 THEN k END) AS p, max(CASE WHEN k = 1 THEN nota END) - max(CASE WHEN k = 2 THEN nota END) AS m FROM r JOIN embeddings ON vec_id = r.id GROUP BY 1)
SELECT count(*) AS casos, round(avg(coalesce(p = 1, false)::INT), 9) AS exactitud, round(avg(coalesce(p <= 3, false)::INT), 9) AS en_n, round(avg(m), 6) AS margen FROM c""")
def top_three(t):
    s = t.embeddings.select(F.col("vec_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("clase")).withColumn("nota", ((F.col("id") * 7 + F.col("clase") * 13) % 101) / F.lit(101.0))
    return evaluation.top_n(s, t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("real")))


@query(f"""WITH j AS {_JUDGED}, n AS (SELECT real, dicho, count(*) AS n FROM j WHERE real <> dicho GROUP BY 1, 2) SELECT real, dicho, n, round(n / (SELECT count(*) FROM j WHERE j.real = n.real), 9) AS parte FROM n ORDER BY n DESC, real, dicho LIMIT 10""")
def top_confusions(t):
    return evaluation.confusions(_judged(t), "real", "dicho")


@query(r"""WITH w AS (SELECT id, prompt, respuesta, list_distinct(regexp_extract_all(strip_accents(lower(respuesta)), '[\p{L}\p{N}]+')) AS a, coalesce(list_distinct(regexp_extract_all(strip_accents(lower(prompt)), '[\p{L}\p{N}]+')), []) AS p FROM linea_base)
SELECT id, coalesce(len(a) = 0, true) AS vacia, coalesce(round(len(list_intersect(a, p)) / nullif(len(a), 0), 9), 0) AS copia, round(length(coalesce(respuesta, '')) / nullif(length(prompt), 0), 9) AS largo FROM w""")
def answer_checks(t):
    return evaluation.generation_checks(t.linea_base, "prompt", "respuesta").select("id", "vacia", "copia", "largo")


_CONDITIONS = "(SELECT lang, length(text) > 500 AS largo, n_chars = length(text) AS cuenta, source IS NOT NULL AS fuente FROM documents)"


@query(" UNION ALL ".join(f"SELECT {g} AS lang, '{c}' AS condicion, count(*) FILTER (WHERE {c}) AS si, count({c}) AS total, round(count(*) FILTER (WHERE {c}) / count({c}), 9) AS parte FROM {_CONDITIONS} {w} GROUP BY 1 HAVING count({c}) > 0" for c in ("largo", "cuenta", "fuente") for g, w in (("lang", "WHERE lang IS NOT NULL"), ("NULL", ""))))
def condition_rates(t):
    d = t.documents.select("lang", (F.length("text") > 500).alias("largo"), (F.col("n_chars") == F.length("text")).alias("cuenta"), F.col("source").isNotNull().alias("fuente"))
    return evaluation.proportions(d, "lang", ["largo", "cuenta", "fuente"])


@query(f"""WITH j AS {_JUDGED}, a AS (SELECT round(avg((real = dicho)::INT), 9) AS x, round(avg((p < 0.3)::INT), 9) AS i FROM j WHERE vec_id % 2 = 0), b AS (SELECT round(avg((real = dicho)::INT), 9) AS x, round(avg((p < 0.3)::INT), 9) AS i FROM j WHERE vec_id % 2 = 1)
SELECT a.x AS exito_antes, b.x AS exito, a.i AS invencion_antes, b.i AS invencion, b.x > a.x AND b.i <= a.i AS pasa FROM a, b""")
def change_verdict(t):
    j = _judged(t).withColumn("ok", F.col("real") == F.col("dicho")).withColumn("inv", F.col("p") < 0.3)
    return evaluation.verdict(j.where("vec_id % 2 = 0"), j.where("vec_id % 2 = 1"), "ok", "inv")


@query("""WITH p AS (SELECT l_orderkey AS caso, l_linenumber AS n, m FROM lineitem, range(1, 8) r(m) WHERE (l_partkey + m) % 3 = 0)
SELECT caso, n::BIGINT AS n, m::BIGINT AS m FROM (WITH RECURSIVE k AS (SELECT caso, min(n) - 1 AS n, 0::BIGINT AS m FROM p GROUP BY 1 UNION ALL
SELECT k.caso, (SELECT min(q.n) FROM p q WHERE q.caso = k.caso AND q.n > k.n AND q.m > k.m), (SELECT min(q.m) FROM p q WHERE q.caso = k.caso AND q.m > k.m AND q.n = (SELECT min(z.n) FROM p z WHERE z.caso = k.caso AND z.n > k.n AND z.m > k.m)) FROM k WHERE EXISTS (SELECT 1 FROM p q WHERE q.caso = k.caso AND q.n > k.n AND q.m > k.m))
SELECT * FROM k WHERE m > 0)""")
def step_alignment(t):
    p = t.lineitem.select(F.col("l_orderkey").alias("caso"), F.col("l_linenumber").alias("n"), "l_partkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("m")).where("(l_partkey + m) % 3 = 0")
    return evaluation.aligned(p.select("caso", "n", "m"))


@query("SELECT vec_id, round(0 * ((vec_id % 5) / 10.0) + 1 * ((vec_id % 7) / 14.0) + 2 * ((vec_id % 3) / 9.0), 9) AS nivel FROM embeddings")
def expected_levels(t):
    p = F.array(*[(F.col("vec_id") % n) / F.lit(float(m)) for n, m in ((5, 10), (7, 14), (3, 9))])
    return t.embeddings.select("vec_id", p.alias("p")).select("vec_id", F.round(evaluation.expected_level("p"), 9).alias("nivel"))


# --- question bank --------------------------------------------------------------------------------------------------------------


def _template_sql() -> str:
    rows = ", ".join(f"CASE WHEN regexp_matches(bajo, '{'|'.join(cues)}') THEN {{'pregunta': {_strip(f"'{q.split('{}')[0]}' || lower(nombre) || '{q.split('{}')[1]}'")}, 'tipo': '{k}'}} END" for cues, q, k in bank.TEMPLATES)
    q, k = bank.FALLBACK
    return f"""WITH n AS (SELECT fila AS nodo, titulo AS nombre, lower(titulo) || ' ' || lower(coalesce(texto, '')) AS bajo FROM fragmentos WHERE titulo IS NOT NULL), a AS (SELECT nodo, nombre, list_filter([{rows}], lambda x: x IS NOT NULL) AS xs FROM n),
b AS (SELECT nodo, CASE WHEN len(xs) > 0 THEN xs[1:3] ELSE [{{'pregunta': {_strip(f"'{q.split('{}')[0]}' || lower(nombre) || '{q.split('{}')[1]}'")}, 'tipo': '{k}'}}] END AS xs FROM a)
SELECT nodo, n::INT AS n, x.pregunta AS pregunta, x.tipo AS tipo FROM (SELECT nodo, unnest(xs) AS x, generate_subscripts(xs, 1) AS n FROM b)"""


@query(_template_sql())
def template_questions(t):
    return bank.template_questions(t.fragmentos.select(F.col("fila").alias("nodo"), F.col("titulo").alias("nombre"), "texto"))


@query(rf"""SELECT id, length(s) BETWEEN 35 AND 100 AND regexp_matches(s, '(?s)^¿.*\?$') AND NOT regexp_matches(lower(s), '\b(?:este|esta|esto|ese|esa|eso|aquel|aquella|anterior|siguiente|mencionad[oa]|dich[oa])\b') AS sola FROM (SELECT id, {_strip("prompt")} AS s FROM linea_base WHERE prompt IS NOT NULL)""")
def self_contained(t):
    return t.linea_base.where("prompt is not null").select("id", bank.self_contained(F.col("prompt")).alias("sola"))


@query("SELECT manifiesto_id FROM manifiesto WHERE coalesce(starts_with(lower(trim(url)), 'https://archivos.'), false) OR coalesce(lower(trim(titulo_pagina)) IN ('inicio', 'contacto'), false)")
def skipped_pages(t):
    return t.manifiesto.where(bank.skipped(F.col("url"), F.col("titulo_pagina"), ["https://archivos."], ["Inicio", "Contacto"])).select("manifiesto_id")


@query(f"""WITH f AS (SELECT {_key_sql('prompt')} AS k, min(id) AS id FROM linea_base WHERE prompt IS NOT NULL GROUP BY 1), g AS (SELECT id, id % 7 AS grupo FROM f WHERE k <> '')
SELECT id, grupo FROM (SELECT *, row_number() OVER (PARTITION BY grupo ORDER BY id) AS r FROM g) WHERE r <= 40""")
def questions_once(t):
    q = t.linea_base.where("prompt is not null").select("id", (F.col("id") % 7).alias("grupo"), "prompt")
    return sampling.without_repeats(q, spelling.key_form(F.col("prompt")), "grupo", "id", 40).select("id", "grupo")


@query("""WITH d AS (SELECT doc_id, source, lang, n_chars // 500 AS tramo FROM documents WHERE source IS NOT NULL), t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY source, tramo ORDER BY doc_id) = 1 THEN 1 ELSE 2 END AS t FROM d)
SELECT doc_id, source, orden FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY t, doc_id)::INT AS orden FROM t) WHERE orden <= 12""")
def diverse_sample(t):
    d = t.documents.where("source is not null").select("doc_id", "source", "lang", F.floor(F.col("n_chars") / 500).alias("tramo"))
    return sampling.diverse(d, "source", "doc_id", ["lang", "tramo"], 12).select("doc_id", "source", "orden")


@query("""WITH b AS (SELECT vec_id AS id, label AS v FROM embeddings), f AS (SELECT vec_id AS id, label + 100 AS v FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 100000, label FROM embeddings WHERE vec_id % 5 = 0)
SELECT id, v FROM f UNION ALL SELECT id, v FROM b WHERE id NOT IN (SELECT id FROM f)""")
def upserted(t):
    e = t.embeddings
    fresh = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (F.col("label") + 100).alias("v")).unionByName(e.where("vec_id % 5 = 0").select((F.col("vec_id") + 100000).alias("id"), F.col("label").alias("v")))
    return bank.upsert(e.select(F.col("vec_id").alias("id"), F.col("label").alias("v")), fresh.unionByName(fresh), ["id"])


@query("""WITH s AS (SELECT vec_id AS id, (vec_id % 41) / 40.0 AS a, (vec_id % 37) / 36.0 AS b FROM embeddings) SELECT id FROM s WHERE a + b >= 1.8 AND id % 4 <> 0 AND 0.5 * a + 0.5 * b >= 0.9 AND a >= 0.85 AND b >= 0.85""")
def publishable(t):
    a, b = (F.col("vec_id") % 41) / F.lit(40.0), (F.col("vec_id") % 37) / F.lit(36.0)
    j = t.embeddings.select(F.col("vec_id").alias("id"), F.when(a + b >= 1.8, "aceptada").otherwise("revision").alias("veredicto"), F.when(F.col("vec_id") % 4 == 0, True).alias("vb"), (0.5 * a + 0.5 * b).alias("puntaje"), F.create_map(F.lit("a"), a, F.lit("b"), b).alias("rubricas"))
    return bank.publishable(j).select("id")


@query("""WITH s AS (SELECT DISTINCT manual AS nodo, titulo AS pregunta FROM fragmentos WHERE manual IS NOT NULL AND titulo IS NOT NULL) , n AS (SELECT manual AS nodo, count(*) AS n FROM fragmentos WHERE manual IS NOT NULL AND titulo IS NOT NULL GROUP BY 1)
SELECT s.nodo, (SELECT arg_min(titulo, fila) FROM fragmentos f WHERE f.manual = s.nodo AND titulo IS NOT NULL) AS titulo, any_value(n.n) AS n, string_agg(pregunta, '|' ORDER BY pregunta) AS preguntas FROM s JOIN n USING (nodo) GROUP BY s.nodo""")
def node_seeds(t):
    f = t.fragmentos.where("manual is not null and titulo is not null")
    return bank.seeds_by_node(f.select(F.col("manual").alias("nodo"), F.col("titulo").alias("pregunta")), f.select(F.col("manual").alias("nodo"), F.col("fila").alias("id"), "titulo"))


@query("""WITH p AS (SELECT id, prompt AS pregunta, respuesta, 'ctx ' || id AS contexto, md5(id::VARCHAR) AS h FROM linea_base WHERE prompt IS NOT NULL AND respuesta IS NOT NULL), q AS (SELECT id, 0 AS variante, pregunta FROM p UNION ALL SELECT id, 1, upper(pregunta) FROM p WHERE id % 2 = 0),
g AS (SELECT id, q.variante, q.pregunta, contexto, respuesta, 'verificada' AS clase FROM q JOIN p USING (id)), c AS (SELECT id, lead(contexto) OVER (PARTITION BY substring(h, 9, 1) ORDER BY h, id) AS o FROM p WHERE ('0x' || left(h, 8))::BIGINT % 20 = 0),
b AS (SELECT id, 0 AS variante, pregunta, o AS contexto, 'El contexto no contiene la respuesta.' AS respuesta, 'abstencion' AS clase FROM p JOIN c USING (id) WHERE o IS NOT NULL), u AS (SELECT * FROM g UNION ALL SELECT * FROM b)
SELECT id, variante, clase, sha256(pregunta || chr(31) || contexto || chr(31) || respuesta) AS huella FROM u""")
def training_rows(t):
    p = t.linea_base.where("prompt is not null and respuesta is not null").select("id", F.col("prompt").alias("pregunta"), "respuesta")
    v = p.where("id % 2 = 0").select("id", F.lit(1).alias("variante"), F.upper("pregunta").alias("pregunta"))
    return bank.training_set(p, v, p.select("id", F.concat(F.lit("ctx "), F.col("id").cast("string")).alias("contexto"))).select("id", "variante", "clase", "huella")


@query("""WITH r AS (SELECT r_name, n_name, c_mktsegment, c_custkey AS v FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT r_name, n_name, c_mktsegment, sum(v)::BIGINT AS total, CASE WHEN c_mktsegment IS NOT NULL THEN 0 WHEN n_name IS NOT NULL THEN count(DISTINCT s) ELSE count(DISTINCT n) END AS hijos FROM (SELECT *, n_name AS n, c_mktsegment AS s FROM r) GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment))""")
def catalog_tree(t):
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return bank.tree(j.select("r_name", "n_name", "c_mktsegment", "c_custkey"), ["r_name", "n_name", "c_mktsegment"], "c_custkey")


@query("""WITH s AS (SELECT source, count(*) AS filas, count(DISTINCT doc_id) AS claves FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY filas DESC, source NULLS FIRST) AS r FROM s)
SELECT CASE WHEN r <= 5 THEN coalesce(source, '(sin)') ELSE 'otros' END AS grupo, sum(filas)::BIGINT AS filas, sum(claves)::BIGINT AS claves FROM o GROUP BY 1""")
def groups_and_others(t):
    return bank.others(t.documents, "source", "doc_id", 5)


@query("""SELECT fila, unnest(list_filter([CASE WHEN coalesce(regexp_matches(id, '^[a-z0-9-]+$'), false) THEN NULL ELSE 'id' END, CASE WHEN coalesce(trim(titulo) <> '', false) THEN NULL ELSE 'titulo' END, CASE WHEN coalesce(length(texto) >= 40, false) THEN NULL ELSE 'texto' END], lambda x: x IS NOT NULL)) AS regla FROM fragmentos""")
def catalog_violations(t):
    return bank.violations(t.fragmentos, "fila", {"id": F.col("id").rlike("^[a-z0-9-]+$"), "titulo": F.trim("titulo") != "", "texto": F.length("texto") >= 40})


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 40)::VARCHAR AS p, CASE WHEN l_suppkey % 50 = 0 THEN ' ' ELSE 'x' END AS a, (l_suppkey % 9)::VARCHAR AS f FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <> 3),
g AS (SELECT k, min(n) <> 1 OR max(n) <> count(*) OR count(DISTINCT n) <> count(*) AS a, count(DISTINCT p) <> count(*) AS b, count(*) FILTER (WHERE trim(a) = '') > 0 AS c, count(DISTINCT (f)) <> count(*) AS d FROM s GROUP BY k)
SELECT k, 'numeracion' AS regla FROM g WHERE a UNION ALL SELECT k, 'paso_repetido' FROM g WHERE b UNION ALL SELECT k, 'accion_vacia' FROM g WHERE c UNION ALL SELECT k, 'foto_repetida' FROM g WHERE d""")
def procedure_violations(t):
    s = t.lineitem.where("l_orderkey % 3 = 0 and l_linenumber <> 3").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 40).cast("string").alias("paso_id"), F.when(F.col("l_suppkey") % 50 == 0, " ").otherwise("x").alias("accion"), F.array((F.col("l_suppkey") % 9).cast("string")).alias("fotos"))
    return bank.step_violations(s, "k")


_CITES = "(SELECT DISTINCT id, CASE WHEN fila % 7 = 0 THEN 'otro' ELSE manual END AS manual FROM fragmentos WHERE fila % 50 = 0 AND manual IS NOT NULL AND id IS NOT NULL)"


def _cites(t):
    return t.fragmentos.where("fila % 50 = 0 and manual is not null and id is not null").select(F.col("fila").alias("cita"), "id", F.when(F.col("fila") % 7 == 0, "otro").otherwise(F.col("manual")).alias("manual"))


@query(f"""WITH b AS (SELECT DISTINCT id, manual FROM fragmentos WHERE id IS NOT NULL AND manual IS NOT NULL) SELECT 'sin_resolver' AS clase, id, manual FROM (SELECT * FROM {_CITES} EXCEPT SELECT * FROM b) UNION ALL SELECT 'sin_citar', id, manual FROM (SELECT * FROM b EXCEPT SELECT * FROM {_CITES})""")
def reference_problems(t):
    return bank.reference_problems(_cites(t), t.fragmentos)


@query("""WITH c AS (SELECT fila AS cita, CASE WHEN fila % 11 = 0 THEN 'x' || id ELSE id END AS id, CASE WHEN fila % 3 = 0 THEN manual END AS manual FROM fragmentos WHERE id IS NOT NULL), o AS (SELECT id, min(manual) AS a, count(DISTINCT manual) AS n FROM fragmentos WHERE id IS NOT NULL AND manual IS NOT NULL GROUP BY 1)
SELECT cita, coalesce(manual, CASE WHEN n = 1 THEN a END) AS manual, CASE WHEN manual IS NOT NULL THEN 'dado' WHEN n = 1 THEN 'unico' WHEN n > 1 THEN 'ambiguo' ELSE 'falta' END AS por FROM c LEFT JOIN o USING (id)""")
def concept_sources(t):
    c = t.fragmentos.where("id is not null").select(F.col("fila").alias("cita"), F.when(F.col("fila") % 11 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")).alias("id"), F.when(F.col("fila") % 3 == 0, F.col("manual")).alias("manual"))
    return bank.concept_sources(c, t.fragmentos)


@query(f"""WITH s AS (SELECT manual, list_sort(list_distinct(list(nullif({_strip("tipo")}, '')))) AS s, list_sort(list_distinct(list((fila % 30)::INT))) AS p FROM fragmentos WHERE manual IS NOT NULL GROUP BY 1)
SELECT manual, array_to_string(s[1:2], ', ') || CASE WHEN len(s) > 2 THEN '…' ELSE '' END AS secciones, array_to_string(p, ', ') AS paginas FROM s""")
def readable_sources(t):
    return bank.readable_sources(t.fragmentos.where("manual is not null").select("manual", F.col("tipo").alias("seccion"), (F.col("fila") % 30).cast("int").alias("pagina")), 2)


@query("""WITH p AS (SELECT fila, unnest(pasos) AS x, generate_subscripts(pasos, 1) AS n FROM fragmentos WHERE pasos IS NOT NULL), f AS (SELECT fila, n, unnest(x.fotos) AS foto, generate_subscripts(x.fotos, 1) AS k FROM p),
a AS (SELECT fila, foto, min((n, k)) AS a FROM f WHERE foto IS NOT NULL GROUP BY 1, 2), g AS (SELECT fila, a[1] AS n, arg_min(foto, a[2]) AS foto FROM a GROUP BY 1, 2)
SELECT DISTINCT p.fila, p.n::INT AS n, x.texto AS texto, foto FROM p LEFT JOIN g ON g.fila = p.fila AND g.n = p.n""")
def implicit_steps(t):
    return bank.steps_with_photos(t.fragmentos.where("pasos is not null"))


@query("""WITH o AS (SELECT fila, list_distinct(flatten(list_transform(pasos, lambda p: coalesce(p.fotos, [])))) AS o FROM fragmentos WHERE pasos IS NOT NULL), g AS (SELECT documento, pagina, list_sort(list_distinct(list(imagen)))[1:3] AS p FROM fragmentos WHERE imagen IS NOT NULL AND documento IS NOT NULL GROUP BY 1, 2),
r AS (SELECT f.fila, CASE WHEN len(o) > 0 THEN array_to_string(list_sort(o), ',') WHEN len(p) > 0 THEN array_to_string(p, ',') WHEN imagen IS NOT NULL THEN imagen END AS fotos FROM fragmentos f LEFT JOIN o USING (fila) LEFT JOIN g ON g.documento = f.documento AND g.pagina IS NOT DISTINCT FROM f.pagina)
SELECT * FROM r WHERE fotos IS NOT NULL""")
def source_photos(t):
    r = bank.source_photos(t.fragmentos)
    return r.select("fila", F.array_join(F.array_sort(F.split("fotos", ",")), ",").alias("fotos"))


@query(f"""SELECT fila, CASE WHEN coalesce({_strip("titulo")}, '') <> '' AND coalesce({_strip("pagina")}, '') <> '' THEN regexp_replace('Vea ' || {_strip("titulo")} || ', página ' || {_strip("pagina")} || '.', '[ \\t]+', ' ', 'g') END AS texto FROM fragmentos""")
def filled_templates(t):
    return t.fragmentos.select("fila", bank.filled_template(F.lit("Vea {titulo}, página {pagina}."), {"titulo": F.col("titulo"), "pagina": F.col("pagina")}).alias("texto"))


@query("""WITH r AS (SELECT id, respuesta AS a, CASE WHEN id % 3 = 0 THEN respuesta || ' Son 77777 más.' WHEN id % 3 = 1 THEN respuesta || chr(10) || 'Fin' ELSE respuesta END AS b FROM linea_base WHERE respuesta IS NOT NULL)
SELECT id, array_to_string(list_filter([CASE WHEN id % 3 = 0 THEN 'numeros' END, CASE WHEN id % 3 = 1 THEN 'lineas' WHEN id % 3 = 0 AND trim(a, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(8203)) = '' AND NOT regexp_matches(a, '[^\\s\\p{Z}]') THEN 'lineas' END], lambda x: x IS NOT NULL), ',') AS problemas FROM r""")
def rewrite_problems(t):
    a = F.col("respuesta")
    b = F.when(F.col("id") % 3 == 0, F.concat(a, F.lit(" Son 77777 más."))).when(F.col("id") % 3 == 1, F.concat(a, F.lit("\nFin"))).otherwise(a)
    return t.linea_base.where("respuesta is not null").select("id", F.array_join(bank.rewrite_problems(a, b), ",").alias("problemas"))


# --- maintenance -------------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT url, archivo, left(sha256(coalesce(sha256, '')), 16) AS h, descargado, manifiesto_id FROM manifiesto WHERE url IS NOT NULL), l AS (SELECT url, arg_max(h, (coalesce(descargado, '1900-01-01'::TIMESTAMP), manifiesto_id)) AS h, count(DISTINCT h) AS versiones FROM c GROUP BY 1)
SELECT url, h AS huella, versiones > 1 AS cambio FROM l""")
def crawl_changes(t):
    return maintenance.crawl_state(t.manifiesto, "url", "sha256", ["descargado", "manifiesto_id"])


@query("""SELECT url FROM (SELECT DISTINCT url FROM manifiesto m WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM manifiesto o WHERE o.url = m.url AND o.sha256 IS NOT NULL)) ORDER BY url LIMIT 10""")
def pending_first(t):
    done = t.manifiesto.where("sha256 is not null").select("url")
    return maintenance.pending(t.manifiesto.select("url").distinct(), done, "url").orderBy("url").limit(10)


@query("""SELECT manual, sha256(string_agg(id, '' ORDER BY fila)) AS huella FROM fragmentos WHERE manual IS NOT NULL AND id IS NOT NULL GROUP BY 1""")
def corpus_fingerprints(t):
    return maintenance.fingerprints(t.fragmentos.where("manual is not null and id is not null"), "manual", "id", "fila")


@query("""WITH a AS (SELECT manual, sha256(string_agg(id, '' ORDER BY fila)) AS h FROM fragmentos WHERE manual IS NOT NULL AND id IS NOT NULL GROUP BY 1), s AS (SELECT manual, sha256(string_agg(id, '' ORDER BY fila)) AS h FROM fragmentos WHERE manual IS NOT NULL AND id IS NOT NULL AND fila % 1000 <> 7 GROUP BY 1)
SELECT a.manual FROM a LEFT JOIN s USING (manual) WHERE s.h IS DISTINCT FROM a.h""")
def stale_outputs(t):
    f = t.fragmentos.where("manual is not null and id is not null")
    return maintenance.stale(maintenance.fingerprints(f, "manual", "id", "fila"), maintenance.fingerprints(f.where("fila % 1000 <> 7"), "manual", "id", "fila"), "manual")


@query("""WITH a AS (SELECT DISTINCT fila, url_imagen AS u FROM fragmentos WHERE url_imagen IS NOT NULL) SELECT DISTINCT u AS url FROM a WHERE u NOT IN (SELECT url FROM manifiesto WHERE url IS NOT NULL)""")
def new_addresses(t):
    return maintenance.pending(t.fragmentos.select(F.col("url_imagen").alias("url")).distinct(), t.manifiesto, "url")


@query("""SELECT coalesce(estado, '') AS estado, coalesce(origen, '') AS origen, manifiesto_id FROM manifiesto ORDER BY 1, 2, 3 LIMIT 60""")
def sorted_page(t):
    m = t.manifiesto.select(F.coalesce("estado", F.lit("")).alias("estado"), F.coalesce("origen", F.lit("")).alias("origen"), "manifiesto_id")
    return m.orderBy("estado", "origen", "manifiesto_id").limit(60)


# --- classes and decisions --------------------------------------------------------------------------------------------------------

_TALK = "hola gracias buenos dias ok si no bien muy que tal como esta por favor la el de puedo no".split()


@query(rf"""WITH w AS (SELECT id, list_filter(string_split(regexp_replace({_PLAIN.format("respuesta")}, '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM linea_base WHERE respuesta IS NOT NULL)
SELECT id, CASE WHEN len(ws) BETWEEN 1 AND 8 THEN len(list_filter(ws, lambda x: list_contains({_TALK!r}, x) OR regexp_matches(x, '^(?:a|e|i)?(?:[jh][aeio]){{2,}}[jh]?$'))) / len(ws) ELSE 0 END AS charla FROM w""")
def small_talk(t):
    return t.linea_base.where("respuesta is not null").select("id", classify.small_talk(F.col("respuesta"), _TALK).alias("charla"))


_CLASSES = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, 'c' || b.label AS label, round(max(list_dot_product(a.v, b.v)), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2)"""


def _class_scores(t):
    """The greatest similarity of every class for the stated queries, over all vectors."""
    base, q = _vectors(t)
    return vectors.class_best(base, q).select("qid", F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), "score")


@query(f"{_CLASSES} SELECT qid, label, score FROM s")
def class_best(t):
    return _class_scores(t)


@query(f"""{_CLASSES}, b AS (SELECT qid, arg_max(label, (score, -substring(label, 2)::INT)) AS label, max(score) AS score FROM s GROUP BY 1), q AS (SELECT vec_id AS qid, (vec_id % 100 = 0)::INT AS charla FROM embeddings WHERE vec_id % 50 = 0)
SELECT qid, CASE WHEN score >= 0.4 AND label <> 'c3' THEN label WHEN charla = 1 THEN 'social' ELSE 'c3' END AS clase, CASE WHEN (score >= 0.4 AND label <> 'c3') OR charla <> 1 THEN score ELSE 1 END AS nota FROM q LEFT JOIN b USING (qid)""")
def intents(t):
    base, q = _vectors(t)
    return classify.intents(_class_scores(t), q.select("qid", (F.col("qid") % 100 == 0).cast("int").alias("charla")), work="c3")


@query(f"""{_CLASSES}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS r FROM s), b AS (SELECT qid, max(CASE WHEN r = 1 THEN label END) AS l, max(CASE WHEN r = 1 THEN score END) AS a, coalesce(max(CASE WHEN r = 2 THEN score END), 0) AS b FROM k GROUP BY 1),
g AS (SELECT vec_id AS qid, CASE WHEN vec_id % 200 = 0 THEN 'c1' WHEN vec_id % 100 = 0 THEN 'c2' END AS tipo, ['c1', 'c2', 'c4'] AS cs, CASE WHEN vec_id % 200 = 0 THEN 0.9 ELSE 0.45 END AS conf FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT *, conf >= 0.9 AS clara, coalesce(a >= 0.3 AND round(a - b, 9) >= 0.02 AND (tipo IS NULL OR list_contains(cs, l)), false) AS knn FROM g LEFT JOIN b USING (qid))
SELECT qid, CASE WHEN clara THEN tipo WHEN knn THEN l ELSE coalesce(tipo, 'desconocido') END AS tipo, CASE WHEN clara THEN 'reglas' WHEN knn THEN 'knn' WHEN tipo IS NOT NULL THEN 'reglas' ELSE 'ninguno' END AS metodo FROM d""")
def staged_types(t):
    _, q = _vectors(t)
    rules = q.select("qid", F.when(F.col("qid") % 200 == 0, "c1").when(F.col("qid") % 100 == 0, "c2").alias("tipo"), F.array(*map(F.lit, ["c1", "c2", "c4"])).alias("candidatos"), F.when(F.col("qid") % 200 == 0, 0.9).otherwise(0.45).alias("confianza"))
    return classify.staged(rules, _class_scores(t), 0.3, 0.02)


_BUCKET = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(hex(encode(k))) + 1, 2), lambda i: ('0x' || substring(hex(encode(k)), i, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 100"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'v1' WHEN doc_id % 9 = 1 THEN 'v2' WHEN {_BUCKET} < 30 THEN 'v2' ELSE 'v1' END AS version FROM (SELECT doc_id, 'conv:' || doc_id AS k FROM documents)""")
def version_choice(t):
    asked = F.when(F.col("doc_id") % 9 == 0, " V1 ").when(F.col("doc_id") % 9 == 1, "v2").when(F.col("doc_id") % 9 == 2, "otra")
    return t.documents.select("doc_id", classify.version(asked, F.concat(F.lit("conv:"), F.col("doc_id").cast("string")), True, percent=30).alias("version"))


@query(f"""WITH g AS ({bm25_sql(5, where="source = 'guias-pdf'")}), m AS ({bm25_sql(10)}), q AS (SELECT id AS qid FROM linea_base WHERE id % 50 = 0 AND prompt IS NOT NULL), s AS (SELECT qid, coalesce(max(score) >= 12, false) AS basta FROM q LEFT JOIN g USING (qid) GROUP BY 1)
SELECT qid, doc_id, score, 1 AS ronda FROM g UNION ALL SELECT qid, doc_id, score, 2 FROM m WHERE qid IN (SELECT qid FROM s WHERE NOT basta) AND NOT EXISTS (SELECT 1 FROM g WHERE g.qid = m.qid AND g.doc_id = m.doc_id)""")
def second_round(t):
    """Official documents first; where their best score is too low, all documents."""
    index, q = retrieval.build(t.documents, {"texto": F.col("text")}, _roots), _questions(t)
    first = retrieval.search(index, q, 5, analyzer=_roots, allowed=t.documents.where("source = 'guias-pdf'").select("doc_id"))
    return classify.second_round(first, retrieval.search(index, q, 10, analyzer=_roots), q, 12.0)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN (vec_id % 10) / 10.0 ELSE greatest(1 / (1 + exp(-(vec_id % 7 - 3))), coalesce(CASE WHEN vec_id % 4 > 0 THEN (vec_id % 5) / 5.0 END, 0)) END AS puntaje, floor((vec_id % 97) / 97.0 * 1000 + 0.5) / 1000 AS tres FROM embeddings")
def effective_scores(t):
    logit = F.when(F.col("vec_id") % 3 != 0, (F.col("vec_id") % 7 - 3).cast("double"))
    own, cover = (F.col("vec_id") % 10) / F.lit(10.0), F.when(F.col("vec_id") % 4 > 0, (F.col("vec_id") % 5) / F.lit(5.0))
    return t.embeddings.select("vec_id", classify.effective(own, logit, cover).alias("puntaje"), classify.half_up((F.col("vec_id") % 97) / F.lit(97.0)).alias("tres"))


@query("SELECT doc_id, CASE WHEN source IN ('guias-pdf', 'portal-ayuda', 'videos') THEN source ELSE 'guias-pdf' END AS eleccion FROM documents")
def decisions(t):
    return t.documents.select("doc_id", classify.decided(F.array(*map(F.lit, ["guias-pdf", "portal-ayuda", "videos"])), F.col("source")).alias("eleccion"))
