"""Text, chunks, retrieval and routing over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from legajo.functions import analysis
from legajo.operators import chunking, lexical, retrieval, routing, spelling, vectors
from legajo.plans.registry import query
from legajo.session import written

_PLAIN = f"translate(lower({{}}), '{analysis.FOLD_FROM}', '{analysis.FOLD_TO}')"


@query(f"SELECT doc_id, {_PLAIN.format('text')} AS plegado FROM documents")
def fold_terms(t):
    return t.documents.select("doc_id", analysis.plain(F.col("text")).alias("plegado"))


_ROOTS = f"list_transform(list_filter(regexp_extract_all({_PLAIN.format('text')}, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 4 AND regexp_full_match(x, '\\p{{L}}+')), lambda x: left(x, 5))"


@query(f"SELECT w AS raiz, count(*) AS veces, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_ROOTS}) AS w FROM documents) GROUP BY 1")
def doc_freq(t):
    w = t.documents.select("doc_id", F.explode(analysis.roots(F.col("text"))).alias("raiz"))
    per = w.groupBy("raiz", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("raiz").agg(F.sum("n").alias("veces"), F.count(F.lit(1)).alias("docs"))


#: Tokens and stems of a text in SQL: the rules one after the other, each over the result of the one before.
def tokens_sql(c: str) -> str:
    raw = f"regexp_extract_all({_PLAIN.format(c)}, '{analysis._TOKEN}')"
    named = r"lambda x: CASE WHEN contains(x, '+') THEN regexp_replace(regexp_replace(regexp_replace(x, '\s+', '', 'g'), '\bmayusculas\b|\bmayus\b', 'shift', 'g'), '\bcontrol\b', 'ctrl', 'g') ELSE x END"
    return f"list_filter(list_transform({raw}, {named}), lambda x: length(x) >= 2 OR regexp_full_match(x, '\\p{{Nd}}'))"


def stems_sql(words: str) -> str:
    """(w, r) of a table `words` (w)."""
    ends = " ".join(f"WHEN suffix(b, '{s}') AND length(b) - {len(s)} >= {n} THEN left(b, length(b) - {len(s)})" for s, n in analysis.SUFFIXES)
    return f"""(SELECT w, CASE WHEN regexp_full_match(w, '\\p{{L}}{{4,}}') THEN CASE {ends} ELSE b END ELSE w END AS r FROM (SELECT w, CASE WHEN suffix(a, 'ces') AND length(a) > 4 THEN left(a, length(a) - 3) || 'z' WHEN suffix(a, 'iones') AND length(a) > 6 THEN left(a, length(a) - 2)
WHEN length(a) > 4 AND regexp_matches(a, '[b-df-hj-np-tv-z]es$') THEN left(a, length(a) - 2) WHEN suffix(a, 's') AND length(a) > 3 AND NOT suffix(a, 'ss') AND NOT suffix(a, 'us') THEN left(a, length(a) - 1) ELSE a END AS b
FROM (SELECT w, CASE WHEN suffix(w, 'mente') AND length(w) >= 9 THEN left(w, length(w) - 5) ELSE w END AS a FROM (SELECT DISTINCT w FROM {words}))))"""


_STOP = ", ".join(f"'{w}'" for w in analysis.STOP_WORDS)


@query(f"""WITH t AS (SELECT doc_id, unnest({tokens_sql("text")}) AS w FROM documents), k AS (SELECT * FROM t WHERE w NOT IN ({_STOP}))
SELECT r AS termino, count(*) AS veces, count(DISTINCT doc_id) AS docs FROM k JOIN {stems_sql("k")} USING (w) GROUP BY 1""")
def index_terms(t):
    d = t.documents.select("doc_id", F.explode(analysis.terms(F.col("text"))).alias("termino"))
    per = d.groupBy("termino", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("termino").agg(F.sum("n").alias("veces"), F.count("doc_id").alias("docs"))


#: White space at both ends goes, of any kind.
_SPACE = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_CHUNKS = f"""WITH t AS (SELECT doc_id, {_strip("text")} AS s FROM documents),
x AS (SELECT doc_id, s, unnest(range(0, length(s), 650)) AS ini FROM t WHERE s <> ''),
y AS (SELECT doc_id, (ini // 650)::INT AS n, {_strip("substring(s, ini + 1, 800)")} AS trozo FROM x WHERE ini = 0 OR ini - 650 + 800 < length(s))
SELECT doc_id, n, trozo FROM y WHERE trozo <> ''"""


@query(_CHUNKS)
def chunk_sliding(t):
    return chunking.sliding(t.documents, "doc_id", "text")


@query()
def chunk_paragraphs(t):
    c = chunking.page_chunks(chunking.pages_of(F.col("texto")))
    return t.fragmentos.where("texto is not null").select("fila", F.posexplode(c).alias("n", "x")).select("fila", "n", "x.pagina", F.col("x.texto").alias("trozo"))


@query()
def chunk_lines(t):
    return t.fragmentos.where("texto is not null").select("fila", F.posexplode(chunking.line_chunks(F.col("texto"))).alias("n", "trozo"))


_LINES = f"SELECT fila, {_strip('l')} AS l, p FROM (SELECT fila, unnest(string_split(texto, chr(10))) AS l, generate_subscripts(string_split(texto, chr(10)), 1) AS p FROM fragmentos WHERE texto IS NOT NULL)"
_TITLE = r"""length(l) <= 120 AND (regexp_matches(l, '(?i)^(?:cap[íi]tulo|secci[óo]n|paso|tema|gu[íi]a|p[aá]gina|manual|subsecci[óo]n)\b') OR regexp_matches(l, '^\d+(?:[.)]|\s+[A-ZÁÉÍÓÚÑ])')
OR (contains(l, ':') AND length(l) - length(replace(l, ' ', '')) <= 8) OR (upper(l) = l AND regexp_matches(l, '[A-ZÁÉÍÓÚÑ]')))"""


@query(f"""WITH l AS ({_LINES}), m AS (SELECT *, CASE WHEN l = '' THEN 1 WHEN {_TITLE} THEN 1 ELSE 0 END AS s FROM l),
g AS (SELECT *, sum(s) OVER (PARTITION BY fila ORDER BY p) AS b FROM m), k AS (SELECT fila, b, string_agg(l, chr(10) ORDER BY p) AS bloque FROM g WHERE l <> '' GROUP BY 1, 2)
SELECT fila, (row_number() OVER (PARTITION BY fila ORDER BY b) - 1)::INT AS n, bloque FROM k""")
def block_split(t):
    return t.fragmentos.where("texto is not null").select("fila", F.posexplode(chunking.blocks(F.col("texto"))).alias("n", "bloque"))


@query("""SELECT fila, sha1(id || ':' || fila::VARCHAR) AS clave, coalesce(titulo, '') || coalesce(', p. ' || CASE WHEN trim(pagina, ' ') <> '' THEN pagina END, '') AS cita FROM fragmentos""")
def citations(t):
    f = t.fragmentos
    return f.select("fila", chunking.chunk_id(F.col("id"), F.col("fila")).alias("clave"), chunking.citation(F.coalesce("titulo", F.lit("")), F.lit(None).cast("string"), F.col("pagina")).alias("cita"))


@query(f"""WITH s AS (SELECT fila, regexp_replace(regexp_replace({_PLAIN.format("titulo")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM fragmentos)
SELECT fila, coalesce(nullif(regexp_replace(left(s, 40), '-+$', ''), ''), 'sin-nombre') AS slug FROM s""")
def slugs(t):
    return t.fragmentos.select("fila", chunking.slug(F.col("titulo"), 40).alias("slug"))


@query(r"""WITH u AS (SELECT manifiesto_id, regexp_extract(trim(url, ' '), '^(?i:https?)://([^/?#]+)', 1) AS h, regexp_extract(trim(url, ' '), '^(?i:https?)://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(trim(url, ' '), '^[^?#]*(\?[^#]*)', 1) AS q FROM manifiesto)
SELECT manifiesto_id, CASE WHEN h <> '' THEN 'https://' || lower(h) || p || CASE WHEN regexp_matches(p, '\.[^/]*$') OR suffix(p, '/') THEN '' ELSE '/' END || q END AS url FROM u""")
def urls(t):
    return t.manifiesto.select("manifiesto_id", chunking.normal_url(F.col("url")).alias("url"))


def _kind_sql() -> str:
    signs = f"translate(lower({_strip(f"regexp_replace(content, '{_SPACE}+', ' ', 'g')")}), 'áéíóúü¿?¡!,.:;', 'aeiouu        ')"
    hit = lambda s, cues: " OR ".join(f"contains({s}, '{x}')" for x in cues)
    cases = " ".join(f"WHEN {hit("' ' || s || ' '" if k == 'procedimiento' else 's', cues)} THEN '{k}'" for k, cues in routing.CUES.items())
    return f"""WITH u AS (SELECT artifact_id, ' ' || {_strip(signs)} || ' ' AS s, EXISTS (SELECT 1 FROM artifacts b WHERE b.archivo = a.archivo AND b.ejemplo = a.ejemplo AND b.role = 'user' AND b.turno < a.turno) AS sigue
FROM artifacts a WHERE role = 'user' AND content IS NOT NULL)
SELECT artifact_id, CASE WHEN sigue AND ({hit('s', routing.FOLLOWS)}) THEN 'seguimiento' {cases} ELSE 'informacion_directa' END AS tipo FROM u"""


@query(_kind_sql())
def question_kinds(t):
    u = t.artifacts.where("role = 'user'")
    first = u.groupBy("archivo", "ejemplo").agg(F.min("turno").alias("_t"))
    rows = u.where("content is not null").join(first, ["archivo", "ejemplo"], "left")
    return rows.select("artifact_id", routing.question_kind(F.col("content"), F.col("turno") > F.col("_t")).alias("tipo"))


@query()
def canonical_questions(t):
    return t.linea_base.select("id", analysis.canonical(F.col("prompt")).alias("canonica"))


_COMPACT = f"""array_to_string(list_filter(string_split({_strip("regexp_replace(translate(lower(" + _strip("regexp_replace(prompt, '[[:space:]]+', ' ', 'g')") + "), 'áéíóúü¿?¡!,.:;', 'aeiouu        '), ' +', ' ', 'g')")}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in routing.CONNECTORS)})), ' ')"""


@query(f"SELECT id, coalesce(nullif({_COMPACT}, ''), {_strip('prompt')}) AS compacta FROM linea_base")
def compact_questions(t):
    return t.linea_base.select("id", routing.compact(F.col("prompt")).alias("compacta"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(hex(encode(k))) + 1, 2), lambda i: ('0x' || substring(hex(encode(k)), i, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"SELECT doc_id, ({_FNV} % 100)::INT AS cubo FROM (SELECT doc_id, coalesce(source, '') || '-' || doc_id::VARCHAR AS k FROM documents)")
def version_bucket(t):
    return t.documents.select("doc_id", analysis.bucket(F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.col("doc_id").cast("string"))).alias("cubo"))


def _words(t):
    """(w, df): words of five letters or more with the documents that hold them."""
    return t.documents.select(F.explode(F.array_distinct(analysis.tokens(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(F.col("w").rlike(r"^\p{L}{5,}$"))


@query(f"""WITH v AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct({tokens_sql("text")})) AS w FROM documents) WHERE regexp_full_match(w, '\\p{{L}}{{5,}}') GROUP BY 1)
SELECT r.w AS raro, c.w AS comun, damerau_levenshtein(r.w, c.w)::INT AS d FROM v r, v c WHERE r.df < 3 AND c.df >= 10 AND c.df >= 10 * r.df AND abs(length(r.w) - length(c.w)) <= 2 AND damerau_levenshtein(r.w, c.w) BETWEEN 1 AND 2""")
def damerau_pairs(t):
    """Vocabulary words one or two restricted edits apart: every rare word with every frequent one that is ten times as frequent."""
    v = written(_words(t).where("df < 3 or df >= 10"), "vocabulario")
    p = spelling.close_words(v.where("df < 3").select(F.col("w").alias("raro")), v.where("df >= 10").select(F.col("w").alias("comun")))
    p = p.join(v.select(F.col("w").alias("raro"), F.col("df").alias("na")), "raro").join(v.select(F.col("w").alias("comun"), F.col("df").alias("nb")), "comun")
    return p.where(F.col("nb") >= 10 * F.col("na")).select("raro", "comun", "d")


def _questions(t):
    """The stated query set: every row whose id is divisible by 50."""
    return t.linea_base.where("id % 50 = 0 and prompt is not null").select(F.col("id").alias("qid"), F.col("prompt").alias("query"))


_roots = analysis.roots


_Q_ROOTS = _ROOTS.replace("lower(text)", "lower(prompt)")
_BM25 = f"""WITH l AS (SELECT doc_id, {_ROOTS} AS ws FROM documents), d AS (SELECT doc_id, ws, len(ws) AS n FROM l WHERE len(ws) > 0),
q AS (SELECT DISTINCT id AS qid, unnest({_Q_ROOTS}) AS term FROM linea_base WHERE id % 50 = 0),
p AS (SELECT doc_id, n, unnest(ws) AS term FROM d), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY ALL),
c AS (SELECT count(*) AS total FROM documents), m AS (SELECT avg(n) AS mean FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT term, doc_id, tf / (1 - 0.75 + 0.75 * n / mean) AS s FROM tf, m),
r AS (SELECT qid, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * s * 2.2 / (1.2 + s)), 6) AS score FROM s JOIN df USING (term) JOIN q USING (term), c GROUP BY 1, 2)
SELECT qid, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10"""


@query(_BM25)
def bm25_topk(t):
    return lexical.bm25f(t.documents, {"texto": F.col("text")}, _questions(t), analyzer=_roots)


_F_DOCS = " UNION ALL ".join(f"SELECT fila AS doc_id, '{c}' AS field, {tokens_sql(c)} AS ws FROM fragmentos WHERE {c} IS NOT NULL" for c in ("titulo", "seccion", "texto", "manual"))
_F_WEIGHT = "CASE field WHEN 'titulo' THEN 3.0 WHEN 'seccion' THEN 3.0 WHEN 'manual' THEN 0.5 ELSE 1.0 END"
_BM25F = f"""WITH d AS ({_F_DOCS}), t AS (SELECT doc_id, field, unnest(ws) AS w FROM d), u AS (SELECT id AS qid, unnest({tokens_sql("prompt")}) AS w FROM linea_base), s AS (SELECT * FROM {stems_sql("(SELECT w FROM t UNION SELECT w FROM u)")}),
k AS (SELECT doc_id, field, r AS term FROM t JOIN s USING (w) WHERE w NOT IN ({_STOP})), n AS (SELECT doc_id, field, count(*) AS len FROM k GROUP BY 1, 2), m AS (SELECT field, avg(len) AS mean FROM n GROUP BY 1),
q AS (SELECT DISTINCT qid, r AS term FROM u JOIN s USING (w) WHERE w NOT IN ({_STOP})), tf AS (SELECT doc_id, field, term, count(*) AS tf FROM k SEMI JOIN q USING (term) GROUP BY 1, 2, 3),
p AS (SELECT term, doc_id, sum({_F_WEIGHT} * tf / (0.25 + 0.75 * len / mean)) AS s FROM tf JOIN n USING (doc_id, field) JOIN m USING (field) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), c AS (SELECT count(*) AS total FROM fragmentos),
x AS (SELECT qid, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * s * 2.2 / (1.2 + s)), 6) AS score FROM p JOIN df USING (term) JOIN q USING (term), c GROUP BY 1, 2)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM x) WHERE rank <= 10"""


@query(_BM25F)
def bm25f_topk(t):
    f = t.fragmentos.select(F.col("fila").alias("doc_id"), "titulo", "seccion", "texto", "manual")
    fields = {c: F.col(c) for c in ("titulo", "seccion", "texto", "manual")}
    return lexical.bm25f(f, fields, t.linea_base.select(F.col("id").alias("qid"), F.col("prompt").alias("query")), many=True)


@query(_BM25.replace("GROUP BY 1, 2)", "GROUP BY 1, 2 HAVING doc_id IN (SELECT doc_id FROM documents WHERE lang = 'es' AND source = 'guias-pdf'))"))
def bm25_filtered(t):
    return lexical.bm25f(t.documents, {"texto": F.col("text")}, _questions(t), analyzer=_roots, allowed=t.documents.where("lang = 'es' and source = 'guias-pdf'").select("doc_id"))


_VEC = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"
_COS = f"""WITH e AS ({_VEC}), s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s)"""


def _vectors(t):
    base = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")
    return base, base.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "v")


@query(f"{_COS} SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10")
def cosine_topk(t):
    base, q = _vectors(t)
    return vectors.cosine_topk(base.drop("label"), q)


@query(f"{_COS} SELECT qid, label, max(score) AS score FROM r JOIN embeddings ON vec_id = doc_id WHERE rank <= 10 GROUP BY 1, 2")
def knn_label(t):
    base, q = _vectors(t)
    return vectors.class_scores(vectors.cosine_topk(base.drop("label"), q), base.select("doc_id", "label"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, sum(x) AS s FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(s * s)) AS n FROM c GROUP BY 1),
d AS (SELECT vec_id AS doc_id, c.label, round(sum(x * s / n), 6) AS score FROM e JOIN c USING (i) JOIN n ON n.label = c.label GROUP BY 1, 2)
SELECT doc_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS k FROM d) WHERE k = 1""")
def centroid_label(t):
    base, _ = _vectors(t)
    return vectors.nearest_centroid(base, vectors.centroids(base))


def bm25_sql(k: int, k1: float = 1.2, b: float = 0.75, where: str = "true") -> str:
    """The ranking of the documents for the stated queries."""
    return _BM25.replace("0.75 + 0.75", f"{b} + {b}").replace("* 2.2 / (1.2 + s)", f"* {k1 + 1} / ({k1} + s)").replace("GROUP BY 1, 2)", f"GROUP BY 1, 2 HAVING doc_id IN (SELECT doc_id FROM documents WHERE {where}))").replace("rank <= 10", f"rank <= {k}")


#: Similarity of each stated question's vector with all others, at most 50.
_NEAR = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 50)"""


def _fused(w: float, k: int = 10) -> str:
    return f"""WITH {_NEAR}, lex AS ({bm25_sql(50)}), z AS (SELECT qid, doc_id, lex.rank AS r1, vec.rank AS r2 FROM lex FULL OUTER JOIN vec USING (qid, doc_id)),
f AS (SELECT qid, doc_id, round(coalesce(1.0 / (60 + r1), 0) + coalesce({w} / (60 + r2), 0), 9) AS score, least(coalesce(r1, 999), coalesce(r2, 999)) AS b FROM z)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, b, doc_id)::INT AS rank FROM f) WHERE rank <= {k}"""


def _lists(t, k=50):
    """The two rankings of the stated questions: words of the documents, and vectors of the same numbers."""
    base, q = _vectors(t)
    index = retrieval.build(t.documents, {"texto": F.col("text")}, _roots, _questions(t))
    return retrieval.search(index, _questions(t), k, analyzer=_roots), vectors.cosine_topk(base.drop("label"), q, k)


@query(_fused(0.1))
def hybrid_topk(t):
    return retrieval.hybrid(*_lists(t))


@query(_fused(1.0))
def rrf_fusion(t):
    lexical_, vector = _lists(t)
    return vectors.rrf({"vector": (vector, 1.0), "lexico": (lexical_, 1.0)})


@query(f"""{_COS}, p AS (SELECT qid, doc_id, label, round(1 - score + CASE label % 3 WHEN 1 THEN 0.02 WHEN 2 THEN 0.04 ELSE 0 END, 9) AS d FROM r JOIN embeddings ON vec_id = doc_id WHERE rank <= 50),
n AS (SELECT *, min(d) OVER (PARTITION BY qid) AS b FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY d, doc_id) AS c FROM n WHERE d <= least(0.8, b + 0.18 + 1e-9)),
f AS (SELECT qid, doc_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, doc_id)::INT AS orden FROM o WHERE c = 1) SELECT * FROM f WHERE orden <= 5""")
def context_select(t):
    base, q = _vectors(t)
    near = vectors.cosine_topk(base.drop("label"), q, 50).join(base.select("doc_id", "label"), "doc_id")
    trust = F.element_at(F.array(*map(F.lit, ["oficial", "academico", "tercero-sin-verificar"])), (F.col("label") % 3 + 1).cast("int"))
    return routing.select_context(near.select("qid", "doc_id", (1 - F.col("score")).alias("distancia"), F.col("label").cast("string").alias("cita"), trust.alias("confianza")))


_FIVE = f"{_COS}, c AS (SELECT qid, doc_id, score, round(score * (1 + doc_id % 7), 6) AS lexico, label AS elemento, rank FROM r JOIN embeddings ON vec_id = doc_id WHERE rank <= 5)"


def _five(t):
    """The five nearest vectors of the stated queries, with their label as element and a second score made from the first."""
    base, q = _vectors(t)
    near = vectors.cosine_topk(base.drop("label"), q, 5).join(base.select("doc_id", F.col("label").alias("elemento")), "doc_id")
    return near.withColumn("lexico", F.round(F.col("score") * (1 + F.col("doc_id") % 7), 6))


@query(f"""{_FIVE}, x AS (SELECT a.qid, a.doc_id, a.score, a.lexico, greatest(0, coalesce((SELECT max(b.lexico) FROM c b WHERE b.qid = a.qid AND b.elemento <> a.elemento), 0)) AS rival FROM c a)
SELECT qid, doc_id, score, lexico, rival::DOUBLE AS rival, score >= 0.6 OR (score >= 0.3 AND lexico > 0 AND CASE WHEN rival = 0 THEN score >= 0.45 ELSE lexico >= 1.4 * rival END) AS aceptado FROM x""")
def acceptance(t):
    return routing.accepted(_five(t)).select("qid", "doc_id", "score", "lexico", "rival", "aceptado")


@query(f"""{_FIVE} SELECT a.qid, coalesce(b.score >= 0.2 AND b.score >= a.score - 0.05 AND NOT (a.lexico > 0 AND b.lexico < 0.95 * a.lexico), false) AS ambigua FROM c a LEFT JOIN c b ON b.qid = a.qid AND b.rank = 2 WHERE a.rank = 1""")
def ambiguity(t):
    return routing.ambiguous(_five(t), threshold=0.2)
