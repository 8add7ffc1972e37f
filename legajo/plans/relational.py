"""Reports, traces, maintenance and evaluation over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.operators import evaluation, maintenance, sampling, traces
from legajo.operators.reports import run_report
from legajo.plans.registry import query

# --- reports: bound parameters, optional predicates, aggregates -------------------------------------------------

OVERLAP = """SELECT p_partkey, p_name, p_size FROM part
WHERE (:desde IS NULL OR p_size + 5 >= :desde) AND (:hasta IS NULL OR p_size <= :hasta)"""


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size + 5 >= 20 ")
def report_overlap(t):
    return run_report(t.spark, OVERLAP, {"part": t.part}, {"desde": 20, "hasta": None})


BY_DAY = """SELECT o.o_orderdate AS dia, count(*) AS pedidos, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE (:segmento IS NULL OR c.c_mktsegment = :segmento) AND o.o_orderdate BETWEEN :desde AND :hasta GROUP BY o.o_orderdate"""


@query("""SELECT o.o_orderdate AS dia, count(*) AS pedidos, round(sum(o.o_totalprice), 2) AS total FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate BETWEEN '1994-01-01' AND '1996-12-31' GROUP BY 1""")
def report_by_day(t):
    return run_report(t.spark, BY_DAY, {"orders": t.orders, "customer": t.customer}, {"segmento": "BUILDING", "desde": "1994-01-01", "hasta": "1996-12-31"})


@query("""SELECT c.c_mktsegment AS segmento, round(avg(o.o_totalprice), 1) AS promedio, count(*) AS registros
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1""")
def report_avg_by_segment(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("segmento")).agg(F.round(F.avg("o_totalprice"), 1).alias("promedio"), F.count(F.lit(1)).alias("registros"))


@query("""SELECT l_returnflag AS concepto, count(DISTINCT l_suppkey) AS proveedores, round(sum(l_extendedprice), 2) AS total FROM lineitem
WHERE strftime(l_shipdate, '%Y-%m') = '1995-06' GROUP BY 1""")
def report_cost_distinct(t):
    p = t.lineitem.where((F.col("l_shipdate") >= "1995-06-01") & (F.col("l_shipdate") < "1995-07-01"))
    return p.groupBy(F.col("l_returnflag").alias("concepto")).agg(F.countDistinct("l_suppkey").alias("proveedores"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT c.c_name AS nombre, c.c_mktsegment AS segmento, round(o.o_totalprice, 2) AS monto FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority LIKE '1-%' AND o.o_orderdate >= '1995-01-01' AND o.o_orderdate < '1996-01-01'""")
def report_prefix(t):
    o = t.orders.where(F.col("o_orderpriority").startswith("1-") & (F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1996-01-01"))
    return o.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("segmento"), F.round("o_totalprice", 2).alias("monto"))


@query("""SELECT r_name, n_name, count(*) AS clientes, round(sum(c_acctbal), 2) AS saldo FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def report_rollup(t):
    j = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("clientes"), F.round(F.sum("c_acctbal"), 2).alias("saldo"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)")
def pending_anti(t):
    done = t.lineitem.where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return t.supplier.join(done, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query("""SELECT c_custkey, min(o_orderkey) AS primera, arg_min(o_orderstatus, o_orderkey) AS estado FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def left_first_candidate(t):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("primera"), F.min_by("o_orderstatus", "o_orderkey").alias("estado"))
    return t.customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "primera", "estado")


# --- traces over events -------------------------------------------------------------------------------------------


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS media, min(value) AS minimo, max(value) AS maximo,
quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def trace_stats(t):
    return traces.statistics(t.events, "event_type", "value")


@query("""WITH b AS (SELECT * FROM (VALUES (0, '<10'), (1, '10–50'), (2, '50–100'), (3, '≥100')) v(i, tramo)),
e AS (SELECT CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS i, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT b.i::INTEGER AS i, tramo, coalesce(n, 0) AS n FROM b LEFT JOIN e USING (i)""")
def latency_hist(t):
    return traces.histogram(t.events, "value", [10, 50, 100])


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def trace_page(t):
    return traces.page(t.events.where("event_type = 'click'"), "ts", "event_id", limit=50, offset=100).select("event_id", "ts", "event_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90")
def json_prop_filter(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k >= 90")


@query("""SELECT user_id, count(*) AS n, string_agg(event_type, '|' ORDER BY ts, event_id) AS tipos FROM events GROUP BY 1""")
def trace_nested(t):
    g = traces.nested(t.events, "user_id", ["ts", "event_id"], ["event_type"])
    return g.select("user_id", F.size("filas").cast("bigint").alias("n"), F.array_join(F.transform("filas", lambda x: x["event_type"]), "|").alias("tipos"))


@query("""SELECT event_type, quantile_cont(value, 0.9) AS interpolado, quantile_disc(value, 0.9) AS cercano FROM events GROUP BY 1""")
def percentiles(t):
    e = t.events.where("value is not null")
    return e.groupBy("event_type").agg(F.expr("percentile(value, 0.9)").alias("interpolado"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("cercano"))


@query("""SELECT date_trunc('hour', ts) AS hora, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(t):
    e = t.events.withColumn("w", F.window(F.col("ts").cast("timestamp"), "1 hour"))
    return e.groupBy(F.col("w.start").cast("timestamp_ntz").alias("hora"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(ts) AS inicio, count(*) AS n FROM k GROUP BY user_id, i""")
def session_counts(t):
    e = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("inicio"), "n")


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), p AS (SELECT event_type, n / sum(n) OVER () AS p FROM c)
SELECT round(1 - (-sum(p * ln(p))) / ln(count(*)), 9) AS confianza FROM p""")
def entropy_confidence(t):
    return evaluation.entropy_confidence(t.events, "event_type")


# --- maintenance -----------------------------------------------------------------------------------------------------


@query("""SELECT fila, id, manual, visto FROM (SELECT *, row_number() OVER (PARTITION BY id, manual ORDER BY visto DESC NULLS LAST, fila DESC) AS r
FROM fragmentos WHERE id IS NOT NULL AND manual IS NOT NULL) WHERE r = 1""")
def latest_per_key(t):
    f = t.fragmentos.where("id is not null and manual is not null")
    return maintenance.latest(f, ["id", "manual"], ["visto", "fila"]).select("fila", "id", "manual", "visto")


@query("SELECT min(fila) AS primera, count(*) AS copias FROM fragmentos WHERE texto IS NOT NULL GROUP BY texto HAVING count(*) > 1")
def exact_dup(t):
    return t.fragmentos.where("texto is not null").groupBy(F.sha2("texto", 256).alias("h")).agg(F.min("fila").alias("primera"), F.count(F.lit(1)).alias("copias")).where("copias > 1").select("primera", "copias")


_STATE = "(SELECT doc_id, sha256(coalesce(text, '')) AS version FROM documents WHERE doc_id % 10 < 8)"


@query("""WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS v FROM documents), antes AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE v END AS v FROM a WHERE doc_id % 10 < 8),
ahora AS (SELECT doc_id, v FROM a WHERE doc_id % 10 > 1)
SELECT coalesce(antes.doc_id, ahora.doc_id) AS clave, CASE WHEN antes.v IS NULL THEN 'nuevo' WHEN ahora.v IS NULL THEN 'borrado' WHEN antes.v = ahora.v THEN 'igual' ELSE 'cambiado' END AS accion
FROM antes FULL OUTER JOIN ahora USING (doc_id)""")
def index_diff(t):
    a = t.documents.select(F.col("doc_id").alias("clave"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("version"))
    before = a.where("clave % 10 < 8").withColumn("version", F.when(F.col("clave") % 7 == 0, "x").otherwise(F.col("version")))
    return maintenance.diff(before, a.where("clave % 10 > 1"), "clave", "version")


@query("""SELECT DISTINCT url FROM manifiesto m WHERE NOT EXISTS (SELECT 1 FROM manifiesto o WHERE o.url = m.url AND o.sha256 IS NOT NULL) AND url IS NOT NULL""")
def pending_downloads(t):
    done = t.manifiesto.where("sha256 is not null").select("url")
    return maintenance.pending(t.manifiesto.select("url").distinct(), done, "url")


@query("""SELECT coalesce(archivo, '') AS archivo, count(*) AS filas, count(DISTINCT sha256) AS versiones, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM manifiesto GROUP BY 1""")
def inventory(t):
    return t.manifiesto.groupBy(F.coalesce("archivo", F.lit("")).alias("archivo")).agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("sha256").alias("versiones"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


@query("""WITH r AS (SELECT fila, id, sha256(coalesce(texto, '') || chr(0) || 'v1') AS v FROM fragmentos WHERE id IS NOT NULL),
o AS (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY fila) AS antes, row_number() OVER (PARTITION BY id ORDER BY fila) AS n FROM r),
s AS (SELECT fila, id, CASE WHEN n = 1 THEN id ELSE id || '-' || left(v, 12) END AS clave, n, v FROM o WHERE n = 1 OR v <> antes)
SELECT min(fila) AS fila, clave FROM s GROUP BY id, clave""")
def fragment_identity(t):
    return maintenance.identity(t.fragmentos, "id", "texto", "fila", "v1")


@query("""SELECT manual, count(*) AS filas, count(DISTINCT id) AS ids, sum(length(coalesce(texto, '')))::BIGINT AS letras, sum((texto IS NULL OR trim(texto) = '')::INT)::BIGINT AS vacios
FROM fragmentos GROUP BY manual""")
def fragment_totals(t):
    blank = F.col("texto").isNull() | (F.trim("texto") == "")
    return t.fragmentos.groupBy("manual").agg(F.count(F.lit(1)).alias("filas"), F.countDistinct("id").alias("ids"), F.sum(F.length(F.coalesce("texto", F.lit("")))).alias("letras"), F.count_if(blank).alias("vacios"))


@query("""SELECT manual, coalesce(seccion, '') AS seccion, string_agg(DISTINCT pagina, ',' ORDER BY pagina) AS paginas, string_agg(DISTINCT imagen, ',' ORDER BY imagen) AS imagenes, count(*) AS citas FROM fragmentos WHERE manual IS NOT NULL GROUP BY 1, 2""")
def source_summary(t):
    f = t.fragmentos.where("manual is not null")
    joined = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit("")).alias
    return f.groupBy("manual", F.coalesce("seccion", F.lit("")).alias("seccion")).agg(joined("pagina")("paginas"), joined("imagen")("imagenes"), F.count(F.lit(1)).alias("citas"))


# --- sampling and conversations ----------------------------------------------------------------------------------------


@query("""SELECT doc_id, source, parte FROM (SELECT doc_id, source, CASE WHEN b < 5 THEN 'test' WHEN b < 10 THEN 'valid' ELSE 'train' END AS parte FROM
(SELECT doc_id, source, ('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8))::BIGINT % 100 AS b FROM documents))""")
def hash_split(t):
    return sampling.split(t.documents.select("doc_id", "source"), "doc_id")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 20""")
def quota_sample(t):
    return sampling.quota(t.documents.select("doc_id", "source"), "source", "doc_id", 20)


@query("""SELECT doc_id, source, orden FROM (SELECT doc_id, source, row_number() OVER (ORDER BY r, source NULLS FIRST) AS orden FROM
(SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5)""")
def round_robin_sample(t):
    return sampling.round_robin(t.documents.select("doc_id", "source"), "source", "doc_id", 5)


@query("""SELECT archivo, ejemplo, turno, role, left(content, 200) AS texto FROM (SELECT *, row_number() OVER (PARTITION BY archivo, ejemplo ORDER BY turno DESC, artifact_id DESC) AS r FROM artifacts) WHERE r <= 4""")
def thread_tail(t):
    return maintenance.last_rows(t.artifacts, ["archivo", "ejemplo"], ["turno", "artifact_id"], 4).select("archivo", "ejemplo", "turno", "role", F.substring("content", 1, 200).alias("texto"))


@query("""SELECT archivo, ejemplo, max(turno) AS turno, arg_max(content, (turno, artifact_id)) AS texto FROM artifacts WHERE role = 'user' AND content IS NOT NULL GROUP BY 1, 2""")
def last_user_turn(t):
    u = t.artifacts.where("role = 'user' and content is not null")
    return u.groupBy("archivo", "ejemplo").agg(F.max("turno").alias("turno"), F.max_by("content", F.struct("turno", "artifact_id")).alias("texto"))


# --- evaluation ----------------------------------------------------------------------------------------------------------

_JUDGED = "(SELECT vec_id, label AS real, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS dicho, (vec_id % 97) / 97.0 AS p FROM embeddings)"


def _judged(t):
    return t.embeddings.select("vec_id", F.col("label").alias("real"), F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("dicho"), ((F.col("vec_id") % 97) / F.lit(97.0)).alias("p"))


@query(f"""WITH j AS {_JUDGED}, c AS (SELECT DISTINCT real AS clase FROM j UNION SELECT DISTINCT dicho FROM j),
n AS (SELECT clase, (SELECT count(*) FROM j WHERE real = clase AND dicho = clase) AS vp, (SELECT count(*) FROM j WHERE dicho = clase) AS d, (SELECT count(*) FROM j WHERE real = clase) AS r FROM c)
SELECT clase, r AS soporte, round(CASE WHEN d > 0 THEN vp / d ELSE 0 END, 9) AS precision, round(CASE WHEN r > 0 THEN vp / r ELSE 0 END, 9) AS recall, round(CASE WHEN d + r > 0 THEN 2 * vp / (d + r) ELSE 0 END, 9) AS f1 FROM n""")
def prf_by_class(t):
    return evaluation.prf(_judged(t), "real", "dicho")


@query(f"SELECT real, dicho, count(*) AS n FROM {_JUDGED} GROUP BY 1, 2")
def confusion(t):
    return _judged(t).groupBy("real", "dicho").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH j AS {_JUDGED}, u AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS umbral)
SELECT umbral, count(*) FILTER (WHERE p >= umbral) AS cubiertos, round(count(*) FILTER (WHERE p >= umbral) / count(*), 9) AS cobertura,
round(count(*) FILTER (WHERE p >= umbral AND real = dicho) / nullif(count(*) FILTER (WHERE p >= umbral), 0), 9) AS precision FROM j, u GROUP BY umbral""")
def threshold_sweep(t):
    return evaluation.coverage_curve(_judged(t), "real", "dicho", "p", [0.1, 0.3, 0.5, 0.7, 0.9])


@query("""WITH d AS (SELECT o_custkey AS q, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r,
(o_orderkey % 4)::INT AS g FROM orders),
x AS (SELECT q, sum(CASE WHEN r <= 10 THEN (2 ** g - 1) / log2(r + 1) ELSE 0 END) AS dcg, max(CASE WHEN r <= 10 AND g > 0 THEN 1.0 / r ELSE 0 END) AS mrr,
count(*) FILTER (WHERE g > 0 AND r <= 10) AS hit, count(*) FILTER (WHERE g > 0) AS rel FROM d GROUP BY q),
y AS (SELECT q, sum((2 ** g - 1) / log2(k + 1)) AS ideal FROM (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY g DESC) AS k FROM d) WHERE k <= 10 GROUP BY q)
SELECT q, round(hit / least(rel, 10), 9) AS recall, round(mrr, 9) AS mrr, round(dcg / ideal, 9) AS ndcg FROM x JOIN y USING (q) WHERE rel > 0""")
def ndcg_graded(t):
    o = t.orders.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("i"), "o_totalprice", (F.col("o_orderkey") % 4).cast("int").alias("g"))
    w = Window.partitionBy("q").orderBy(F.desc("o_totalprice"), "i")
    return evaluation.graded(o.withColumn("r", F.row_number().over(w)), 10)
