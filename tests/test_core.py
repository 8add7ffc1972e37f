"""The general operators on small fixtures: values worked out by hand, brute force, properties."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from legajo.functions import analysis
from legajo.operators import chunking, evaluation, lexical, maintenance, quality, reports, routing, sampling, traces, vectors
from legajo.plans import textual
from legajo.sources import files
from legajo.streaming import logs


def got(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, want",
    [
        ("¿Cómo registro el METRADO?", ["como", "registro", "el", "metrado"]),
        ("Use Ctrl + F para buscar", ["use", "ctrl+f", "para", "buscar"]),
        ("Pulse F7 o Shift+F1", ["pulse", "f7", "shift+f1"]),
        ("Control+C y Mayús+F1", ["ctrl+c", "shift+f1"]),
        ("La partida 01.01.01 está en uso", ["la", "partida", "01.01.01", "esta", "en", "uso"]),
        ("Año: 2025, nómina", ["ano", "2025", "nomina"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, text, analysis.tokens) == want and analysis.tokens_py(text) == want


def test_stems(spark):
    stem = {w: one(spark, w, analysis.stem) for w in "registro registrar registra registrado registros registre configuracion configurar factura facturar facturacion nomina nominas metrado metro partida parte obra obrero f7 a10 apu luces acciones valores rapidamente".split()}
    assert all(analysis.stem_py(w) == s for w, s in stem.items())
    assert len({stem[w] for w in ("registro", "registrar", "registra", "registrado", "registros", "registre")}) == 1
    assert stem["configuracion"] == stem["configurar"] and stem["factura"] == stem["facturar"] == stem["facturacion"] and stem["nomina"] == stem["nominas"]
    assert stem["metrado"] != stem["metro"] and stem["partida"] != stem["parte"] and stem["obra"] != stem["obrero"]
    assert stem["f7"] == "f7" and stem["a10"] == "a10" and stem["apu"] == "apu"


def test_canonical(spark):
    assert one(spark, "partida 01.01.01. Luego, guardar", analysis.canonical) == "partida 01.01.01 luego guardar"
    assert one(spark, "F7!", analysis.canonical) == "f7"


def test_osa():
    assert analysis.osa("ab", "ba", 2) == 1 and analysis.osa("ca", "abc", 3) == 3 and analysis.osa("abc", "xyz", 1) == 2 and analysis.osa(None, "", 1) == 0


def test_fnv(spark):
    def ref(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    for s in ("", "a", "ñandú", "clave-12"):
        assert one(spark, s, analysis.fnv1a) == ref(s)


def test_sliding(spark):
    rows = spark.createDataFrame([(1, "ñandú" * 400), (2, "  hola  "), (3, "   "), (4, "a" * 800), (5, None)], "k int, t string")
    out = {}
    for r in chunking.sliding(rows, "k", "t").orderBy("k", "n").collect():
        out.setdefault(r.k, []).append(r.trozo)
    assert [len(x) for x in out[1]] == [800, 800, 700] and out[1][0][-150:] == out[1][1][:150]
    assert out[2] == ["hola"] and out[4] == ["a" * 800] and 3 not in out and 5 not in out


def test_html(spark):
    html = "<html><style>p{}</style><!-- no --><h1>Uno</h1><p>a&nbsp;&amp; b</p><svg><x/></svg><script>var x</script><ul><li>dos</li></ul>"
    assert one(spark, html, chunking.clean_html).split("\n") == ["Uno", "a & b", "dos"]
    assert one(spark, "Ingresar usuario y clave", chunking.is_login_page) is True
    assert one(spark, "Manual: ingresar al sistema", chunking.is_login_page) is False


def test_blocks(spark):
    assert one(spark, "1. Inicio\ntexto largo de la parte\n\notro\nALCANCE\nfin", chunking.blocks) == ["1. Inicio\ntexto largo de la parte", "otro", "ALCANCE\nfin"]


def test_folded_chunks(spark):
    parts = ["p" * n for n in (700, 700, 700, 200)]
    out = one(spark, parts, lambda c: chunking.folded_chunks(c, 1500, 200, "\n\n"), "array<string>")
    assert out[0] == parts[0] + "\n\n" + parts[1] and out[1].startswith("p" * 200) and all(len(x) <= 1700 for x in out)


def test_urls_and_slugs(spark):
    assert one(spark, "HTTP://Www.Ejemplo.PE/a/b?x=1#y", chunking.normal_url) == "https://www.ejemplo.pe/a/b/?x=1"
    assert one(spark, "https://e.pe/a.pdf", chunking.normal_url) == "https://e.pe/a.pdf"
    assert one(spark, "¡Guía de Planillas 2!", chunking.slug) == "guia-de-planillas-2" and one(spark, "¿?", chunking.slug) == "sin-nombre"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "metrado partida"), ("b", "partida partida obra"), ("c", "obra")], "doc_id string, texto string")
    q = spark.createDataFrame([(1, "partida"), (2, "metrado obra")], "qid int, query string")
    rows = got(lexical.bm25f(docs, {"texto": F.col("texto")}, q).select("qid", "rank", "doc_id", "score"))
    assert [r[2] for r in rows if r[0] == 1] == ["b", "a"] and [r[2] for r in rows if r[0] == 2] == ["a", "c", "b"]
    s = 2 / (0.25 + 0.75 * 3 / 2)
    assert rows[0][3] == pytest.approx(math.log(1 + 1.5 / 2.5) * s * 2.2 / (1.2 + s), abs=1e-6)
    some = lexical.bm25f(docs, {"texto": F.col("texto")}, q, allowed=docs.where("doc_id = 'a'").select("doc_id"))
    assert got(some.select("qid", "doc_id", "score")) == [(r[0], "a", r[3]) for r in rows if r[2] == "a"]
    assert lexical.bm25f(docs.limit(0), {"texto": F.col("texto")}, q).count() == 0


def test_field_weights(spark):
    docs = spark.createDataFrame([("t", "kardex", "nada"), ("x", "otro", "kardex")], "doc_id string, titulo string, texto string")
    q = spark.createDataFrame([(1, "kardex")], "qid int, query string")
    assert [r.doc_id for r in lexical.bm25f(docs, {c: F.col(c) for c in ("titulo", "texto")}, q).orderBy("rank").collect()] == ["t", "x"]


def test_bm25f_topk_takes_every_question(spark):
    rows = [(1, "Kardex", "Cierre", "El kardex valorizado", "Manual"), (2, "Planilla", None, "metrado de la partida", None)]
    f = spark.createDataFrame(rows, "fila bigint, titulo string, seccion string, texto string, manual string")
    q = spark.createDataFrame([(50, "kardex"), (51, "kardex"), (7, "metrado kardex"), (8, None), (9, "nada")], "id bigint, prompt string")
    found = textual.bm25f_topk(SimpleNamespace(fragmentos=f, linea_base=q)).select("qid", "rank", "doc_id")
    assert got(found) == [(7, 1, 1), (7, 2, 2), (50, 1, 1), (51, 1, 1)]


def test_bm25f_many_queries(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"palabra{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    pick = lambda n: " ".join(words[int(60 * rng.random() ** 3)] for _ in range(n))
    docs = [(i, pick(3), pick(12) if i % 5 else None) for i in range(700)] + [(i, "palabraaa", "palabraba igual") for i in range(700, 900)]
    docs = spark.createDataFrame(docs, "doc_id bigint, titulo string, texto string").repartition(3)
    q = spark.createDataFrame([(i, pick(1 + i % 7)) for i in range(300)] + [(300, "palabraaa palabraaa"), (301, ""), (302, "ajena"), (303, "palabraba"), (304, "igual ajena")], "qid int, query string")
    fields = {c: F.col(c) for c in ("titulo", "texto")}
    want = got(lexical.bm25f(docs, fields, q))
    assert len(want) > 2_900 and got(lexical.bm25f(docs, fields, q, many=True)) == want
    for name, value in (("MANY", 100), ("DOCS", 128), ("GATHERED", 50)):
        monkeypatch.setattr(lexical, name, value)
    assert got(lexical.bm25f(docs, fields, q, many=True)) == want
    assert got(lexical.bm25f(docs, fields, q, k=3, many=True)) == [r for r in want if r[3] <= 3]
    assert lexical.bm25f(docs.limit(0), fields, q, many=True).count() == 0


def test_terms_by_pieces():
    known = analysis._Stems()
    for s in ("Use Ctrl + F, luego control+C y Mayús+F1", "a+b 1.2.3 x 5", "alt +\tq", "¿Año: 2025?, nómina", None, "", "75,311.18 S/ REQ-654088"):
        assert analysis.terms_py(s, known) == [r for t in analysis.tokens_py(s) if (r := known[t]) is not None]


def test_rrf(spark):
    a = spark.createDataFrame([(1, "ceo", 1), (1, "metrado", 2), (1, "imagen", 3)], "qid int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "metrado", 1)], "qid int, doc_id string, rank int")
    rows = vectors.rrf({"v": (a, 1.0), "l": (b, 1.0)}).orderBy("rank").collect()
    assert rows[0].doc_id == "metrado" and rows[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and rows[1].doc_id == "ceo"


def test_vectors_brute_force(spark):
    rng = random.Random(1)
    vs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    vs = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vs]
    base = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "doc_id int, v array<double>")
    top = vectors.cosine_topk(base, base.where("doc_id < 3").select(F.col("doc_id").alias("qid"), "v"), 5)
    for q in range(3):
        want = sorted(((round(sum(x * y for x, y in zip(vs[q], v)), 6), -i) for i, v in enumerate(vs) if i != q), reverse=True)[:5]
        assert [(r.score, -r.doc_id) for r in top.where(F.col("qid") == q).orderBy("rank").collect()] == want
    assert one(spark, [0.0, 0.0], vectors.unit, "array<double>") is None


def test_context(spark):
    rows = spark.createDataFrame([(1, "primero", 0.10, "G10", "oficial"), (1, "duplicado", 0.12, "G10", "oficial"), (1, "cercano", 0.24, "M3", "oficial"), (1, "lejano", 0.35, "V", "oficial")], "qid int, doc_id string, distancia double, cita string, confianza string")
    assert [r.doc_id for r in routing.select_context(rows).orderBy("orden").collect()] == ["primero", "cercano"]
    tie = spark.createDataFrame([(1, "copia", 0.20, "a", "tercero-sin-verificar"), (1, "manual", 0.22, "b", "oficial")], rows.schema)
    assert routing.select_context(tie).orderBy("orden").first().doc_id == "manual"


def test_kinds(spark):
    for text, kind in (("No aparece el botón", "problema"), ("¿Cuál es la diferencia?", "comparacion"), ("¿Qué es una partida?", "concepto"), ("Precio de la bolsa", "informacion_directa")):
        assert one(spark, text, routing.question_kind) == kind
    assert one(spark, "¿Qué es el control de gerencia de proyectos?", routing.compact) == "control gerencia proyectos"
    assert one(spark, "¿y el?", routing.compact) == "¿y el?"


def test_rerank_ignores_bad_scores(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 5)], "qid int, doc_id int, rank int")
    s = spark.createDataFrame([(1, 3, 9.0), (1, 2, float("nan")), (1, 4, 1.0)], "qid int, doc_id int, nota double")
    assert [r.doc_id for r in routing.rerank(ranked, s).orderBy("nuevo").collect()] == [3, 4, 1, 2]


def test_diff_and_replace(spark):
    a = spark.createDataFrame([("k1", "1"), ("k2", "1"), ("x/3", "1")], "k string, v string")
    b = spark.createDataFrame([("k1", "1"), ("k2", "2"), ("k4", "1")], "k string, v string")
    d = maintenance.diff(a, b, "k", "v")
    assert dict(got(d)) == {"k1": "igual", "k2": "cambiado", "k4": "nuevo", "x/3": "borrado"}
    assert got(maintenance.replace(a, b, d, "k")) == [("k1", "1"), ("k2", "2"), ("k4", "1")]
    assert ("x/3", "1") in got(maintenance.replace(a, b, d, "k", prefix="y/"))


def test_identity(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "z")], "n int, id string, t string")
    out = got(maintenance.identity(rows, "id", "t", "n"))
    assert out[0] == (1, "a") and out[1][0] == 3 and out[1][1].startswith("a-") and len(out) == 2


def test_latest_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "a", 5), (4, "b", None)], "n int, k string, t int")
    assert got(maintenance.latest(rows, ["k"], ["t", "n"]).select("k", "n")) == [("a", 3), ("b", 4)]


def test_reports(spark):
    t = spark.createDataFrame([("2024-06", "BASICO", 1, 10.0), ("2024-06", "BASICO", 2, 5.5), ("2024-07", "CTS", 1, 3.0)], "periodo string, concepto string, trabajador int, monto double")
    sql = "SELECT concepto, count(DISTINCT trabajador) AS n, round(sum(monto), 2) AS total FROM planilla WHERE (:p IS NULL OR periodo = :p) GROUP BY concepto"
    assert got(reports.run_report(spark, sql, {"planilla": t}, {"p": "2024-06"})) == [("BASICO", 2, 15.5)]
    assert len(got(reports.run_report(spark, sql, {"planilla": t}, {"p": None}))) == 2
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "EXPLAIN SELECT 1"):
        with pytest.raises(ValueError):
            reports.guard(spark, bad)
    assert reports.resolve("costo de la planilla de junio 2024")["hasta"] == "2024-06-31"
    assert reports.resolve("planilla de febrero de 2024", calendar=True) == {"periodo": "2024-02", "desde": "2024-02-01", "hasta": "2024-02-29"}
    a = reports.Template("1", "Horas por día", "", ("asistencia de operarios",))
    b = reports.Template("2", "Costo de planilla", "", ("cuánto costó la planilla",))
    assert reports.choose("¿cuánto costó la planilla?", [a, b])[0] is b
    with pytest.raises(ValueError):
        reports.choose("zzz", [a, b])


def test_traces(spark):
    e = spark.createDataFrame([("a", 50.0), ("a", 100.0), ("b", 200.0), ("b", None)], "m string, v double")
    assert [r[2] for r in got(traces.histogram(e, "v", [50, 100, 150, 500]))] == [0, 1, 1, 1, 0]
    assert [r[2] for r in got(traces.histogram(e.limit(0), "v", [50]))] == [0, 0]
    assert traces.page(e.dropna(), "v", "m", limit=0).count() == 1


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "X", 1), (1, "A", 2), (1, "A2", 3), (1, "B", 4)], "q int, i string, r int")
    rel = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (1, "c", "C")], "q int, entry string, i string")
    r = evaluation.binary(ranked, rel).first()
    assert r.recall == pytest.approx(2 / 3, abs=1e-9) and r.mrr == 0.5
    assert r.ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3) + 0.5), abs=1e-9)


def test_quotas(spark):
    s = spark.createDataFrame([("a", 100), ("b", 25), ("c", 1)], "g string, n int")
    out = dict(got(sampling.proportional(s, "g", "n", 20)))
    assert sum(out.values()) == 20 and out["a"] > out["b"] > out["c"] >= 1


def test_memory(spark):
    turns = [(1, "procedimiento de compras"), (2, "siguiente"), (3, "procedimiento de planillas"), (4, "ya hice hasta el paso 3"), (5, "cancelar"), (6, "volver"), (7, None)]
    df = spark.createDataFrame([("c", n, t) for n, t in turns], "conv string, turno int, texto string")
    assert [r[2:] for r in got(logs.conversation_memory_batch(df))] == [("abrir", "compras", 1), ("avanzar", "compras", 2), ("abrir", "planillas", 1), ("completar", "planillas", 4), ("cerrar", "", 0), ("retomar", "compras", 2), ("nada", "compras", 2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T{h:02}:{m:02}:00", "tipo": "a" if m % 2 else "b"} for h in range(5) for m in range(0, 60, 7)]
    schema = "ts timestamp, tipo string"
    src = str(tmp_path / "in")
    spark.createDataFrame([(r["ts"], r["tipo"]) for r in rows], "ts string, tipo string").repartition(3).write.json(src)
    q = logs.windowed_counts(logs.tail(spark, src, schema), "ts", "tipo").writeStream.format("memory").queryName("cuentas").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got(spark.table("cuentas")) == got(logs.windowed_counts(spark.read.schema(schema).json(src), "ts", "tipo"))


def test_jsonl(spark, tmp_path):
    p = tmp_path / "f.jsonl"
    p.write_text('{"id": "1", "manual": "a", "texto": "x"}\nmal\n{"id": "1", "manual": "a", "texto": "y"}\n')
    rows, problems = files.tolerant(spark, str(p), files.FRAGMENT, ["id", "manual"])
    assert [r.texto for r in rows.collect()] == ["x"] and sorted(r.clase for r in problems.collect()) == ["linea", "repetido"]
    assert files.read_jsonl(spark, str(tmp_path / "no.jsonl"), files.FRAGMENT).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        files.strict(spark, str(p), files.FRAGMENT, ["id"]).collect()


def test_snapshot(spark, tmp_path):
    t = spark.range(3)
    files.save_snapshot({"t": t}, str(tmp_path / "s"))
    assert files.load_snapshot(spark, str(tmp_path / "s"), ["t"])["t"].count() == 3
    with pytest.raises(ValueError):
        files.load_snapshot(spark, str(tmp_path / "s"), ["t"], version=9)


def test_links(spark):
    pages = spark.createDataFrame([(1, '<a href="/x.pdf">x</a><iframe src="v?file=%2Fdoc.pdf"></iframe>')], "p int, html string")
    assert {r.url for r in files.html_links(pages, "p", "html").collect()} == {"/x.pdf", "v?file=%2Fdoc.pdf", "/doc.pdf"}
    maps = spark.createDataFrame([("<loc> http://A.pe/x </loc><loc>https://otro.com/</loc>",)], "xml string")
    assert got(files.sitemap_urls(maps, "a.pe")) == [("https://a.pe/x/",)]


def test_partitions_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"palabra{i % 7} otra{i % 5} obra") for i in range(60)], "doc_id int, texto string")
    q = spark.createDataFrame([(1, "obra palabra3 otra2")], "qid int, query string")
    a = got(lexical.bm25f(docs.repartition(1), {"texto": F.col("texto")}, q))
    assert a == got(lexical.bm25f(docs.repartition(8), {"texto": F.col("texto")}, q)) and len(a) == 10


def test_html_sections(spark):
    html = "<nav>menú</nav><h2>Uno</h2><p>paso a</p><img src='1.png'><p>paso a</p><p>paso b</p><h2>Dos</h2><img src='2.png'><li>paso c</li>"
    pages = spark.createDataFrame([(1, html), (2, None)], "k bigint, html string")
    rows = quality.html_sections(pages, "k", "html").orderBy("k", "n").collect()
    assert [(r.titulo, [(p.texto, p.fotos) for p in r.pasos]) for r in rows] == [("Uno", [("paso a", ["1.png"]), ("paso a", []), ("paso b", [])][:1] + [("paso b", [])]), ("Dos", [("paso c", ["2.png"])])]


def test_transcripts(spark):
    s = spark.createDataFrame([("v", 0.0, 5.0, "a" * 10), ("v", 5.0, 65.0, "b" * 10), ("v", 65.0, 70.0, "c" * 10)], "k string, ini double, fin double, texto string")
    assert got(quality.transcript_chunks(s, "k", 25).select("n", "desde", "hasta")) == [(0, "0:00", "1:05"), (1, "1:05", "1:10")]


def test_evidence(spark):
    assert one(spark, "use **Nueva partida** y ** otra **", quality.bold_terms) == ["Nueva partida", "otra"]
    assert one(spark, "Pulse Ctrl+F o F7 en OC-123, código 01.02 y «Guardar»", quality.exact_forms) == ["01.02", "ctrl+f", "f7", "guardar", "oc-123"]
    df = spark.createDataFrame([("El saldo de la PARTIDA madre se cierra", "partida madre", "saldo de la partida")], "t string, p string, q string")
    r = df.select(quality.holds_phrase(F.col("t"), F.col("p")).alias("a"), quality.quoted(F.col("t"), F.col("q")).alias("b"), quality.quoted(F.col("t"), F.lit("saldo")).alias("c"), quality.supported(F.col("q"), F.col("t")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (True, True, False, True)
    lines = spark.createDataFrame([("x", 1, "abra la ficha de partidas"), ("x", 2, "grabe los cambios del registro")], "key string, n int, texto string")
    steps = spark.createDataFrame([("x", 1, "grabe cambios registro"), ("x", 2, "nada parecido aquí")], "key string, n int, texto string")
    assert got(quality.place_photos(lines, steps)) == [("x", 1, 2)]


def test_rubric(spark):
    s = spark.createDataFrame([(1, 0.9, 0.9), (2, 0.9, 0.5), (3, 0.1, 0.1)], "id int, a double, b double")
    assert [r[2] for r in got(routing.rubric(s, {"a": 0.5, "b": 0.5}, {"a": 0.8, "b": 0.8}))] == ["aceptada", "revision", "rechazada"]


def test_damerau_pairs_brute_force(spark):
    """Edits in the first two letters, two letters more or less, words on both sides of the bound of length."""
    rng = random.Random(5)
    base = ["tesorera", "obras", "planilla", "abcdef", "presupuesto", "q" * 20 + "abcdefghijklmnopqr", "z" * 15 + "abcdefghijklmnopqrstuvwxyz", "y" * 60 + "fin", "almacen"]
    rare = {"tesore", "btesorera", "etsorera", "xxsorera", "sorera", "borsa", "tesorerass", "baplanilla"}
    for w in base:
        for _ in range(25):
            x = w
            for _ in range(rng.choice([1, 2, 2, 3])):
                i = rng.randrange(len(x) - 1)
                x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("abxyz") + x[i:], x[:i] + rng.choice("abxyz") + x[i + 1 :], x[:i] + x[i + 1] + x[i] + x[i + 2 :]])
            rare.add(x)
    rare = {x for x in rare - set(base) if len(x) >= 5}
    texts = [" ".join(base)] * 10 + [" ".join(sorted(rare))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted((a, b, d) for a in rare for b in base if (d := analysis.osa(a, b, 2)) <= 2)
    lengths = {(len(b) > 42, abs(len(a) - len(b))) for a, b, _ in want}
    assert got(textual.damerau_pairs(SimpleNamespace(documents=docs))) == want and {(x, n) for x in (True, False) for n in (0, 1, 2)} <= lengths


def test_index_terms_counts_documents_exactly(spark):
    sizes = {"metrado": 3000, "planilla": 1777, "acero": 901, "grua": 1}
    texts = [(i, " ".join(w + " " + w for w, n in sizes.items() if i < n)) for i in range(3000)] + [(None, "acero"), (5000, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = sorted((analysis.stem_py(w), 2 * n + (w == "acero"), n) for w, n in sizes.items())
    assert got(textual.index_terms(SimpleNamespace(documents=docs))) == want


def test_stored_index(spark, tmp_path):
    """Search over a saved index equals search over a fresh one, terms of a larger collection replace own frequencies."""
    from legajo.operators import retrieval

    docs = spark.createDataFrame([(1, "metrado partida"), (2, "partida partida obra"), (3, "obra"), (4, None)], "doc_id bigint, texto string")
    q = spark.createDataFrame([(1, "partida obra"), (2, "nada")], "qid bigint, query string")
    index = retrieval.build(docs, {"texto": F.col("texto")})
    retrieval.save(index, str(tmp_path / "i"))
    kept = retrieval.load(spark, str(tmp_path / "i"))
    a, b = (sorted(map(tuple, retrieval.search(i, q).collect())) for i in (index, kept))
    assert a == b and [r[1] for r in a] == [1, 2, 3] and {r[0] for r in a} == {1}
    with pytest.raises(ValueError):
        retrieval.load(spark, str(tmp_path / "i"), version=2)
    swept = retrieval.sweep(kept, q, [(1.2, 0.75), (0.5, 0.0)])
    assert {tuple(r)[2:] for r in swept.where("k1 = 1.2").collect()} == {tuple(r) for r in a}
    rare = spark.createDataFrame([("obr", 1)], "term string, df bigint")
    assert retrieval.search(kept, q, general=(rare, 1000)).where("doc_id = 3").first().score > [r[2] for r in a if r[1] == 3][0]
    assert retrieval.search(retrieval.build(docs.limit(0), {"texto": F.col("texto")}), q).count() == 0


def test_second_orderings(spark):
    from legajo.operators import retrieval

    r = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.85, 2), (1, 12, 0.1, 3), (2, 10, 0.5, 1)], "qid bigint, doc_id bigint, score double, rank int")
    assert sorted(map(tuple, retrieval.cascade(r).collect())) == [(1, round(0.05 / 0.9, 9), True), (2, None, False)]
    same, degraded = retrieval.or_input_order(r, lambda x: 1 / 0)
    assert degraded and all(x.rank == x.nuevo for x in same.collect())
    good, degraded = retrieval.or_input_order(r, lambda x: x.select("qid", "doc_id", (-F.col("score")).alias("nota")))
    assert not degraded and {(x.qid, x.doc_id): x.nuevo for x in good.collect()}[(1, 12)] == 1
    el = spark.createDataFrame([(12,)], "doc_id bigint")
    assert [tuple(x) for x in retrieval.eligible_first(r, r, el).collect()] == [(1, 12, 1)]


def test_close_words_brute_force(spark):
    import itertools
    import random

    from legajo.operators import spelling

    rng = random.Random(4)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["x" * 45, "x" * 44 + "y", "x" * 43]
    a, b = base[:35] + ["x" * 45], base[30:]
    want = sorted({(x, y, d) for x, y in itertools.product(a, b) if x != y and (d := analysis.osa(x, y, 2)) <= 2})
    got_ = spelling.close_words(spark.createDataFrame([(x,) for x in a], "raro string"), spark.createDataFrame([(x,) for x in b], "comun string"))
    assert sorted(map(tuple, got_.collect())) == want and len(want) > 30


def test_corrections_and_leaks(spark):
    from legajo.operators import spelling

    v = spark.createDataFrame([("factura", 50), ("fatcura", 1), ("baca", 1), ("vaca", 9), ("facturs", 1), ("corto", 5)], "word string, df bigint")
    assert {r.word: (r.correcta, r.por) for r in spelling.corrections(v).collect()} == {"baca": ("vaca", "sonido"), "facturs": ("factura", "letra")}
    assert one(spark, "o valor não está", spelling.leaks_portuguese) and not one(spark, "el valor no está", spelling.leaks_portuguese)
    rows = spark.createDataFrame([("a", "", ""), ("b", "caja chica", "caja chica!"), ("c", None, "x")], "id string, a string, b string")
    assert {r.id: r.p for r in rows.select("id", spelling.similarity(F.col("a"), F.col("b")).alias("p")).collect()}["b"] == 1.0


def test_sections_from_text(spark):
    from legajo.operators import fragments

    text = "previo\n1 Compras\nabra la ficha\nabra la ficha\n1.2 Registro de pedidos\nelija\n2 haga clic aquí\n3 Cierre\n" + "\n".join(f"paso {'x' * 700} {i}" for i in range(4))
    got_ = fragments.numbered_sections(text)
    assert got_[0] == ("1 Compras", ["abra la ficha"]) and got_[1] == ("1 Compras › 1.2 Registro de pedidos", ["elija", "2 haga clic aquí"]) and got_[2][0] == "3 Cierre"
    assert [t for t, _ in fragments.split_section(*got_[2])] == ["3 Cierre (1)", "3 Cierre (2)"]
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k bigint, t string")
    assert fragments.text_sections(rows, "k", "t").count() == 4
    assert fragments.first_json('a {b} {"x": {"y": "}"}} c') == '{"x": {"y": "}"}}' and fragments.first_json(None) is None and fragments.first_json("{") is None


def test_white_space_and_crlf(spark):
    assert one(spark, "uno\r\n\r\ndos", chunking.blocks) == ["uno", "dos"] and one(spark, "\n\t\n", chunking.blocks) == []
    df = spark.createDataFrame([(1, "\n\t\n"), (2, None), (3, " x ")], "k bigint, t string")
    assert [tuple(r) for r in chunking.sliding(df, "k", "t").collect()] == [(3, 0, "x")]
    pages = "a" * 1000 + "\n\n" + "b" * 300 + "\f" + "c" * 900
    got_ = one(spark, pages, lambda c: chunking.page_chunks(chunking.pages_of(c)))
    assert [r.pagina for r in got_] == [1, 2] and got_[1].texto.endswith("c" * 900) and got_[1].texto.startswith("b" * 199)
    assert one(spark, "x\ny", chunking.line_chunks) == ["x\ny"] and len(one(spark, "\n".join(["l" * 600] * 5), chunking.line_chunks)) == 3


def test_layout(spark):
    from legajo.operators import layout

    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 5.0), (1, 1.0, 9.0, 9.0, 14.0), (1, 40.0, 0.0, 50.0, 5.0), (1, 41.0, 9.0, 52.0, 14.0), (2, 0.0, 0.0, 1.0, 1.0)], "pagina bigint, x0 double, y0 double, x1 double, y1 double")
    c = layout.columns(b)
    assert {(r.pagina, r.columna): r.cajas for r in c.collect()} == {(1, 1): 2, (1, 2): 2, (2, 1): 1}
    assert {r.pagina: r.rejilla for r in layout.grids(c).collect()} == {1: True, 2: False}
    s = spark.createDataFrame([("v", 1, 0b1111, ["a"]), ("v", 2, 0b1110, None), ("v", 3, -1 >> 1 & 0xFFFFFFFF, ["z"]), ("v", 4, 0xFF00FF00FF, ["a", "b"])], "video string, pantalla bigint, huella bigint, palabras array<string>")
    assert [r.grupo for r in layout.screen_groups(s).orderBy("pantalla").collect()] == [1, 1, 3, 1]
    read = spark.createDataFrame([(1, "Orden de compra", 3), (1, "Orden", 1), (1, "nada", 1)], "pagina bigint, texto string, n int")
    seen = spark.createDataFrame([(1, "orden de compra"), (1, "zzz")], "pagina bigint, etiqueta string")
    assert [(r.etiqueta, r.leido) for r in layout.fused_labels(read, seen).collect()] == [("orden de compra", "Orden de compra")]


def test_identity_follows_the_sequence(spark):
    import hashlib

    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "a", "x"), (5, "a", "y"), (6, "b", None), (7, None, "x")]
    h = lambda s: hashlib.sha256(f"{s}\0v".encode()).hexdigest()[:12]
    got_ = maintenance.identity(spark.createDataFrame(rows, "n bigint, id string, t string"), "id", "t", "n", "v")
    assert sorted(map(tuple, got_.collect())) == [(1, "a"), (3, f"a-{h('y')}"), (4, f"a-{h('x')}"), (6, "b")]
    assert maintenance.collisions(got_).count() == 0


def test_acceptance_needs_a_rival_of_another_element(spark):
    c = spark.createDataFrame([(1, 1, 0.35, 2.0, "a"), (2, 1, 0.5, 2.0, "a"), (3, 1, 0.35, 3.0, "a"), (3, 2, 0.3, 2.9, "a"), (3, 3, 0.2, 2.0, "b"), (4, 1, 0.35, 2.0, "a"), (4, 2, 0.3, 1.9, "b")], "qid bigint, doc_id bigint, score double, lexico double, elemento string")
    got_ = {(r.qid, r.doc_id): r.aceptado for r in routing.accepted(c).collect()}
    assert not got_[(1, 1)] and got_[(2, 1)] and got_[(3, 1)] and got_[(3, 2)] and not got_[(3, 3)] and not got_[(4, 1)]


def test_written_needs_a_shared_folder(spark, monkeypatch):
    from legajo import session as s

    class Cluster:
        master = "spark://host:7077"

    class Fake:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError):
        s.shared_dir(Fake())
    s.written(spark.range(3), "prueba").count()
    assert s.forget(spark) >= 1


def test_small_talk_and_versions(spark):
    from legajo.operators import classify

    talk = lambda s: one(spark, s, lambda c: classify.small_talk(c, ["hola", "ok", "gracias"]))
    assert talk("¡Holaaa! jajaja okk") == 1.0 and talk("hola metrados") == 0.5 and talk("") == 0.0 and talk(None) == 0.0 and talk("ok " * 9) == 0.0
    assert one(spark, "x", lambda c: classify.version(F.lit("v2"), c, False)) == "v1" and one(spark, "x", lambda c: classify.version(F.lit(" V2"), c, True)) == "v2" and one(spark, "x", lambda c: classify.version(F.lit(None), c, False, "v2")) == "v2"
    assert one(spark, "b", lambda c: classify.decided(F.array(F.lit("a"), F.lit("b")), c)) == "b" and one(spark, None, lambda c: classify.decided(F.array(F.lit("a")), c)) == "a"
    assert one(spark, 0.0005, classify.half_up, "double") == 0.001 and one(spark, 0.0005, classify.half_even, "double") == 0.0


def test_reports_state_and_traces(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n bigint, t string")
    assert files.report(df, "T") == "# T\n\n| n | t |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |"
    assert '"truncado": true' in files.report(df, "T", "json", 1) and "<td>a|b</td>" in files.report(df, "T", "html")
    p = str(tmp_path / "estado")
    for n in (1, 2):
        files.save_state(df.limit(n), p)
        assert spark.read.parquet(p).count() == n
    (tmp_path / "t.jsonl").write_text('{"id": "a", "preguntas": [{"id": "1", "tipo": "score"}]}\nmala\n', encoding="utf-8")
    assert [(r.id, r.preguntas[0].tipo) for r in files.read_traces(spark, str(tmp_path / "t.jsonl")).collect()] == [("a", "score")]
    assert files.read_traces(spark, str(tmp_path / "no.jsonl")).count() == 0
    j = files.joined_traces(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "2", "t", "i", 0.5), ("a", "1", "t", "i", None)], "trace_id string, id string, tipo string, instrucciones string, confianza double"))
    assert {r.id: [q.id for q in r.preguntas] for r in j.collect()} == {"a": ["1", "2"], "b": []}
    assert {r.archivos for r in files.folder_sizes(spark, str(tmp_path / "t.jsonl")).collect()} == {1}


def test_bank_edges(spark):
    from legajo.operators import bank

    pairs = spark.createDataFrame([(i, f"p{i}", f"r{i}") for i in range(400)], "id bigint, pregunta string, respuesta string")
    t = bank.training_set(pairs, pairs.limit(0).select("id", F.lit(1).alias("variante"), "pregunta"), pairs.select("id", F.concat(F.lit("c"), "id").alias("contexto")))
    rows = t.collect()
    bad = [r for r in rows if r.clase == "abstencion"]
    assert len([r for r in rows if r.clase == "verificada"]) == 400 and 2 <= len(bad) <= 40 and all(r.contexto != f"c{r.id}" for r in bad)
    old, new = F.lit("Pulse **F7** 3 veces"), F.lit("Pulse **F8** 4 veces\ny siga")
    assert spark.range(1).select(bank.rewrite_problems(old, new).alias("x")).first().x == ["numeros", "atajos", "negritas", "lineas"]
    assert bank.template_questions(spark.createDataFrame([(1, "Saldo", None), (2, None, "x")], "nodo bigint, nombre string, texto string")).collect()[0].pregunta == "¿Cómo funciona saldo en el ERP?"


@pytest.mark.parametrize("block", [20_000, 2])
def test_ranking_moves_no_pairs(spark, monkeypatch, block):
    """What leaves the scoring tasks is k documents for each query, not every document that holds a term; ties, copies, filters and boosts as by hand."""
    from legajo.operators import retrieval

    monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
    seen, kept = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, name: seen.append((name, kept(df, name))) or seen[-1][1])
    words = ["obra", "partida", "metrado", "costo", "acero"]
    texts = {i: " ".join(words[j] for j in range(5) for _ in range((i >> (2 * j)) % 3)) for i in range(400)}
    docs = spark.createDataFrame([*texts.items(), (7, texts[8])], "doc_id bigint, texto string").repartition(1)
    q = spark.createDataFrame([(1, "obra acero"), (2, "obra acero"), (3, "costo"), (4, "metrado obra partida"), (5, "nada")], "qid int, query string")
    texts[7] = f"{texts[7]} {texts[8]}"  # rows of one document count together, each with its own length
    own = [(i, t.split()) for i, t in docs.collect() for t in [t] if t]
    n, mean = docs.count(), sum(len(w) for _, w in own) / len(own)
    df = {w: len({i for i, ws in own if w in ws}) for w in words}

    def by_hand(query, k, k1, b, ids=None, factor=lambda i: 1):
        score = {}
        for w in query.split():
            s = {}
            for i, ws in own:
                if w in ws:
                    s[i] = s.get(i, 0) + ws.count(w) / (1 - b + b * len(ws) / mean)
            for i, x in s.items():
                score[i] = score.get(i, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x * (k1 + 1) / (k1 + x)
        return sorted(((-round(x * factor(i), 6), i) for i, x in score.items() if ids is None or i in ids))[:k]

    same = lambda c: F.split(c, " ")
    index = retrieval.build(docs, {"texto": F.when(F.length("texto") > 0, F.col("texto"))}, same)
    some = docs.where("doc_id % 3 = 0").select("doc_id").distinct()
    for how, hand in (({}, {}), ({"allowed": some}, {"ids": set(range(0, 400, 3))}), ({"boost": some.withColumn("factor", F.lit(1.5))}, {"factor": lambda i: 1 if i % 3 else 1.5})):
        seen.clear()
        got_ = {}
        for r in retrieval.sweep(index, q, [(1.2, 0.75), (0.5, 0.0)], 4, analyzer=same, **how).orderBy("rank").collect():
            got_.setdefault((r.k1, r.qid), []).append((pytest.approx(-r.score, abs=2e-6), r.doc_id))
        for k1, b in ((1.2, 0.75), (0.5, 0.0)):
            for i, text in q.where("qid < 5").collect():
                assert [x for _, x in got_[k1, i]] == [x for _, x in by_hand(text, 4, k1, b, **hand)] and got_[k1, i] == by_hand(text, 4, k1, b, **hand)
        rows = sum(df_.count() for name, df_ in seen if name == "puestos")
        assert 2 * 3 * 4 <= rows <= 2 * 3 * 4 * 8  # three different queries, two settings, up to eight tasks; the pairs are ten times as many


def test_a_scoring_task_sends_k_rows_for_each_query(monkeypatch):
    """However many batches it reads, also when it drops the rest in between; copies and ties across batches go to the smaller doc_id."""
    import pyarrow as pa

    def batch(ids):
        one = lambda v, kind: pa.array([[v]] * len(ids), pa.list_(kind))
        tf = pa.array([[1 + i % 3 if i < 90 else 3] for i in ids], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(ids), one("obra", pa.string()), one("texto", pa.string()), tf, one(9, pa.int32())], ["doc_id", "term", "field", "tf", "len"])

    for most in (500_000, 3):
        monkeypatch.setattr(lexical, "GATHERED", most, raising=False)
        run = lexical._scored(["nada", "obra"], np.array([1.0, 2.0]), [(77, [1], [1.0]), (78, [0], [1.0])], [(1.2, 0.75), (0.5, 0.0)], {}, {"texto": 9.0}, 4)
        rows = [tuple(r.values()) for b in run(batch([100 - i for i in range(j, j + 10)]) for j in range(0, 100, 10)) for r in b.to_pylist()]
        assert [(x, g, i) for x, g, i, _ in rows] == [(x, 77, i) for x in (0, 1) for i in (2, 5, 8, 11)]
        assert list(run(iter([]))) == []


@pytest.mark.parametrize("tf, again", [("1 + pmod(doc_id * 7919, 1601)", False), ("1600 - doc_id", True), ("7", True)])
def test_tasks_send_their_part_of_the_best(spark, monkeypatch, tmp_path, tf, again):
    """Eight tasks send fewer rows than k for each query; also where the best, or equal ones, all lie in one task the rows are those of all documents."""
    import math
    import uuid

    kept, passes, folder = lexical._scored, [], str(tmp_path)

    def counted(*how):
        run = kept(*how)
        passes.append(len(how[2]))

        def go(batches):
            for b in run(batches):
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(b.num_rows))
                yield b

        return go

    monkeypatch.setattr(lexical, "_scored", counted)
    ids = spark.range(0, 1600, 1, 8).withColumnRenamed("id", "doc_id")
    rows = ids.select("doc_id", F.expr("array('obra') AS term"), F.expr("array('texto') AS field"), F.expr(f"array(int({tf})) AS tf"), F.expr("array(9) AS len"))
    means = spark.createDataFrame([("texto", 9.0)], "field string, mean double")
    q = spark.createDataFrame([(1, "obra"), (2, "obra nada"), (3, "obra"), (4, "nada")], "qid int, query string")
    found = lexical.ranked(rows, means, 1_000_000, q, 50, [(1.2, 0.75), (0.5, 0.0)], analyzer=lambda c: F.split(c, " ")).orderBy("x", "qid", "rank").collect()
    idf, counts = math.log(1 + (1_000_000 - 1600 + 0.5) / 1600.5), {r.doc_id: r.tf[0] for r in rows.collect()}
    wanted = []
    for x, k1 in enumerate((1.2, 0.5)):
        best = sorted((-round(idf * n * (k1 + 1) / (k1 + n), 6), i) for i, n in counts.items())[:50]
        wanted += [(x, qid, i, pytest.approx(-s, abs=2e-6), rank) for qid in (1, 2, 3) for rank, (s, i) in enumerate(best, 1)]
    assert [tuple(r) for r in found] == wanted
    assert passes == [2, 2] if again else passes == [2]
    sent = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert 2 * 2 * 50 <= sent <= 2 * 2 * 50 * 8 * (0.75 if again else 0.5)


@pytest.mark.parametrize("name, lists", [("hybrid_topk", 1), ("rrf_fusion", 1), ("bm25_sweep", 1)])
def test_rankings_write_what_the_questions_ask(spark, monkeypatch, name, lists):
    """They write the postings of the questions' terms and their best 50, not the whole index; the rows are those of the SQL."""
    import duckdb

    from legajo.plans.catalog import ORACLES, QUERIES

    seen, kept = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, what: seen.append((what, kept(df, what))) or seen[-1][1])
    found = sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    for table in ("documents", "linea_base", "embeddings"):
        con.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    assert found == sorted(con.execute(ORACLES[name]).fetchall()) != []
    asked = spark.read.parquet("/root/testdata/sf0.001/linea_base.parquet").where("id % 50 = 0").select(F.explode(analysis.roots(F.col("prompt"))))
    terms = [df for what, df in seen if what == "terminos"]
    assert len(terms) == lists and {r[0] for r in terms[0].select(F.explode("term")).distinct().collect()} <= {r[0] for r in asked.collect()}
    assert all(df.groupBy("x", "g").count().where("count > 50").isEmpty() for what, df in seen if what == "puestos")


def test_coverage_of_pairs_and_of_the_best(spark):
    """Both forms give what all pairs give, without them."""
    docs = spark.createDataFrame([(i, " ".join(w for j, w in enumerate(["obra", "partida", "metrado", "costo"]) if i >> j & 1)) for i in range(40)], "doc_id bigint, texto string")
    q = spark.createDataFrame([(1, "obra costo"), (2, "partida nada metrado"), (3, "nada")], "qid int, query string")
    every = lexical.coverage(docs, F.col("texto"), q).cache()
    assert got(lexical.coverage_topk(docs, F.col("texto"), q, 3)) == got(lexical.top(every, 3, score="cobertura").select("qid", "doc_id", "cobertura", "rank"))
    pairs = spark.createDataFrame([(1, 9), (1, 1), (1, 0), (2, 2), (2, 2), (3, 5)], "qid int, doc_id bigint")
    assert got(lexical.coverage(docs, F.col("texto"), q, among=pairs)) == got(every.join(pairs.distinct(), ["qid", "doc_id"], "left_semi")) != []
