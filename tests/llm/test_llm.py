"""The training-data operators on small fixtures, against brute force, round trips and defined edge cases."""

import datetime as dt
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from legajo.functions.text import fold, fold_py, words, words_py
from legajo.llm import cuts, endings, leaks, lines, mixes, near, pairs, scans, splits, survivors, tokens

FRAG = "fila bigint, id string, documento string, manual string, titulo string, seccion string, pagina string, fuente string, confianza string, texto string, tipo string, imagen string, url_imagen string, busqueda string, visto timestamp, n int, m string"
LEVELS = [("oficial", 1), ("propio", 2), ("academico", 3)]


def frag(spark, rows):
    """Rows as dicts; the extra columns n and m clash with names the operators use inside."""
    names = [c.split()[0] for c in FRAG.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], FRAG)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def sentence(rng, n):
    return " ".join(rng.choice(["obra", "partida", "costo", "planilla", "almacén", "saldo", "cierre", "compra", "pedido", "grúa", "acero", "piedra"]) + str(rng.randint(0, 30)) for _ in range(n))


def test_words_agree(spark):
    texts = ["Ñandú ÁÉÍ", "café x_y", "", "a1–b2 «c»", None, "Straße Ωmega", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("w"), fold(F.col("t")).alias("f")).collect()
    for r in rows:
        assert (r.w or []) == words_py(r.t)
        assert r.f == (None if r.t is None else fold_py(r.t))


def test_pairs_rules():
    assert pairs.is_empty(None) and pairs.is_empty(" ​") and pairs.is_empty("n/d") and not pairs.is_empty("No.") and not pairs.is_empty("Sí.")
    p = "¿Cómo puedo cerrar la inspección de la cuenta puente?"
    assert pairs.is_copy(p, p.upper()) and pairs.is_copy(p, "Pregunta: " + p) and not pairs.is_copy(p, "No.") and not pairs.is_copy(None, p)


def test_languages():
    m = pairs.Languages({"es": ["el saldo de la partida no se puede cerrar hasta que la firma del documento esté completa"] * 5, "en": ["the balance of the item can not be closed until the document has been signed by the manager"] * 5, **{k: [v] for k, v in pairs.OTHERS.items()}})
    q = "¿Cómo cierro la partida del documento?"
    fr = "Vous devez vérifier les montants avant la fin du mois et corriger la ligne."
    assert pairs.wrong_language(q, fr, m)
    assert not pairs.wrong_language("Respóndeme en francés: ¿qué hago?", fr, m)
    assert not pairs.wrong_language(q, "El saldo de la partida no se puede cerrar hasta que la firma esté completa.", m)


def test_broken_pairs_edges(spark):
    docs = spark.createDataFrame([(1, "texto " * 30, "es", "s")], "doc_id bigint, text string, lang string, source string")
    rows = spark.createDataFrame([(1, None, None), (2, "hola qué tal estás hoy", ""), (3, None, "x " * 50_000), (4, "p", "A:")], "id bigint, prompt string, respuesta string")
    assert {i for i, d in got(pairs.broken(rows, docs)) if d == "vacia"} == {1, 2, 4}
    assert got(pairs.broken(rows.limit(0), docs)) == []


def test_leaks_brute_force(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, 30)) for i in range(6)] + [(6, None), (7, "corto")]
    texts = []
    for i in range(80):
        t = sentence(rng, rng.randint(0, 40))
        if i % 3 == 0:
            w = items[i % 6][1].split()
            n = rng.choice([11, 12, 13, 30])
            a = rng.randint(0, 30 - n)
            t += " " + ", ".join(w[a : a + n]).upper() + " " + sentence(rng, 5)
        texts.append((i, t))
    texts += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1])]
    grams = {}
    for i, t in items:
        w = words_py(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = sorted({(a, j) for a, t in texts for k in range(len(words_py(t)) - 11) for j in grams.get(tuple(words_py(t)[k : k + 12]), ())})
    a = spark.createDataFrame(texts, "artifact_id bigint, content string").withColumn("term", F.lit(1))
    r = spark.createDataFrame(items, "item_id bigint, content string")
    assert got(leaks.leaked(a, r)) == want and len(want) > 15
    assert got(leaks.leaked(a.limit(0), r)) == []


def test_leaks_without_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(leaks, "VOCABULARY", 1)
    r = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id bigint, content string")
    a = spark.createDataFrame([(5, "zz " + " ".join(f"w{i}" for i in range(3, 16))), (6, "w1 w2 w3")], "artifact_id bigint, content string")
    assert got(leaks.leaked(a, r)) == [(5, 1)]


def test_survivors(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        dict(fila=1, id="a", manual="x", confianza="Propio", fuente="http://a", visto=t, texto="uno"),
        dict(fila=2, id="a", manual="x", confianza=" OFICIAL", fuente="://", visto=None, texto=""),
        dict(fila=3, id="a", manual="x", confianza="oficial", fuente="  MANUAL://b", visto=t, texto=None),
        dict(fila=4, id="a", manual="y", confianza="oficial", fuente=None),
        dict(fila=5, id="b", manual="x", confianza="raro", fuente="s/d"),
        dict(fila=6, id="b", manual="x", confianza=None, fuente=None),
        dict(fila=7, id="a", manual=None, confianza="oficial"),
    ]
    lv = spark.createDataFrame(LEVELS, "confianza string, rango int")
    assert got(survivors.best_rows(frag(spark, rows), lv)) == [(1, 3, 3), (5, 0, 0)]
    s = {(r.id, r.manual): r for r in survivors.survivors(frag(spark, rows), lv).collect()}
    assert s[("a", "x")].texto == "uno" and s[("a", "x")].confianza == "oficial" and s[("b", "x")].texto is None
    assert got(survivors.best_rows(frag(spark, []), lv)) == []


def _aged(spark):
    """Three keys change from oficial to academico; the keys z and y hold rows without a timestamp."""
    t = dt.datetime(2024, 1, 1)
    rows = [dict(fila=10 * i + j, id=f"k{i}", manual="x", confianza=c, visto=t + dt.timedelta(days=j), texto=c) for i in range(3) for j, c in enumerate(["oficial", "academico"])]
    rows += [dict(fila=90, id="z", manual="x", confianza="oficial", visto=t, texto="viejo"), dict(fila=91, id="z", manual="x", confianza="academico", visto=None, texto="nuevo")]
    rows += [dict(fila=93, id="y", manual="x", confianza="oficial", texto="viejo"), dict(fila=92, id="y", manual="x", confianza="academico", texto="nuevo")]
    return frag(spark, rows), spark.createDataFrame(LEVELS, "confianza string, rango int")


def test_precedence_places_rows_without_time(spark):
    f, lv = _aged(spark)
    assert ("confianza", "1", "3") in got(survivors.precedence(f, lv))
    told = {r.id: r.texto for r in survivors.survivors(f, lv).collect()}
    assert told["z"] == "nuevo" and told["y"] == "nuevo"
    none = spark.createDataFrame([], "campo string, antes string, despues string")
    told = {r.id: r.texto for r in survivors.survivors(f, lv, order=none).collect()}
    assert told["z"] == "viejo" and told["y"] == "viejo"


def test_order_is_closed_without_cycles(spark):
    edges = spark.createDataFrame([("c", a, b) for a, b in ("12", "23", "34", "56", "67", "75", "48")], "campo string, antes string, despues string")
    want = {("c", a, b) for a, b in itertools.combinations("1234", 2)} | {("c", a, "8") for a in "1234"}
    assert set(got(survivors.closed(edges))) == want


def test_lines(spark):
    foot = "Todos los derechos reservados a la casa"
    head = "Volver al índice general de la guía"
    rows = [dict(fila=i, manual="g", texto=f"{head.upper() if i % 2 else head}\n{foot}\r\nlínea propia número {'abcdefghijklmnopqrst'[i % 20] * (i + 3)}") for i in range(20)]
    rows += [dict(fila=50, manual="h", texto=foot), dict(fila=51, manual=None, texto=foot), dict(fila=52, manual="g", texto=None), dict(fila=53, manual="g", texto="")]
    f = frag(spark, rows)
    assert got(lines.repeated_lines(f)) == sorted((i, k) for i in range(20) for k in (1, 2))
    blocks = got(lines.repeated_blocks(f)[0].select(F.size("bloque"), "filas"))
    assert blocks == [(1, 20), (2, 20)]
    clean = dict(got(lines.without_lines(f, lines.repeated_lines(f)).where("texto is not null")))
    assert clean[0] == "línea propia número aaa" and clean[50] == foot
    assert got(lines.repeated_lines(f.limit(0))) == []


def jaccard(a, b, k=3):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (words_py(a), words_py(b)))
    return len(x & y) / max(1, len(x | y))


@pytest.mark.parametrize("group", [1024, 4])
def test_near_brute_force(spark, group):
    rng = random.Random(5)
    texts = []
    for i in range(30):
        base = sentence(rng, rng.randint(30, 90)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "otra"
            texts.append(" ".join(w))
    texts += [None, "", "corto", texts[0], texts[0].upper()]
    rows = spark.createDataFrame(list(enumerate(texts)), "fila bigint, texto string").withColumn("key", F.lit(1))
    long = [(i, t) for i, t in enumerate(texts) if len(words_py(t)) >= 30]
    want = {(i, j): s for (i, a), (j, b) in itertools.combinations(long, 2) if (s := jaccard(a, b)) >= 0.6}
    found = got(near.near_pairs(rows, group=group))
    assert len(found) == len(set(found)) and set(found) <= set(want)
    assert set(found) >= {p for p, s in want.items() if s >= 0.66} and len(found) >= 0.98 * len(want) > 20
    groups = {r.id: r for r in near.near_groups(rows, group=group).collect()}
    assert all(groups[i].clase == groups[j].clase for i, j in found)
    assert got(near.near_pairs(rows.limit(0))) == []


def test_splits(spark):
    rng = random.Random(2)
    para = ["\n\n".join(" ".join(sentence(rng, 12) + "." for _ in range(6)) for _ in range(n)) for n in (1, 4, 9)]
    texts = [None, "", " \t\r\n", "x" * 1800, "x" * 1801, "x" * 4000, para[1] + "\f" + para[2], para[2], " " * 9 + "y" * 1800 + "\n"]
    f = frag(spark, [dict(fila=i, pagina=["p. 3", None, "007"][i % 3], texto=t) for i, t in enumerate(texts)])
    assert got(splits.oversized(f)) == [(i,) for i, t in enumerate(texts) if t and len(t.strip(" \t\r\n")) > 1800]
    by = {}
    for r in splits.pieces(f).orderBy("fila", "pieza").collect():
        by.setdefault(r.fila, []).append(r)
    for i, t in enumerate(texts):
        body = (t or "").strip(" \t\r\n")
        assert (i in by) == bool(body)
        spans = splits.cuts(body) if body else []
        assert [r.texto for r in by.get(i, [])] == [body[x:y] for x, y in spans]
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(body) and max(y - x for x, y in spans) <= 1800)
        assert all(x < x2 <= y and y - x2 <= 200 and y2 > y for (x, y), (x2, y2) in itertools.pairwise(spans))
    assert by[6][0].pagina == 3 and by[6][-1].pagina == 4


def test_edit_moves_few_pieces():
    rng = random.Random(9)
    text = "\n\n".join(" ".join(sentence(rng, 10) + "." for _ in range(4)) for _ in range(60))
    a = {text[s:e] for s, e in splits.cuts(text)}
    edited = "Una frase nueva al comienzo. " + text
    b = {edited[s:e] for s, e in splits.cuts(edited)}
    assert len(a & b) >= 0.5 * len(a)


@pytest.mark.parametrize("most", [200_000, 1])
def test_scans(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "LINKS", most)
    body = ["El saldo de la partida se recalcula al cierre del periodo", "La coordinadora registra el comprobante en la bandeja"]
    rows = [dict(fila=i, titulo="Cierre mensual de la obra", texto=" ".join(body)) for i in range(30)]
    rows += [
        dict(fila=100, titulo="Cierre mensual de la obra", texto="El sald0 de la part|da se\nCIERRE MENSUAL DE LA 0BRA — GUÍA    4\nrecal-\ncula al cierre del periodo\n- 12 -"),
        dict(fila=101, titulo="Otra", texto="Clave H0 y CO2 en m3\nALCANCE\nTramo norte-\nLa coordinadora registra\nAnexo 4"),
        dict(fila=102, titulo=None, texto=None),
        dict(fila=103, titulo=None, texto=""),
        dict(fila=104, titulo="T", texto="La coordiriadora registra el cornprobante"),
    ]
    f = frag(spark, rows)
    assert got(scans.noise(f)) == [(100, "cabecera"), (100, "caracter"), (100, "guion"), (100, "pagina"), (104, "caracter")]
    t = dict(got(scans.repaired(f).where("texto is not null")))
    assert t[100] == "El saldo de la partida se recalcula al cierre del periodo" and t[101] == rows[31]["texto"] and t[104].endswith("coordinadora registra el comprobante")
    assert got(scans.noise(frag(spark, []))) == []


def test_tokens_round_trip(spark):
    import tiktoken

    texts = [None, "", "   ", "Hola, ¿qué tal?  \n\n  fin", "don't  stop aquí 12345 <|endoftext|>", "日本語 y ñandú́", "a" * 5000, "\t\tx  ", "😀 fin​"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("word", F.lit(1))
    ids = {r.doc_id: list(r.ids) for r in tokens.encode(docs, tokens.word_table(docs), hot=3).collect()}
    ranks = open(tokens.VOCABULARY, "rb").read()
    e = tokens._encoder(ranks)
    assert isinstance(e, tiktoken.Encoding)
    for i, t in enumerate(texts):
        assert ids[i] == e.encode_ordinary(t or "")
    back = dict(got(tokens.decode(tokens.encode(docs, tokens.word_table(docs)))))
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    size = rng.integers(10, 500, 500).astype(float)
    p = np.full(500, 0.37)
    q = mixes.flight(p, size, np.random.default_rng(2))
    open_ = (q > 0) & (q < 1)
    assert open_.sum() <= 3 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3


def test_water_fill():
    part = mixes.water_fill({"a": 1.0, "b": 1.0, "c": 0.0, "d": 2.0}, {"a": 10.0, "b": 1000.0, "d": 0.0}, 100.0)
    assert part["a"] == 10.0 and abs(part["b"] - 90.0) < 1e-9 and part["c"] == 0.0 and part["d"] == 0.0


def test_mix(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 10 + i % 7) for i in range(3000)] + [(9000, None, 5), (9001, "a", 0), (9002, "a", None)], "doc_id bigint, source string, tokens bigint")
    plans = spark.createDataFrame([("p", "a", 3.0, 2, 0.5), ("p", "b", 1.0, 2, 0.5), ("p", "z", 1.0, 2, 0.5), ("q", "c", 1.0, 3, 1.0), ("q", "b", 0.0, 3, 1.0)], "plan string, source string, peso double, max_repeticiones int, fraccion_total double")
    drawn, want = mixes.mix(docs, plans, block=200)
    rows = {(r["plan"], r["source"]): r for r in mixes.shares(drawn, want).collect()}
    for r in rows.values():
        assert abs(r["tokens"] - r["meta"]) <= 30
    assert rows[("p", "z")]["tokens"] == 0 and rows[("q", "b")]["tokens"] == 0
    assert drawn.where("repeticiones > 3").count() == 0 and drawn.groupBy("plan", "doc_id").count().where("count > 1").count() == 0
    assert got(mixes.mix(docs.limit(0), plans)[0]) == []


def test_marks():
    for t in ("hasta el pap…", "hasta el pap ...", "hasta el pap [...]", "hasta el pap (continúa", "hasta el pap ​", 'hasta el pap <a href='):
        assert endings.unmarked(t)[0] == "hasta el pap"
    assert endings.unmarked("fin. (fin del documento)")[0].endswith("documento)")


def test_cuts(spark):
    rng = random.Random(4)
    verbs = ["cierra", "aprueba", "registra", "transfiere"]
    nouns = ["el saldo", "la partida", "el pedido", "la planilla", "el almacén"]
    text = lambda n: " ".join(f"El sistema {rng.choice(verbs)} {rng.choice(nouns)} de {rng.choice(nouns)} al final del periodo." for _ in range(n))
    rows, cut = [], set()
    for i in range(600):
        t = text(rng.randint(2, 9))
        if i % 3 == 0 and len(t) > 260:
            t = t[:250]
            if t.rstrip()[-1] != ".":
                cut.add(i)
        rows.append((i, t, "limitada" if i % 3 == 0 else "libre"))
    rows += [(9001, None, "libre"), (9002, "", "libre"), (9003, "   ", None), (9004, text(3) + "\n\nSaludos,\nMejora", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("bytes", F.lit(1))
    found = {i for (i,) in got(cuts.cut_texts(d))}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 2
    rate = {r.source: r.tasa for r in cuts.rates(d).collect()}
    assert rate["limitada"] > 0.4 > rate["libre"]
    assert got(cuts.cut_texts(d.limit(0))) == []


def test_censored_fit():
    rng = np.random.default_rng(0)
    x = np.minimum(np.exp(rng.normal(6, 0.6, 20_000)).astype(int), 600)
    v, n = np.unique(x, return_counts=True)
    mu, sigma, limits = cuts.fit_lengths(v, n)
    assert set(limits) == {600} and limits[600] > 0.95 and abs(mu - 6) < 0.05 and abs(sigma - 0.6) < 0.05


def test_blocks_longer_than_the_first_depth(spark):
    """A header of 41 lines and its first 20 lines come out whole, with every block that brute force finds."""
    rng = random.Random(9)
    head = [f"renglón fijo del aviso legal {'abcdefghijklmnopqrstuvwxyz'[i % 26] * (1 + i // 26)} de la guía" for i in range(41)]
    texts = [head + ["cuerpo propio " + "xyz"[i % 3] * (i + 3)] for i in range(10)] + [head[:20] + ["otro cuerpo " + "k" * (i + 3)] + head[5 : 5 + rng.randint(1, 9)] for i in range(10)]
    f = frag(spark, [dict(fila=i, manual="g", texto="\n".join(t)) for i, t in enumerate(texts)])
    rows = []
    for t in texts:  # runs of frequent lines
        runs = [[]]
        for x in t:
            runs = [*runs, []] if x not in head else [*runs[:-1], [*runs[-1], x]]
        rows.append([r for r in runs if r])
    suffixes = sorted({(x := tuple(r[i:])) for rs in rows for r in rs for i in range(len(r))})
    holds = lambda b: sum(any(tuple(r[i : i + len(b)]) == b for r in rs for i in range(len(r))) for rs in rows)
    wanted = {b for b in suffixes} | {a[:k] for a, b in itertools.pairwise(suffixes) if (k := sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))) > 0}
    want = sorted((len(b), n) for b in wanted if (n := holds(b)) >= 8)
    out = got(lines.repeated_blocks(f)[0].select(F.size("bloque"), "filas"))
    assert out == want and (41, 10) in out and (20, 20) in out


def test_passes_change_nothing(spark, monkeypatch):
    """Whether the links travel in one pass or in many, texts are reflowed once: a heading after a long paragraph stays apart."""
    words_ = ["partida", "saldo", "comprobante", "bandeja", "coordinadora", "periodo", "cierre", "almacen", "planilla", "modelo"]
    long = "La coordinadora registra el comprobante del saldo en la bandeja de la planilla"
    rows = [dict(fila=i, titulo="T", texto=" ".join(words_) + " " + long) for i in range(40)]
    broken = long.replace("saldo", "sald0").replace("planilla", "p1anilla").replace("bandeja", "bande|a").replace("comprobante", "cornprobante")
    rows += [dict(fila=100 + i, titulo="T", texto=f"{broken}\n{long.replace('registra', 'anota')}\ndel mode1o {i}.\nResumen del a1macen\n- 3 -\n{chr(10).join([long] * 6)}\nde la part|da\n\nfin") for i in range(3)]
    f = frag(spark, rows)
    once = got(scans.repaired(f)), got(scans.noise(f))
    monkeypatch.setattr(scans, "LINKS", 1)
    assert (got(scans.repaired(f)), got(scans.noise(f))) == once and "sald0" not in dict(once[0])[100]


def test_context_picks_the_rarer_original(spark):
    """perriio may be pernio or perruo. Frequency alone says pernio everywhere; the neighbours say perruo in its own phrases."""
    a, b = "ajuste el pernio de la bisagra oxidada antes del montaje", "alimente al perruo del guardian nocturno con carne fresca"
    rows = [dict(fila=i, manual="g", titulo="T", texto=f"{a} numero {i}") for i in range(300)] + [dict(fila=1000 + i, manual="g", titulo="T", texto=f"{b} numero {i}") for i in range(100)]
    rows += [dict(fila=5000, manual="g", titulo="T", texto=b.replace("perruo", "perriio")), dict(fila=5001, manual="g", titulo="T", texto=a.replace("pernio", "perriio"))]
    f = frag(spark, rows)
    told = dict(got(scans.repaired(f).where("fila >= 5000")))
    assert told == {5000: b, 5001: a}
    blind = dict(got(scans.inspected(f, repair=True, vectors=scans.Vectors()).select("fila", "texto").where("fila >= 5000")))
    assert blind == {5000: b.replace("perruo", "pernio"), 5001: a}


def test_misread_letters_without_bounds(spark):
    words_ = ["comprobante", "minimo", "administracion", "modelo", "nnnnuuummmdwbbgo" * 8, "dedo"]
    rng = random.Random(1)
    back = {}
    for g, c in scans.GLYPHS.items():
        back.setdefault(c, []).append(g)
    for o in words_:
        for most in (1, 2, len(o)):
            w, left = "", most
            for c in o:
                if c in back and left:
                    w, left = w + rng.choice(back[c]), left - 1
                else:
                    w += c
            assert scans.misread(w, o) and not scans.misread(o, o) and not scans.misread(w + "x", o)
            pair = spark.createDataFrame([(w, o)], "w string, o string").select(scans.skeleton(F.col("w")), scans.skeleton(F.col("o"))).first()
            assert pair[0] == pair[1]


def test_headers_of_all_forms(spark):
    title, manual = "Centro de costo del área usuaria", "Guía de Aprobaciones"
    lines_ = ["Guía de Aprobaciones / Centro de costo del área usuaria    2", "  Guia de Aprobaciones / Centro de c0sto del área usuaria   ", "CAPÍTUL0 3. CENTRO DE COSTO DEL ÁREA USUARIA", "CENTRO DE COSTO DEL ÁREA USU — GUÍA DE APROBACIONES"]
    no = ["Guía de Aprobaciones", "Centro de costo del área usuaria", "Guía de Compras / Centro de costo del área usuaria", "ALCANCE Y CONDICIONES"]
    assert all(scans.is_header(x.strip(), title, manual) for x in lines_) and not any(scans.is_header(x, title, manual) for x in no)
    rows = [dict(fila=i, documento="d", manual=manual if i else None, titulo=title if i else None, texto=f"uno\n{lines_[0]}\ndos") for i in range(3)] + [dict(fila=9, documento=None, texto=f"uno\n{lines_[0]}\ndos")]
    assert got(scans.noise(frag(spark, rows))) == [(i, "cabecera") for i in range(3)]


def test_blocks_are_removed_with_their_short_lines(spark):
    """A short or blank line goes with a block that spans enough rows, and stays anywhere else."""
    head, foot = "Volver al índice general de la guía", "Todos los derechos reservados a la casa"
    rows = [dict(fila=i, manual="g", texto=f"{head}\n\nCompartir\n{foot}\nCompartir\ncuerpo propio {'xyzw'[i % 4] * (i + 3)}") for i in range(20)]
    rows += [dict(fila=30 + i, manual="g", texto=f"{head}\nSolo aquí {i}\n{foot}\nfin") for i in range(5)]
    f = frag(spark, rows)
    assert got(lines.repeated_lines(f)) == sorted([(i, k) for i in range(20) for k in (1, 4)] + [(30 + i, k) for i in range(5) for k in (1, 3)])
    clean = dict(got(lines.cleaned(f)))
    assert clean[0] == "Compartir\ncuerpo propio xxx" and clean[31] == "Solo aquí 1\nfin"


def test_no_array_no_lines(spark, monkeypatch):
    f = frag(spark, [dict(fila=i, manual="g", texto="Todos los derechos reservados a la casa") for i in range(20)])
    monkeypatch.setattr(lines, "_suffixes", lambda depth: lambda batches: iter(()))
    assert got(lines.repeated_lines(f)) == []


def test_trie_against_all_pairs():
    rng = np.random.default_rng(3)
    most = near.budgets(0.6, 160)
    assert most[0] == 0 and most[10] < 10 and 64 < most[320] < 120 and (np.diff(most) >= 0).all()
    base = rng.integers(0, 2, (12, 320))
    rows = np.concatenate([base[rng.integers(0, 12, 300)] ^ (rng.random((300, 320)) < rng.choice([0.0, 0.05, 0.2, 0.3], (300, 1))), base[:3], base[:3]]).astype(np.uint8)
    bits, node = np.packbits(rows, axis=1), rng.integers(0, 3, len(rows))
    order = near._sorted(bits, node)
    bits, node, rows = bits[order], node[order], rows[order]
    at = np.searchsorted(node, np.arange(4))
    p, q = near.traverse(bits, [(at[:3], at[1:], at[:3], at[1:])], most)
    found = set(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist(), strict=True))
    assert len(found) == len(p)
    sums = {(i, j): np.concatenate([[0], np.cumsum(rows[i] ^ rows[j])]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if node[i] == node[j]}
    sure = {k for k, s in sums.items() if (s <= most).all()}
    assert sure <= found <= {k for k, s in sums.items() if s[-1] <= most[-1]} and 100 < len(found) < len(sums) / 2
    two = near.traverse(bits, [(at[:1], at[1:2], at[1:2], at[2:3])], most)
    cross = {(i, j) for i in range(at[0], at[1]) for j in range(at[1], at[2]) if (np.cumsum(rows[i] ^ rows[j]) <= most[1:]).all()}
    assert cross <= set(zip(*map(np.ndarray.tolist, two), strict=True))


def test_trie_prunes_a_bucket(spark):
    """All texts share every band key by force; only the trie keeps texts apart that are not alike."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (6, 40)).astype(np.uint8)
    near_ = np.concatenate([base ^ (rng.random((6, 40)) < 0.1).astype(np.uint8) for _ in range(5)])
    rows = [(i, [1] * 40, bytes(b)) for i, b in enumerate(near_)]
    sk = spark.createDataFrame(rows, "h bigint, keys array<bigint>, bits binary")
    for group in (1024, 8):
        assert got(near.candidates(sk, group=group)) == sorted((i, j) for i in range(30) for j in range(i + 1, 30) if i % 6 == j % 6)


def test_chain_of_links_ends(spark):
    label, _ = near.linked_labels(spark.createDataFrame([(i, i + 1) for i in range(70)] + [(900, 901)], "a bigint, b bigint"))
    assert got(label) == [(i, 0) for i in range(71)] + [(900, 900), (901, 900)]


def test_limit_decides_open_endings(spark):
    """Texts of whole words without any sign: only the length tells that those of one source were cut."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["obra", "caja"]) for _ in range(n))
    free = lambda: "n" * rng.randint(1, 60) + " " + text(rng.randint(6, 30))
    rows = [(i, free(), "libre") for i in range(400)]
    rows += [(1000 + i, t if len(t := free()) < 99 else text(20), "limitada") for i in range(400)]  # text(20) has 99 characters
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {i for (i,) in got(cuts.cut_texts(d))}
    want = {i for i, t, s in rows if s == "limitada" and len(t) == 99}
    assert len(found & want) > 0.95 * len(want) and len(found - want) < 10
    assert not want & {r.doc_id for r in cuts.judged(d, weight=0.0).where("cortado").collect()}


def test_null_source_is_no_name(spark):
    d = spark.createDataFrame([(i, "una frase que termina. " * (1 + i % 5), "___" if i % 2 else None) for i in range(40)], "doc_id bigint, text string, source string")
    assert {(r.source, r.textos) for r in cuts.rates(d).collect()} == {("___", 20), (None, 20)}


def test_near_matches_brute_force(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, 24)) for i in range(5)]
    texts = []
    for i in range(90):
        w = items[i % 5][1].split()[rng.randint(0, 8) :][: rng.choice([10, 12, 14, 16])]
        for _ in range(i % 4):
            k = rng.randrange(len(w))
            if rng.random() < 0.4:
                w.insert(k, "intruso")
            elif rng.random() < 0.5:
                w[k : k + 2] = w[k : k + 2][::-1]
            else:
                w[k] = "otra"
        texts.append((i, sentence(rng, 4) + " " + " ".join(w) + " " + sentence(rng, 4)))
    texts += [(200, None), (201, ""), (202, "partida " * 3000)]
    run, slack, miss = 12, 3, 1
    split = {i: words_py(t) for i, t in texts if len(words_py(t)) >= run}
    held = {i: words_py(t) for i, t in items}
    df = {w: sum(w in set(ws) for ws in split.values()) for ws in held.values() for w in ws}
    want = set()
    for d, ws in split.items():
        for j, iw in held.items():
            for s in range(len(iw) - run + 1):
                rare = sorted((df[iw[p]], p, iw[p]) for p in range(s, s + run))[: miss + 1]
                for n, r, term in rare:
                    for a in [p for p, w in enumerate(ws) if w == term] if n else []:
                        there = sum(any(ws[p] == iw[k] for p in range(max(0, a + k - r - slack), min(len(ws), a + k - r + slack + 1))) for k in range(s, s + run))
                        if there >= run - miss:
                            want.add((d, j))
    a, r = spark.createDataFrame(texts, "artifact_id bigint, content string"), spark.createDataFrame(items, "item_id bigint, content string")
    found = {(x.doc, x.item): x for x in leaks.near_matches(a, r).collect()}
    assert set(found) == want and len(want) > 40
    exact = set(got(leaks.leaked(a, r)))
    assert exact < want and any(x.movidas for x in found.values())
    assert got(leaks.near_matches(a.limit(0), r)) == []


def test_seeds_without_broadcast(spark, monkeypatch):
    r = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id bigint, content string")
    a = spark.createDataFrame([(5, "zz " + " ".join(f"w{i}" for i in range(3, 16))), (6, "w1 w2 w3")], "artifact_id bigint, content string")
    monkeypatch.setattr(leaks, "SEEDS", 0)
    assert got(leaks.leaked(a, r)) == [(5, 1)]


def test_landing_keeps_expectations():
    p = np.array([0.2, 0.7, 0.45])
    draws = np.array([mixes.land(p, np.random.default_rng(i)) for i in range(4000)])
    assert set(np.unique(draws)) <= {0.0, 1.0} and np.abs(draws.mean(axis=0) - p).max() < 0.03 and set(draws.sum(axis=1)) <= {1.0, 2.0}


def test_pieces_are_checked(spark):
    rng = random.Random(6)
    f = frag(spark, [dict(fila=i, pagina=[None, "p. 4", "x"][i % 3], texto=t) for i, t in enumerate([sentence(rng, 900) + "\f" + sentence(rng, 500), "corto", " ", None, "y" * 5000])])
    assert got(splits.checked(f)) == [(i, 0, len((t or "").strip(" \t\r\n"))) for i, t in [(r.fila, r.texto) for r in f.orderBy("fila").collect()] if (t or "").strip()]
    import unittest.mock

    with unittest.mock.patch.object(splits, "pieces", lambda *a: splits.long_pieces(f).withColumn("desde", F.col("desde") + 1)):
        assert all(r.piezas_mal for r in splits.checked(f).where("fila in (0, 4)").collect())


def test_equal_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "hola obra"), (1, "hola raro"), (None, "obra"), (None, None)], "doc_id bigint, text string")
    e = tokens._encoder(open(tokens.VOCABULARY, "rb").read())
    for hot in (0, 2):
        ids = sorted((r.doc_id or 0, list(r.ids)) for r in tokens.encode(docs, tokens.word_table(docs), hot=hot).collect())
        assert ids == sorted((i or 0, e.encode_ordinary(t or "")) for i, t in [(1, "hola obra"), (1, "hola raro"), (None, "obra"), (None, None)])
        n = sorted((r.doc_id or 0, r.tokens) for r in tokens.token_counts(docs, tokens.word_table(docs), hot=hot).collect())
        assert n == sorted((i, len(x)) for i, x in ids)


def test_refusals_are_learned(spark):
    """Phrases that no labelled sentence holds are learned from answers that share other words with refusals."""
    rng = random.Random(2)
    helps = [f"Abra la ficha de {sentence(rng, 3)}, elija el periodo {i} y pulse F7 para grabar {sentence(rng, 4)}." for i in range(3000)]
    ways = ["Sobre {} corro un tupido velo.", "De {} ni una palabra saldrá.", "Lo de {} se queda en el tintero."]
    ends_ = ["", " Gracias por tu comprensión.", " Consulte con su administrador.", " No puedo ayudarte con eso."]
    declines = [rng.choice(ways).format(sentence(rng, 2)) + rng.choice(ends_) for i in range(60)]
    model = pairs.fit_refusals(helps + declines, helps[:20])
    unseen = [w.format("la grúa vieja") for w in ways]
    assert all(model.odds(x) >= pairs.MARGIN for x in unseen)
    assert all(model.odds(x) < pairs.MARGIN for x in [*helps[:200], "No.", "Sí, con F7.", "No puedo ver tu base, pero el procedimiento es claro. " + helps[0], "Lo siento por la demora: " + helps[1]])
    rows = spark.createDataFrame([(i, "¿Cómo cierro la partida?", x) for i, x in enumerate(unseen)], "id bigint, prompt string, respuesta string")
    docs = spark.createDataFrame([(1, "texto " * 30, "es", "s")], "doc_id bigint, text string, lang string, source string")
    assert sorted(got(pairs.broken(rows, docs, refusals=model))) == [(i, "rechazo") for i in range(3)]
    assert not [d for _, d in got(pairs.broken(rows, docs, refusals=pairs.Refusals({}, 0.0))) if d == "rechazo"]


def test_buckets_are_joined_within_bounds():
    """60 buckets of 500 texts, 7.5 million pairs: what a worker holds does not grow with them, and batches may end inside a bucket."""
    import tracemalloc

    import pyarrow as pa

    rng, most = np.random.default_rng(9), near.budgets(0.6, 160)
    base = rng.integers(0, 2, (60, 1, 320), dtype=np.uint8)
    bits = np.packbits((base ^ (rng.random((60, 500, 320), dtype=np.float32) < 0.05)).astype(np.uint8).reshape(-1, 320), axis=1)
    key, h = np.repeat(np.arange(60), 500), np.arange(30_000)
    batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + 7001]), pa.array(h[i : i + 7001]), pa.array([b.tobytes() for b in bits[i : i + 7001]])], ["key", "h", "bits"]) for i in range(0, 30_000, 7001))
    tracemalloc.start()
    found = sum(b.num_rows for b in near._join(most)(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 60 * 500 * 499 // 2 and peak < 120e6


def test_inner_ngrams_of_all_texts(spark):
    """Counts cover every distinct text, copies once, however many there are; the places are those of plain slicing."""
    from legajo.llm import endings

    rng = random.Random(4)
    texts = [f"{i} del fin y el ünal fin 𝒳 {sentence(rng, 6)} del fin" for i in range(120)]
    rows = spark.createDataFrame(list(enumerate([*texts, *texts[:5], None, "corto"])), "id int, t string")
    model = endings.fit(rows, "id", "t", per=60)
    want = Counter(g for t in map(endings.plain, texts) for k in endings.ORDERS for i in range(len(t) - k) if (g := t[i : i + k]) in model.ends)
    assert model.inner == pytest.approx({g: n / 2 for g, n in want.items()}) and len(want) > 5
    assert model.n_ends == pytest.approx(60) and model.n_inner == pytest.approx(sum(map(len, map(endings.plain, texts))) / 2) and model.scale == pytest.approx(0.5)


def test_refusals_from_all_answers(spark):
    """One pass over the table for each round gives what the same answers give in memory, and every answer takes part."""
    rng = random.Random(8)
    own = [f"{sentence(rng, 8)} {i}" for i in range(60)] + [f"Ese dato queda fuera de mi alcance, no puedo ayudarte con {sentence(rng, 3)} {i}" for i in range(20)]
    others = [sentence(rng, 20) for _ in range(10)]
    rows = spark.createDataFrame([(i, None, a) for i, a in enumerate([*own, own[0], None])], "id int, prompt string, respuesta string").repartition(3)
    want, found = pairs.fit_refusals(own, others), pairs.learned_refusals(rows, None, others)
    assert found.prior == pytest.approx(want.prior) and {k: v for k, v in found.table.items() if abs(v) > 1e-9} == pytest.approx({k: v for k, v in want.table.items() if abs(v) > 1e-9})
    assert len(want.table) > 20
