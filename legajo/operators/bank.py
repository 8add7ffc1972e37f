"""Question bank and constraint queries: questions from templates, publishing, seeds, training sets, trees, checks of catalogues and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.text import strip

# Words that ask for a kind of question, the question and its kind.
TEMPLATES = [
    (["cómo", "como", "paso", "procedimiento", "ingresar", "registrar", "crear", "generar"], "¿Cuál es el procedimiento para {}?", "procedimiento"),
    (["qué es", "concepto", "definición", "tipo", "clase", "categoría"], "¿Qué es {} en el módulo?", "concepto"),
    (["dónde", "donde", "ubicación", "menú", "ruta", "acceso"], "¿Dónde se encuentra la función de {} en el ERP?", "informacion_directa"),
    (["cuándo", "cuando", "fecha", "plazo", "periodo", "vigencia"], "¿Cuándo se debe utilizar {}?", "informacion_directa"),
    (["requisito", "prerrequisito", "permiso", "rol", "acceso"], "¿Qué requisitos son necesarios para usar {}?", "procedimiento"),
    (["error", "problema", "falla", "incidencia", "solución", "solucion"], "¿Qué hacer si ocurre un error en {}?", "problema"),
]
FALLBACK = ("¿Cómo funciona {} en el ERP?", "informacion_directa")
DEICTIC = r"\b(?:este|esta|esto|ese|esa|eso|aquel|aquella|anterior|siguiente|mencionad[oa]|dich[oa])\b"


def template_questions(nodes: DataFrame, most: int = 3) -> DataFrame:
    """(nodo, n, pregunta, tipo) of nodes (nodo, nombre, texto): up to `most` questions whose words the name or text holds, else a general one."""
    low = F.concat_ws(" ", F.lower("nombre"), F.lower("texto"))
    name = F.lower("nombre")
    made = lambda q, k: F.struct(strip(F.concat(F.lit(q.split("{}")[0]), name, F.lit(q.split("{}")[1]))).alias("pregunta"), F.lit(k).alias("tipo"))
    hit = lambda cues: low.rlike("|".join(cues))
    some = F.array_compact(F.array(*[F.when(hit(cues), made(q, k)) for cues, q, k in TEMPLATES]))
    chosen = F.when(F.size(some) > 0, F.slice(F.array_distinct(some), 1, most)).otherwise(F.array(made(*FALLBACK)))
    return nodes.where("nombre is not null").select("nodo", F.posexplode(chosen).alias("n", "x")).select("nodo", (F.col("n") + 1).alias("n"), "x.pregunta", "x.tipo")


def self_contained(c: Column, least: int = 35, most: int = 100) -> Column:
    """Whether a question stands on its own: 35 to 100 characters between ¿ and ?, nothing that points elsewhere."""
    t = strip(c)
    return F.length(t).between(least, most) & t.rlike(r"^¿.*\?$") & ~F.lower(t).rlike(DEICTIC)


def skipped(url: Column, title: Column, prefixes: list[str], titles: list[str]) -> Column:
    """Whether an address begins with one of the prefixes or a title, folded in case, is one of the titles."""
    u = F.lower(strip(url))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.coalesce(u.startswith(p.lower()), F.lit(False))
    return hit | F.coalesce(F.lower(strip(title)).isin([x.lower() for x in titles]), F.lit(False))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of fresh in their place where the keys are equal. Of equal keys in fresh the last by all columns stays."""
    last = fresh.groupBy(*keys).agg(F.max(F.struct(*fresh.columns)).alias("x")).select("x.*")
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last)


def publishable(judged: DataFrame, score: float = 0.9, each: float = 0.85) -> DataFrame:
    """Rows accepted, not yet approved, with the score and every probability of the rubric (map<string,double>) high enough; an empty map is none."""
    every = F.forall(F.map_values("rubricas"), lambda p: F.coalesce(p >= each, F.lit(False)))
    return judged.where((F.col("veredicto") == "aceptada") & ~F.coalesce(F.col("vb"), F.lit(False)) & (F.col("puntaje") >= score) & (F.size("rubricas") > 0) & every)


def seeds_by_node(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(nodo, titulo, n, preguntas): seeds (nodo, pregunta) of each node in order, with the title of its first candidate (nodo, id, titulo)."""
    first = candidates.groupBy("nodo").agg(F.min_by("titulo", "id").alias("titulo"))
    g = seeds.groupBy("nodo").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("pregunta")), "|").alias("preguntas"))
    return g.join(first, "nodo", "left").select("nodo", "titulo", "n", "preguntas")


def training_set(pairs: DataFrame, variants: DataFrame, contexts: DataFrame, every: int = 20) -> DataFrame:
    """(id, variante, pregunta, contexto, respuesta, clase, huella): verified pairs with each of their spellings, and abstentions.

    Every `every`-th pair by hash gets the context of another one and answers that the context holds nothing; which one is taken
    from the hash order, so no row meets all others. pairs: (id, pregunta, respuesta), variants: (id, variante, pregunta),
    contexts: (id, contexto).
    """
    asked = pairs.select("id", F.lit(0).alias("variante"), "pregunta").unionByName(variants.select("id", "variante", "pregunta"))
    good = asked.join(pairs.select("id", "respuesta"), "id").join(contexts, "id").select("id", "variante", "pregunta", "contexto", "respuesta", F.lit("verificada").alias("clase"))
    h = F.md5(F.col("id").cast("string"))
    chosen = contexts.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % every == 0).withColumn("_b", F.substring(h, 9, 1))
    w = Window.partitionBy("_b").orderBy(h, "id")
    other = chosen.withColumn("_o", F.lead("contexto").over(w)).where("_o is not null").select("id", F.col("_o").alias("contexto"))
    bad = pairs.select("id", F.lit(0).alias("variante"), "pregunta").join(other, "id").select("id", "variante", "pregunta", "contexto", F.lit("El contexto no contiene la respuesta.").alias("respuesta"), F.lit("abstencion").alias("clase"))
    return good.unionByName(bad).withColumn("huella", F.sha2(F.concat_ws("\x1f", "pregunta", "contexto", "respuesta"), 256))


def tree(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """(levels, total, hijos): totals of every level of a catalogue and its number of children; deeper levels null above them."""
    out = None
    for i in range(1, len(levels) + 1):
        own = levels[:i]
        agg = [F.sum(value).alias("total"), (F.countDistinct(levels[i]) if i < len(levels) else F.lit(0).cast("bigint")).alias("hijos")]
        part = rows.groupBy(*own).agg(*agg).select(*own, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in levels[i:]], "total", "hijos")
        out = part if out is None else out.unionByName(part)
    return out


def others(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """(grupo, filas, claves): the n groups with most rows, and all the rest as one group 'otros'."""
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("filas"), F.countDistinct(key).alias("claves"))
    first = size.orderBy(F.desc("filas"), F.asc_nulls_first(group)).limit(n)
    named = first.select(F.coalesce(F.col(group), F.lit("(sin)")).alias("grupo"), "filas", "claves")
    rest = size.join(first.select(F.col(group).alias("_g"), F.lit(1).alias("_k")), F.col(group).eqNullSafe(F.col("_g")), "left").where("_k is null")
    return named.unionByName(rest.agg(F.sum("filas").alias("filas"), F.sum("claves").alias("claves")).where("filas is not null").select(F.lit("otros").alias("grupo"), "filas", "claves"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, regla): one row for each rule that a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("regla"))


def step_violations(steps: DataFrame, key: str) -> DataFrame:
    """(key, regla) of procedures (key, n, paso_id, accion, fotos): numbers not consecutive from 1, repeated step ids, blank actions, a photo in two steps."""
    g = steps.groupBy(key).agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count(F.lit(1)).alias("c"), F.countDistinct("n").alias("d"), F.countDistinct("paso_id").alias("i"), F.count_if(F.coalesce(strip(F.col("accion")) == "", F.lit(True))).alias("v"))
    photos = steps.select(key, "n", F.explode(F.array_distinct("fotos")).alias("foto")).groupBy(key, "foto").agg(F.count(F.lit(1)).alias("_k")).groupBy(key).agg(F.max("_k").alias("_k"))
    rows = g.join(photos, key, "left")
    return violations(rows, key, {"numeracion": (F.col("a") == 1) & (F.col("b") == F.col("c")) & (F.col("d") == F.col("c")), "paso_repetido": F.col("i") == F.col("c"), "accion_vacia": F.col("v") == 0, "foto_repetida": F.coalesce(F.col("_k") <= 1, F.lit(True))})


def reference_problems(cites: DataFrame, base: DataFrame) -> DataFrame:
    """(clase, id, manual): citations that name nothing, and rows of the base that nothing cites. Both have (id, manual)."""
    c, b = cites.select("id", "manual").distinct(), base.select("id", "manual").where("id is not null and manual is not null").distinct()
    return c.join(b, ["id", "manual"], "left_anti").select(F.lit("sin_resolver").alias("clase"), "id", "manual").unionByName(b.join(c, ["id", "manual"], "left_anti").select(F.lit("sin_citar").alias("clase"), "id", "manual"))


def concept_sources(cites: DataFrame, base: DataFrame) -> DataFrame:
    """(cita, manual, por): the manual given with a citation (cita, id, manual), else the only one of the base that has its id, else none."""
    only = base.where("id is not null and manual is not null").groupBy("id").agg(F.min("manual").alias("_a"), F.max("manual").alias("_b"))
    j = cites.join(only, "id", "left")
    alone = F.when(F.col("_a") == F.col("_b"), F.col("_a"))
    return j.select("cita", F.coalesce("manual", alone).alias("manual"), F.when(F.col("manual").isNotNull(), "dado").when(alone.isNotNull(), "unico").when(F.col("_a").isNotNull(), "ambiguo").otherwise("falta").alias("por"))


def readable_sources(cites: DataFrame, most: int = 3) -> DataFrame:
    """(manual, secciones, paginas): for each manual its first sections by name, `…` behind `most`, and its pages in order of number."""
    s = cites.groupBy("manual").agg(F.array_sort(F.collect_set(F.nullif(strip(F.col("seccion")), F.lit("")))).alias("s"), F.array_sort(F.collect_set("pagina")).alias("p"))
    shown = F.concat(F.array_join(F.slice("s", 1, most), ", "), F.when(F.size("s") > most, F.lit("…")).otherwise(F.lit("")))
    return s.select("manual", shown.alias("secciones"), F.array_join(F.transform("p", lambda x: x.cast("string")), ", ").alias("paginas"))


def steps_with_photos(rows: DataFrame) -> DataFrame:
    """(fila, n, texto, foto): the steps of each row in order with their first photo that no step before it shows."""
    steps = rows.select("fila", F.posexplode("pasos").alias("n", "x")).select("fila", (F.col("n") + 1).alias("n"), "x.texto", F.posexplode_outer("x.fotos").alias("k", "foto"))
    first = steps.where("foto is not null").groupBy("fila", "foto").agg(F.min(F.struct("n", "k")).alias("a")).groupBy("fila", F.col("a.n").alias("n")).agg(F.min_by("foto", "a.k").alias("foto"))
    return steps.select("fila", "n", "texto").distinct().join(first, ["fila", "n"], "left")


def source_photos(rows: DataFrame, most: int = 3) -> DataFrame:
    """(fila, fotos): the photos of a row's steps, else up to `most` pictures of its page, else its own picture; rows without any fall out."""
    own = F.array_distinct(F.flatten(F.transform("pasos", lambda p: F.coalesce(p.fotos, F.array().cast("array<string>")))))
    page = rows.where("imagen is not null and documento is not null").groupBy("documento", "pagina").agg(F.slice(F.array_sort(F.collect_set("imagen")), 1, most).alias("_p"))
    j = rows.select("fila", "documento", "pagina", "imagen", own.alias("_o")).join(page.withColumnsRenamed({"documento": "_d", "pagina": "_g"}), (F.col("documento") == F.col("_d")) & F.col("pagina").eqNullSafe(F.col("_g")), "left")
    photos = F.when(F.coalesce(F.size("_o") > 0, F.lit(False)), F.col("_o")).when(F.size("_p") > 0, F.col("_p")).when(F.col("imagen").isNotNull(), F.array("imagen"))
    return j.select("fila", F.array_join(photos, ",").alias("fotos")).where("fotos is not null")


def filled_template(template: Column, slots: dict[str, Column]) -> Column:
    """A template with {slots} filled; null if a slot it names is blank. Blanks are squeezed."""
    out, ok = template, F.lit(True)
    for name, value in slots.items():
        v = F.coalesce(strip(value), F.lit(""))
        ok = ok & (~template.contains("{" + name + "}") | (v != ""))
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return F.when(ok, strip(F.regexp_replace(out, r"[ \t]+", " ")))


def rewrite_problems(old: Column, new: Column) -> Column:
    """What a rewritten text must not change: array of numeros, atajos, negritas, lineas, largo."""
    got = lambda c, p, g=0: F.array_sort(F.regexp_extract_all(c, F.lit(p), g))
    more = lambda p: F.size(F.array_except(got(new, p), got(old, p))) > 0
    lines = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: strip(x) != ""))
    return F.array_compact(F.array(
        F.when(more(r"\d+(?:[.,]\d+)*"), F.lit("numeros")), F.when(more(r"(?i)\b(?:ctrl|alt|shift)\+\w+|\bF(?:1[0-2]|[1-9])\b"), F.lit("atajos")),
        F.when(got(old, r"\*\*([^*\n]+)\*\*", 1) != got(new, r"\*\*([^*\n]+)\*\*", 1), F.lit("negritas")), F.when(lines(old) != lines(new), F.lit("lineas")),
        F.when(F.octet_length(new) > 2 * F.octet_length(old) + 80, F.lit("largo")),
    ))
