"""Readers and writers: JSON lines strict and tolerant, folders of documents, front matter, sitemaps, snapshots, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAGMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "documento", "manual", "titulo", "seccion", "pagina", "fuente", "confianza", "texto", "tipo", "imagen", "url_imagen", "busqueda")]
    + [T.StructField("pasos", T.ArrayType(T.StructType([T.StructField("texto", T.StringType()), T.StructField("fotos", T.ArrayType(T.StringType()))])))]
)
VIDEO = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "documento", "tipo", "canal", "video", "desde", "hasta", "url", "texto")] + [T.StructField("segundos", T.ArrayType(T.LongType()))])
#: Extensions of a document folder and folders that are passed over.
EXTENSIONS = ("md", "txt", "html", "htm", "pdf", "json", "jsonl", "py", "go", "sql", "yaml", "yml")
IGNORED = ("node_modules", "vendor", "__pycache__")
INDEX_VERSION = 1


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a file, a folder or a glob; no file gives no rows. A bad line gives a row in `_corrupt_record`; `_archivo` names the file, `_lugar` the place in it."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    if not _exists(spark, path):
        empty = spark.createDataFrame([], T.StructType([*full.fields, T.StructField("_archivo", T.StringType())]))
        return empty.withColumn("_lugar", F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("n")))
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # lines of one split are read in order, splits of one file follow each other by their start
    at = F.struct(F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n")).alias("_lugar")
    return lines.select(F.col("_metadata.file_name").alias("_archivo"), at, row.alias("r")).select("r.*", "_archivo", "_lugar")


def tolerant(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], main: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): the first row of each key, and bad lines and repeats with their file. Files go by name, `main` before all."""
    raw = read_jsonl(spark, path, schema).withColumn("_n", F.struct((~F.col("_archivo").eqNullSafe(F.lit(main))).alias("m"), F.col("_archivo").alias("a"), F.col("_lugar").alias("l")))
    good = raw.where("_corrupt_record is null")
    first = good.groupBy(*keys).agg(F.min("_n").alias("_f"))
    marked = good.join(first, keys).withColumn("_dup", F.col("_n") != F.col("_f"))
    problems = raw.where("_corrupt_record is not null").select("_archivo", F.lit("linea").alias("clase"), F.col("_corrupt_record").alias("dato")).unionByName(
        marked.where("_dup").select("_archivo", F.lit("repetido").alias("clase"), F.to_json(F.struct(*keys)).alias("dato"))
    )
    return marked.where("not _dup").select(*schema.names), problems


def strict(spark: SparkSession, path: str, schema: T.StructType, filled: list[str]) -> DataFrame:
    """Every line must parse and every field of `filled` hold text, else the read fails."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in filled:
        df = df.withColumn(c, F.when(F.length(F.trim(c)) > 0, F.col(c)).otherwise(F.raise_error(F.lit(f"empty {c}"))))
    return df


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def folder(spark: SparkSession, path: str, most: int = 5 << 20) -> DataFrame:
    """(clave, version, bytes, contenido) of the documents below a folder (local or s3a); larger files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = raw.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*EXTENSIONS) & (F.col("length") <= most) & ~F.col("path").rlike(r"/(?:\.[^/]+|" + "|".join(IGNORED) + ")/"))
    return kept.select(F.col("path").alias("clave"), F.sha2("content", 256).alias("version"), F.col("length").alias("bytes"), F.col("content").alias("contenido"))


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, titulo, cuerpo) of markdown files that may begin with a block between lines of three hyphens."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("archivo"), "value")
    head = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n", 1)
    return raw.select("archivo", F.nullif(F.trim(F.regexp_extract(head, r"(?m)^t[ií]t(?:ulo|le)\s*:\s*(.+)$", 1)), F.lit("")).alias("titulo"), F.regexp_replace("value", r"(?s)^---\r?\n.*?\r?\n---\r?\n", "").alias("cuerpo"))


def sitemap_urls(pages: DataFrame, host: str) -> DataFrame:
    """(url): distinct addresses of the <loc> elements in `xml` whose host ends with `host`."""
    from legajo.operators.chunking import normal_url

    u = pages.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("u"))
    n = u.select(normal_url(F.col("u")).alias("url")).where(F.col("url").isNotNull())
    return n.where(F.regexp_extract("url", r"^https://([^/]+)", 1).endswith(host)).distinct()


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, url): addresses of anchors, frames, embeds and objects, in `file=` parameters too."""
    a = F.regexp_extract_all(html, F.lit(r"""(?is)<(?:a|iframe|embed|object)\b[^>]*?\b(?:href|src|data)\s*=\s*["']([^"'#]+)"""), 1)
    inner = F.regexp_extract_all(html, F.lit(r"""(?i)[?&]file=([^"'&]+)"""), 1)
    return pages.select(key, F.explode(F.array_distinct(F.concat(a, F.transform(inner, F.url_decode)))).alias("url")).where("url != ''")


def save_snapshot(tables: dict[str, DataFrame], path: str, version: int = INDEX_VERSION) -> None:
    """Index tables as Parquet; the version is written last, so a broken write is not taken for an index."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version int").write.mode("overwrite").parquet(f"{path}/_index_version")


def load_snapshot(spark: SparkSession, path: str, names: list[str], version: int = INDEX_VERSION) -> dict[str, DataFrame]:
    got = spark.read.parquet(f"{path}/_index_version").first()
    if got is None or got.version != version:
        raise ValueError(f"index version {got and got.version}, wanted {version}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def jdbc(spark: SparkSession, url: str, query: str, seconds: int = 15, **options: str) -> DataFrame:
    """A read-only query of another database, ended after `seconds`."""
    return spark.read.format("jdbc").options(url=url, query=query, queryTimeout=str(seconds), **options).load()


def unified(fragments: DataFrame, videos: DataFrame) -> DataFrame:
    """Fragments and video rows in one schema; a video gives its title and its time mark."""
    v = videos.select("id", "documento", F.col("canal").alias("manual"), F.col("video").alias("titulo"), F.col("desde").alias("pagina"), F.col("url").alias("fuente"), "texto", F.coalesce("tipo", F.lit("video")).alias("tipo"))
    return fragments.unionByName(v, allowMissingColumns=True)


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(carpeta, archivos, bytes) of the files below a folder, by the folder they lie in; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return raw.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("carpeta")).agg(F.count(F.lit(1)).alias("archivos"), F.sum("length").alias("bytes"))


def save_state(df: DataFrame, path: str) -> None:
    """Write a small state beside its old copy and put it in its place at once, so a reader sees one or the other."""
    spark = df.sparkSession
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = P(f"{path}.nuevo"), P(path)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}.nuevo")
    gone = P(f"{path}.viejo")
    fs.delete(gone, True)
    if fs.exists(old):
        fs.rename(old, gone)
    if not fs.rename(new, old):
        raise OSError(f"cannot put {path}.nuevo in place")
    fs.delete(gone, True)


def report(df: DataFrame, title: str, kind: str = "md", most: int = 500) -> str:
    """A report of at most `most` rows as json, md or html; what is left out is said at the end. The rows of a report are presentation."""
    import html
    import json

    rows = [list(r) for r in df.limit(most + 1).collect()]
    cut, names = len(rows) > most, df.columns
    rows = rows[:most]
    text = lambda v: "" if v is None else str(v)
    if kind == "json":
        return json.dumps({"titulo": title, "columnas": names, "filas": [[v if isinstance(v, int | float | bool | None) else text(v) for v in r] for r in rows], "truncado": cut}, ensure_ascii=False)
    if kind == "html":
        e = lambda v: html.escape(text(v))
        body = "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows)
        return f"<h1>{e(title)}</h1><table><tr>{''.join(f'<th>{e(n)}</th>' for n in names)}</tr>{body}</table>" + (f"<p>Solo {most} filas.</p>" if cut else "")
    if kind != "md":
        raise ValueError(kind)
    cell = lambda v: text(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(map(cell, names)) + " |", "|" + "-|" * len(names), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join([*lines, *(["", f"Solo {most} filas."] if cut else [])])


TRACE = "id string, ts string, modelo string, origen string, ms bigint, estado string, correcta boolean, preguntas array<struct<id:string,tipo:string,instrucciones:string,confianza:double>>"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a JSON lines file or folder in the nested form of TRACE; a missing file has none."""
    schema = T._parse_datatype_string(TRACE)
    return read_jsonl(spark, path, schema).where("_corrupt_record is null").select(*schema.names)


def joined_traces(traces: DataFrame, questions: DataFrame) -> DataFrame:
    """The nested form from two tables: traces (id, …) and questions (trace_id, id, tipo, instrucciones, confianza); traces without questions have an empty array."""
    q = questions.groupBy(F.col("trace_id").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("id", "tipo", "instrucciones", "confianza"))).alias("preguntas"))
    empty = F.array().cast("array<struct<id:string,tipo:string,instrucciones:string,confianza:double>>")
    return traces.join(q, F.col("id") == F.col("_t"), "left").drop("_t").withColumn("preguntas", F.coalesce("preguntas", empty))
