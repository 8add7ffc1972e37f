"""Stored index and the searches over it: BM25F, parameter sweeps, hybrid lists, passes, second orderings.

The index is built once and saved as Parquet, cut into buckets of terms, so a search reads the buckets of its own terms
alone. Statistics always cover the whole collection; filters come after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.analysis import terms
from legajo.operators.lexical import B, K1, QUERY_TERMS, few, forward, query_terms, ranked, top
from legajo.operators.vectors import rrf
from legajo.session import small, written

BUCKETS, PARTS = 64, 16


def build(docs: DataFrame, fields: dict[str, Column], analyzer=terms, queries: DataFrame | None = None) -> dict[str, DataFrame]:
    """rows (doc_id, term, field, tf, len), lists of a document's postings; postings (cubo, term, doc_id, field, tf, len), fields (field, mean) over documents that have the field, size (n).

    An index for `queries` alone, which is not stored, keeps the postings of their terms, if these are few enough; lengths, means and size are those of the whole texts.
    """
    rows, means = forward(docs, fields, analyzer, None if queries is None else few(queries, analyzer))
    post = rows.select("doc_id", F.explode(F.arrays_zip("term", "field", "tf", "len")).alias("p")).select("doc_id", "p.*")
    post = post.select(_bucket().alias("cubo"), "term", "doc_id", "field", "tf", "len")
    return {"rows": rows, "postings": post, "fields": means, "size": docs.agg(F.count(F.lit(1)).alias("n"))}


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def save(index: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """As Parquet; buckets become folders, a large bucket several files. The version is written last."""
    index["postings"].repartition(F.col("cubo"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).write.mode("overwrite").partitionBy("cubo").parquet(f"{path}/postings")
    for name in ("fields", "size"):
        index[name].write.mode("overwrite").parquet(f"{path}/{name}")
    index["size"].select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{path}/_index_version")


def load(spark: SparkSession, path: str, version: int = 1) -> dict[str, DataFrame]:
    got = spark.read.parquet(f"{path}/_index_version").first()
    if got is None or got.version != version:
        raise ValueError(f"index version {got and got.version}, wanted {version}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("postings", "fields", "size")}


def sweep(index: dict[str, DataFrame], queries: DataFrame, settings: list[tuple[float, float]], k: int = 10, weights: dict[str, float] | None = None, allowed: DataFrame | None = None, analyzer=terms, general: tuple[DataFrame, int] | None = None, boost: DataFrame | None = None) -> DataFrame:
    """(k1, b, qid, doc_id, score, rank) under several constants; the postings of the query terms are read once for all of them.

    `allowed` (doc_id) filters after the statistics. `general` is (term, df) and the number of documents of a larger
    collection; terms that it lacks keep their own frequency. `boost` (doc_id, factor) multiplies the scores of its documents.
    """
    rows = index.get("rows")
    if rows is None:  # a stored index: the buckets of the query terms, put together by document once
        wanted = query_terms(queries, analyzer).select("term").distinct().withColumn("cubo", _bucket())
        hits = index["postings"].join(F.broadcast(wanted) if small(wanted, QUERY_TERMS) else wanted, ["cubo", "term"], "left_semi")
        rows = written(hits.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in ("term", "field", "tf", "len")]), "aciertos")
    x = F.element_at(F.array(*[F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")) for k1, b in settings]), F.col("x") + 1)
    found = ranked(rows, index["fields"], index["size"].first().n, queries, k, settings, weights, allowed, analyzer, general, boost)
    return found.withColumn("x", x).select("x.k1", "x.b", "qid", "doc_id", "score", "rank")


def search(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, **how) -> DataFrame:
    """(qid, doc_id, score, rank)."""
    return sweep(index, queries, [(k1, b)], k, **how).select("qid", "doc_id", "score", "rank")


def best_chunks(found: DataFrame, document: Column, k: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank): of a ranking of chunks the first one of each document, at most k documents."""
    first = found.withColumn("_d", document).groupBy("qid", "_d").agg(F.min("rank").alias("_r"), F.min_by("score", "rank").alias("score"))
    w = Window.partitionBy("qid").orderBy("_r")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", F.col("_d").alias("doc_id"), "score", "rank")


def hybrid(lexical: DataFrame, vector: DataFrame, k: int = 10, vector_weight: float = 0.1, lexical_weight: float = 1.0, constant: int = 60, most: int = 50) -> DataFrame:
    """(qid, doc_id, score, rank): both rankings, cut at max(most, k), by weighted reciprocal ranks; without one list the other alone."""
    n = max(most, k)
    cut = lambda df: df.where(F.col("rank") <= n)
    return rrf({"vector": (cut(vector), vector_weight), "lexico": (cut(lexical), lexical_weight)}, k, constant)


def passes(lists: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """(qid, doc_id, pase, orden): union of several rankings, each cut at its own length; a document keeps its first pass.

    `orden` runs through the passes in the order given, so an equal score later on falls to the earlier pass.
    """
    out = None
    for i, (name, df, n) in enumerate(lists):
        part = df.where(F.col("rank") <= n).select("qid", "doc_id", F.struct(F.lit(i).alias("i"), F.col("rank").alias("r"), F.lit(name).alias("pase")).alias("x"))
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("qid", "doc_id").agg(F.min("x").alias("x"))
    w = Window.partitionBy("qid").orderBy("x.i", "x.r", "doc_id")
    return one.select("qid", "doc_id", "x.pase", F.row_number().over(w).alias("orden"))


def cascade(ranked: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(qid, margen, reordenar): whether the first two scores are so close that a second ordering pays; one candidate never does."""
    two = ranked.where("rank <= 2").groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    gap = F.round((F.col("a") - F.col("b")) / F.col("a"), 9)
    return two.select("qid", F.when(F.col("a") > 0, gap).alias("margen"), F.coalesce(F.when(F.col("a") > 0, gap < threshold), F.lit(False)).alias("reordenar"))


def class_rerank(ranked: DataFrame, logits: DataFrame, n: int = 20, odds: float = 0.6 / 0.4) -> DataFrame:
    """(qid, doc_id, rank, puntaje, nuevo, empate): the first n by the logistic of an outside logit, the others behind in their order.

    `empate` marks the queries whose two best logits lie closer than the given odds. Without a logit a row stays behind.
    """
    s = ranked.join(logits, ["qid", "doc_id"], "left").withColumn("_in", (F.col("rank") <= n) & F.col("logit").isNotNull() & ~F.isnan("logit"))
    w = Window.partitionBy("qid").orderBy(F.desc("_in"), F.when(F.col("_in"), -F.col("logit")), "rank")
    s = s.withColumn("nuevo", F.row_number().over(w)).withColumn("_next", F.lead(F.when(F.col("_in"), F.col("logit"))).over(w))
    tie = F.max(F.when(F.col("nuevo") == 1, F.col("logit") - F.col("_next") < F.log(F.lit(odds)))).over(Window.partitionBy("qid"))
    return s.select("qid", "doc_id", "rank", F.when(F.col("_in"), F.round(1 / (1 + F.exp(-F.col("logit"))), 9)).alias("puntaje"), "nuevo", F.coalesce(tie, F.lit(False)).alias("empate"))


def class_retrieval(lexical: DataFrame, vector: DataFrame, covered: DataFrame, k: int = 10, n: int = 30) -> DataFrame:
    """(qid, doc_id, puntaje, rank): first n of both lists by reciprocal ranks; the score is the coverage, or half of it and half of the similarity.

    covered: (qid, doc_id, cobertura). A negative similarity counts as none.
    """
    fused = hybrid(lexical.where(F.col("rank") <= n), vector.where(F.col("rank") <= n), k, vector_weight=1.0)
    sim = vector.where(F.col("rank") <= n).select("qid", "doc_id", F.col("score").alias("_s"))
    c = F.coalesce("cobertura", F.lit(0.0))
    score = F.when(F.col("_s").isNull(), c).otherwise(0.5 * c + 0.5 * F.greatest(F.lit(0.0), F.col("_s")))
    return fused.drop("score").join(sim, ["qid", "doc_id"], "left").join(covered, ["qid", "doc_id"], "left").select("qid", "doc_id", F.round(score, 6).alias("puntaje"), "rank")


def eligible_first(fused: DataFrame, lexical: DataFrame, eligible: DataFrame) -> DataFrame:
    """(qid, doc_id, orden): eligible documents only, the fused order first, those of the lexical list alone behind."""
    both = fused.select("qid", "doc_id", F.lit(0).alias("i"), "rank").unionByName(lexical.select("qid", "doc_id", F.lit(1).alias("i"), "rank")).join(eligible, "doc_id", "left_semi")
    one = both.groupBy("qid", "doc_id").agg(F.min(F.struct("i", "rank")).alias("x"))
    return one.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("x", "doc_id")).alias("orden"))


def or_input_order(ranked: DataFrame, score) -> tuple[DataFrame, bool]:
    """(ranking, degraded): score(ranking) gives (qid, doc_id, nota) and reorders; where it fails the input order stays."""
    from legajo.operators.routing import rerank

    try:
        return rerank(ranked, written(score(ranked), "notas")), False
    except Exception:  # any failure of an outside scorer
        return ranked.select("qid", "doc_id", "rank", F.col("rank").alias("nuevo"), F.lit(False).alias("reordenado")), True


__all__ = ["best_chunks", "build", "cascade", "class_rerank", "class_retrieval", "eligible_first", "hybrid", "load", "or_input_order", "passes", "save", "search", "sweep", "top"]
