"""Vector retrieval and classification over unit vectors, all in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.operators.lexical import top
from legajo.session import small

#: Query vectors up to which they are broadcast (64 doubles each); beyond, blocks of them are joined in turn.
QUERIES = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; null for the zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine_topk(base: DataFrame, queries: DataFrame, k: int = 10, allowed: Column | None = None) -> DataFrame:
    """(qid, doc_id, score, rank). base: (doc_id, v), queries: (qid, v), both of unit length. A query never finds itself.

    `allowed` is a condition on base, such as a metadata field's value; k below 1 counts as 1.

    The stated query set is compared with all rows: a broadcast of the queries, in blocks if there are many.
    """
    k = max(1, k)
    base = base if allowed is None else base.where(allowed)
    queries = queries.select("qid", F.col("v").alias("_q"))
    blocks = [queries] if small(queries, QUERIES) else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for n in [1 + queries.count() // QUERIES] for i in range(n)]
    out = None
    for q in blocks:
        s = base.join(F.broadcast(q), F.col("doc_id") != F.col("qid")).select("qid", "doc_id", F.round(dot(F.col("v"), F.col("_q")), 6).alias("score"))
        best = top(s, k)
        out = best if out is None else out.unionByName(best)
    return out


def class_best(base: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, label, score): greatest similarity of each class over all rows of base (doc_id, v, label); the query itself apart.

    The stated query set meets all rows through a broadcast, in blocks if it is large; only the best of each class leaves a task.
    """
    n = 1 if small(queries, QUERIES) else 1 + queries.count() // QUERIES
    out = None
    for i in range(n):
        q = queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i).select("qid", F.col("v").alias("_q"))
        s = base.join(F.broadcast(q), F.col("doc_id") != F.col("qid")).groupBy("qid", "label").agg(F.round(F.max(dot(F.col("v"), F.col("_q"))), 6).alias("score"))
        out = s if out is None else out.unionByName(s)
    return out


def class_scores(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, label, score): greatest similarity of each class among the neighbours found."""
    return neighbours.join(labels, "doc_id").groupBy("qid", "label").agg(F.max("score").alias("score"))


def centroids(labelled: DataFrame) -> DataFrame:
    """(label, c): normalised sum of the unit vectors of each class."""
    parts = labelled.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    v = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return v.select("label", unit(F.col("c")).alias("c"))


def nearest_centroid(base: DataFrame, centres: DataFrame) -> DataFrame:
    """(doc_id, label, score) of the closest class; classes are few, so they are broadcast."""
    s = base.select("doc_id", "v").join(F.broadcast(centres)).select("doc_id", "label", F.round(dot(F.col("v"), F.col("c")), 6).alias("score"))
    return s.groupBy("doc_id").agg(F.max_by(F.struct("label", "score"), F.struct(F.col("score"), -F.col("label"))).alias("b")).select("doc_id", "b.label", "b.score")


def leave_one_out(base: DataFrame) -> DataFrame:
    """(doc_id, clase, nota) of each vector (doc_id, v, label): the closest class by the sum of its vectors without the row's own.

    Classes are few, so their sums are broadcast; a class with no other vector has no sum. Ties go to the smaller class.
    """
    parts = base.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    sums = parts.groupBy(F.col("label").alias("clase")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))
    own = F.when(F.col("label") == F.col("clase"), F.lit(1.0)).otherwise(0.0)
    rest = F.zip_with("s", "v", lambda s, x: s - own * x.cast("double"))
    d = base.join(F.broadcast(sums)).withColumn("_w", rest).withColumn("_n", F.sqrt(dot(F.col("_w"), F.col("_w")))).where("_n > 1e-9")
    d = d.select("doc_id", "clase", F.round(dot(F.col("v"), F.col("_w")) / F.col("_n"), 6).alias("nota"))
    return d.groupBy("doc_id").agg(F.min(F.struct((-F.col("nota")).alias("n"), "clase")).alias("x")).select("doc_id", "x.clase", (-F.col("x.n")).alias("nota"))


def rrf(lists: dict[str, tuple[DataFrame, float]], k: int = 10, constant: int = 60) -> DataFrame:
    """(qid, doc_id, score, rank): weighted reciprocal rank fusion; ties by best single rank, then doc_id."""
    union = None
    for name, (ranked, weight) in lists.items():
        part = ranked.select("qid", "doc_id", F.lit(name).alias("lista"), F.col("rank").alias("r"), (F.lit(weight) / (constant + F.col("rank"))).alias("s"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("qid", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"), F.min("r").alias("_best"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("qid").orderBy(F.desc("score"), "_best", "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_best")
