"""P9. Sources mixed to target weights.

Method: cube-method balanced sampling. Each plan's wanted tokens are split over its sources by weight; a source that cannot
reach its part within the allowed repetitions gives all it may, and the rest goes to the others. The ratio of wanted tokens to the
source's tokens is a whole number of repetitions plus a fraction; the fraction is the inclusion probability of every document of
the source. The probabilities move through the null space of two constraints (sum of probabilities, sum of tokens) until each is 0
or 1: first inside blocks of a few thousand documents, then over what the blocks left (at most two documents each), again in
blocks until one block holds all of a source. Landing gives up the balance of tokens for the last documents, then draws the very
last by its probability, so every document keeps its inclusion probability.

Defined cases: weights that are null, negative or zero, and sources without tokens, get nothing. Documents without tokens are never
drawn. A null source belongs to no plan. Shares of an empty plan are null. Draws depend on the document id alone.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.session import written

BLOCK = 4_096


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase on one block: probabilities with at most three left strictly between 0 and 1."""
    p = p.astype(float).copy()
    eps = 1e-9
    todo = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    active, rest = todo[:3], todo[3:][::-1]
    scale = float(size.mean()) or 1.0
    while len(active) == 3:
        a = np.array([[1.0, 1.0, 1.0], size[active] / scale])
        u = np.cross(a[0], a[1])
        if np.abs(u).max() < 1e-12:  # equal sizes leave a plane; any direction in it serves
            u = np.array([1.0, -1.0, 0.0])
        q = p[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        step = up if rng.random() < down / (up + down) else -down
        q = np.clip(q + step * u, 0.0, 1.0)
        q[q < eps], q[q > 1 - eps] = 0.0, 1.0
        p[active] = q
        active = [i for i in active if 0.0 < p[i] < 1.0]
        while len(active) < 3 and rest:
            active.append(rest.pop())
    return p


def land(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing phase: the sum of the probabilities is kept until one is left, which is drawn; expectations stay."""
    p = p.astype(float).copy()
    open_ = [int(i) for i in np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))]
    while len(open_) > 1:
        i, j = open_[:2]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        step = up if rng.random() < down / (up + down) else -down
        p[i], p[j] = p[i] + step, p[j] - step
        open_ = [k for k in open_ if 1e-9 < p[k] < 1 - 1e-9]
    for i in open_:
        p[i] = float(rng.random() < p[i])
    return np.round(p)


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block; the only block of its source is landed too."""
    pdf = pdf.sort_values(["doc_id", "tokens"])
    rng = np.random.default_rng(int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF)
    out = pdf.copy()
    out["p"] = flight(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(dtype=float), rng)
    if int(pdf["bloques"].iloc[0]) == 1:
        out["p"] = land(out["p"].to_numpy(), rng)
    return out


def water_fill(weights: dict[str, float], room: dict[str, float], wanted: float) -> dict[str, float]:
    """Parts of `wanted` by weight, none above its room; what does not fit goes to the others by their weights."""
    part = {s: 0.0 for s in weights}
    open_ = {s for s, w in weights.items() if w > 0 and room.get(s, 0) > 0}
    left = wanted
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if part[s] + left * weights[s] / total >= room[s] - 1e-9}
        if not full:
            for s in open_:
                part[s] += left * weights[s] / total
            break
        for s in full:
            part[s] = room[s]
        left = wanted - sum(part.values())
        # the open sources are filled from zero again, so that their parts keep the proportion of their weights
        open_ -= full
        left += sum(part[s] for s in open_)
        for s in open_:
            part[s] = 0.0
    return part


def targets(plans: DataFrame, sizes: DataFrame) -> DataFrame:
    """(plan, source, peso, max_repeticiones, disponible, meta): tokens wanted of each source of each plan.

    The plans are collected, since they are written by hand, and the sizes of the sources that they name.
    """
    spark = plans.sparkSession
    total = float(sizes.agg(F.sum("tokens")).first()[0] or 0)
    named = plans.select("source").where("source is not null").distinct()
    have = {r.source: float(r.tokens or 0) for r in sizes.join(F.broadcast(named), "source", "left_semi").collect()}
    rows = []
    by: dict[str, list] = {}
    for r in plans.where(F.col("plan").isNotNull()).collect():
        by.setdefault(r.plan, []).append(r)
    for plan, rs in sorted(by.items()):
        w = {r.source: max(0.0, r.peso or 0.0) for r in rs if r.source is not None}
        reps = {r.source: max(0, r.max_repeticiones or 0) for r in rs}
        part = water_fill(w, {s: have.get(s, 0.0) * reps[s] for s in w}, total * float(rs[0].fraccion_total or 0.0))
        rows += [(plan, s, w[s], reps[s], have.get(s, 0.0), part[s]) for s in w]
    return spark.createDataFrame(rows, "plan string, source string, peso double, max_repeticiones int, disponible double, meta double")


def mix(documents: DataFrame, plans: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(drawn, targets). documents: (doc_id, source, tokens). drawn: (plan, doc_id, source, tokens, repeticiones)."""
    docs = documents.where((F.col("tokens") > 0) & F.col("source").isNotNull())
    sizes = documents.where("source is not null or tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    want = targets(plans, sizes)
    ratio = want.where("meta > 0").select("plan", "source", (F.col("meta") / F.col("disponible")).alias("r"))
    rows = docs.join(F.broadcast(ratio), "source").select("plan", "doc_id", "source", "tokens", F.floor(F.col("r") + 1e-9).cast("int").alias("base"), F.greatest(F.lit(0.0), F.col("r") - F.floor(F.col("r") + 1e-9)).alias("p"))
    kind = "plan string, doc_id bigint, source string, tokens bigint, base int, p double, bloques int, b int"
    settled, rest = rows.where("p <= 1e-9").withColumn("p", F.lit(0.0)), rows.where("p > 1e-9")
    while True:
        # as many blocks as each source needs; one row for each source of each plan
        sizes = written(rest.groupBy("plan", "source").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("bloques")), "bloques")
        most = sizes.agg(F.max("bloques")).first()[0] or 0
        if not most:
            break
        cut = rest.join(F.broadcast(sizes), ["plan", "source"]).withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(int(most))), F.col("bloques")).cast("int"))
        flown = written(cut.select("plan", "doc_id", "source", "tokens", "base", "p", "bloques", "b").groupBy("plan", "source", "b").applyInPandas(_fly, kind), "vuelo").drop("b", "bloques")
        settled = settled.unionByName(flown.where("p = 0 or p = 1"))
        if most == 1:
            break
        rest = flown.where("p > 0 and p < 1")
    drawn = settled.withColumn("repeticiones", F.col("base") + F.col("p").cast("int"))
    return drawn.where("repeticiones > 0").select("plan", "doc_id", "source", "tokens", "repeticiones"), want


def shares(drawn: DataFrame, want: DataFrame) -> DataFrame:
    """(plan, source, peso, meta, tokens, documentos, parte_meta, parte_real) of every source of every plan."""
    real = drawn.groupBy("plan", "source").agg(F.sum(F.col("tokens") * F.col("repeticiones")).alias("tokens"), F.count(F.lit(1)).alias("documentos"))
    both = want.join(real, ["plan", "source"], "left").fillna(0, ["tokens", "documentos"])
    per = both.groupBy("plan").agg(F.sum("tokens").alias("_t"), F.sum("peso").alias("_p"))
    return both.join(F.broadcast(per), "plan").select("plan", "source", "peso", F.round("meta", 3).alias("meta"), "tokens", "documentos", F.try_divide("peso", "_p").alias("parte_meta"), F.try_divide("tokens", "_t").alias("parte_real"))
