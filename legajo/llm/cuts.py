"""P10. Texts cut off by a field limit or in mid-transfer.

Method: for each source a log-normal distribution of lengths, right-censored at candidate limits, is fitted by maximum
likelihood (expectation maximisation over the length histogram). A candidate limit is a length at which the histogram
stands out; the share of the texts there that the fitted distribution does not explain is their censoring posterior. The log odds
of the ending (endings.py) hold for a text of any length; to them are added those of the place, which is the posterior at a limit and
the rate of cuts at other lengths elsewhere, against the rate of all texts. So an open ending counts for more at a limit and for
less away from any. A text that ends with a closing sign gains nothing from its place.

Lengths are taken in characters, in characters without marks after the cut, and in UTF-8 bytes, since fields are limited
in any of these. Histograms hold one row for each source and length, whatever the number of texts.

Defined cases: null, empty and blank texts are not cut (nothing shows that something is missing). A null source is a
source of its own. Repeated texts come out once for each row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm import endings
from legajo.llm.endings import Endings
from legajo.session import small, spread, written

#: Texts at a length from which it may be a limit, and how often as many as around it.
PEAK, TIMES, AROUND = 5, 6.0, 25
MEASURES = ("largo", "limpio", "bytes")
CLOSED = ".!?»)”\"]`"
#: A posterior counts as no surer than this.
SURE = 0.99
#: Limits up to which they are broadcast.
BROADCAST_ROWS = 100_000


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, s, h, t in zip(b["doc_id"], b["source"], b["h"], b["text"], strict=True):
            if not t or not t.strip():
                continue
            body, marked = endings.unmarked(t)
            if not body.strip():
                continue
            rows.append((i, s, h, len(t), len(body), len(t.encode("utf-8", "surrogatepass")), endings.tail(body), marked, not marked and body[-1] in CLOSED))
        yield pd.DataFrame(rows, columns=["doc_id", "source", "h", *MEASURES, "cola", "marca", "cerrado"])


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, source, h, lengths, cola, marca, cerrado): hash of the text, its end, whether a mark follows or a closing sign ends it."""
    kind = "doc_id bigint, source string, h bigint, largo int, limpio int, bytes int, cola string, marca boolean, cerrado boolean"
    rows = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "source", F.xxhash64("text").alias("h"), "text")
    return spread(rows).mapInPandas(_measured, kind)


def _odds(model: Endings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["indicio"] = [model.tail_odds(t) for t in b["cola"]]
            yield b.drop(columns=["cola", "h"])

    return run


def fit_lengths(length: np.ndarray, count: np.ndarray) -> tuple[float, float, dict[int, float]]:
    """(mu, sigma, {limit: censoring posterior}) of one histogram."""
    order = np.argsort(length)
    x, n = length[order].astype(float), count[order].astype(float)
    at = {int(v): c for v, c in zip(x, n, strict=True)}
    limits = []
    for v, c in at.items():
        if c >= PEAK and v >= 16:
            near = sum(at.get(w, 0.0) for w in range(v - AROUND, v + AROUND + 1) if w != v) / (2 * AROUND)
            if c >= TIMES * max(near, 0.2):
                limits.append(v)
    y = np.log(np.maximum(x, 1.0))
    total = n.sum()
    mu = float(np.average(y, weights=n))
    sigma = max(0.2, float(np.sqrt(np.average((y - mu) ** 2, weights=n))))
    at_limit = np.isin(x, limits)
    cut = np.where(at_limit, 0.9 * n, 0.0)
    for _ in range(25):
        # texts cut at a limit would have been longer: their logarithms are replaced by the mean above it
        z = (y[at_limit] - mu) / sigma
        above = np.maximum([0.5 * math.erfc(v / math.sqrt(2)) for v in z], 1e-12)
        hazard = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / above
        e1 = mu + sigma * hazard
        e2 = sigma * sigma * (1 + z * hazard - hazard * hazard) + e1 * e1
        whole, lost = n - cut, cut[at_limit]
        s1, s2 = (whole * y).sum() + (lost * e1).sum(), (whole * y * y).sum() + (lost * e2).sum()
        mu = s1 / total
        sigma = max(0.05, math.sqrt(max(1e-6, s2 / total - mu * mu)))
        z = (y[at_limit] - mu) / sigma
        expected = total * np.exp(-z * z / 2) / (x[at_limit] * sigma * math.sqrt(2 * math.pi))
        cut[at_limit] = np.maximum(0.0, n[at_limit] - expected)
    return float(mu), sigma, {int(v): float(c / k) for v, c, k in zip(x[at_limit], cut[at_limit], n[at_limit], strict=True)}


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    mu, sigma, limits = fit_lengths(pdf["v"].to_numpy(), pdf["n"].to_numpy())
    rows = [(pdf["source"].iloc[0], pdf["medida"].iloc[0], v, p, mu, sigma) for v, p in limits.items()] or [(pdf["source"].iloc[0], pdf["medida"].iloc[0], 0, 0.0, mu, sigma)]
    return pd.DataFrame(rows, columns=["source", "medida", "limite", "posterior", "mu", "sigma"])


def limits(rows: DataFrame) -> DataFrame:
    """(source, medida, limite, posterior, mu, sigma); limite 0 where a source has none."""
    long = rows.select("source", F.explode(F.array(*[F.struct(F.lit(m).alias("medida"), F.col(m).alias("v")) for m in MEASURES])).alias("x")).select("source", "x.medida", "x.v")
    histogram = long.groupBy("source", "medida", "v").agg(F.count(F.lit(1)).alias("n"))
    return histogram.groupBy("source", "medida").applyInPandas(_fit, "source string, medida string, limite int, posterior double, mu double, sigma double")


def judged(documents: DataFrame, weight: float = 1.0) -> DataFrame:
    """(doc_id, source, largo, posterior, indicio, cortado) of every text that is not blank. weight 0 leaves the limits out."""
    read = written(measured(documents), "medidas")
    model = endings.fit(documents, "doc_id", "text", ends=read.where("largo >= 20").dropDuplicates(["h"]).select("cola"))
    kind = ", ".join(f"{c} {k}" for c, k in read.dtypes if c not in ("cola", "h")) + ", indicio double"
    rows = read.mapInPandas(_odds(model), kind)
    found = written(limits(read).where("limite > 0").select("source", "medida", F.col("limite").alias("v"), "posterior"), "limites")
    few = small(found, BROADCAST_ROWS)
    for m in MEASURES:
        at = found.where(F.col("medida") == m).select(F.col("source").alias("_s"), F.col("v").alias("_v"), F.col("posterior").alias(f"_{m}"))
        rows = rows.join(F.broadcast(at) if few else at, rows["source"].eqNullSafe(at["_s"]) & (rows[m] == at["_v"]), "left").drop("_s", "_v")
    rows = written(rows.withColumn("posterior", F.greatest(F.lit(0.0), *[F.coalesce(f"_{m}", F.lit(0.0)) for m in MEASURES])), "juicios")
    # The ending alone is judged for a text anywhere; what is known of the place moves the odds from those of any text.
    ending = F.col("indicio") + F.col("marca").cast("int") * math.log(3.0)
    r = rows.agg(F.avg((ending > 0).cast("int")).alias("a"), F.avg(F.when(F.col("posterior") == 0, (ending > 0).cast("int"))).alias("e")).first()
    anywhere, elsewhere = (min(max(x or 0.0, 1e-3), 0.5) for x in (r.a, r.e))
    p = F.when(F.col("posterior") == 0, F.lit(elsewhere)).otherwise(F.greatest(F.least("posterior", F.lit(SURE)), F.lit(anywhere)))
    limit = F.when(F.col("cerrado"), 0.0).otherwise(F.log(p / (1 - p)) - math.log(anywhere / (1 - anywhere)))
    return rows.select("doc_id", "source", "largo", "posterior", "indicio", (ending + weight * limit > 0).alias("cortado"))


def cut_texts(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts whose rest is missing."""
    return judged(documents).where("cortado").select("doc_id")


def rates(documents: DataFrame) -> DataFrame:
    """(source, textos, cortados, tasa) over the texts that are not blank."""
    j = judged(documents)
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("textos"), F.sum(F.col("cortado").cast("int")).alias("cortados"), F.avg(F.col("cortado").cast("int")).alias("tasa"))
