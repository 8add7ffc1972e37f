"""Deterministic samples: hash splits, quotas, round robin, proportional quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _shuffled(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def split(df: DataFrame, key: str, test: int = 5, valid: int = 5) -> DataFrame:
    """df with `parte`: test, valid or train by the hash of the key, so variants of one key stay together."""
    b = F.conv(F.substring(_shuffled(key), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("parte", F.when(b < test, "test").when(b < test + valid, "valid").otherwise("train"))


def quota(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Up to n rows of each group, by hash order. Spark limits each group before the shuffle."""
    w = Window.partitionBy(group).orderBy(_shuffled(key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def round_robin(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Up to n rows of each group with `orden`: first rows of all groups, then second rows, and so on; each round is a partition of its own."""
    some = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_r") <= n)
    rounds = some.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))  # at most n rows
    before = rounds.select(F.col("_r").alias("_q"), "_n").join(F.broadcast(rounds.select("_r")), F.col("_q") < F.col("_r")).groupBy("_r").agg(F.sum("_n").alias("_before"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy(F.asc_nulls_first(group)))
    return some.withColumn("_p", place).join(F.broadcast(before), "_r", "left").withColumn("orden", (F.coalesce("_before", F.lit(0)) + F.col("_p")).cast("bigint")).drop("_r", "_p", "_before")


def proportional(sizes: DataFrame, group: str, size: str, total: int, least: int = 1) -> DataFrame:
    """(group, cupo): quotas by the square root of the size, at least `least`, summing to `total` by the largest remainders."""
    whole = sizes.agg(F.sum(F.sqrt(size)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not whole.n:
        return sizes.select(group, F.lit(least).cast("bigint").alias("cupo"))
    room = max(0.0, float(total) - least * whole.n)
    share = sizes.withColumn("_x", F.lit(room) * F.sqrt(size) / F.lit(whole.t or 1.0)).withColumn("_f", F.floor("_x")).withColumn("_d", F.round(F.col("_x") - F.col("_f"), 6))
    left = max(0, int(total - least * whole.n - (share.agg(F.sum("_f")).first()[0] or 0)))
    more = share.orderBy(F.desc("_d"), group).limit(left).select(group, F.lit(1).alias("_k"))
    return share.join(more, group, "left").select(group, (least + F.col("_f") + F.coalesce("_k", F.lit(0))).cast("bigint").alias("cupo"))


def diverse(rows: DataFrame, group: str, key: str, traits: list[str], n: int) -> DataFrame:
    """Up to n rows of each group with `orden`: the first row of each value of the first trait, then of the second, then the rest, by key."""
    turn = F.lit(len(traits))
    for i in range(len(traits) - 1, -1, -1):
        turn = F.when(F.row_number().over(Window.partitionBy(group, traits[i]).orderBy(key)) == 1, F.lit(i)).otherwise(turn)
    w = Window.partitionBy(group).orderBy("_t", key)
    return rows.withColumn("_t", turn).withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= n).drop("_t")


def without_repeats(rows: DataFrame, text: Column, group: str, key: str, n: int) -> DataFrame:
    """The first row of each equal text over all groups, up to n of each group by key; `text` is the form that is compared, blank ones fall out."""
    first = rows.withColumn("_k", text).where("_k <> ''").groupBy("_k").agg(F.min_by(F.struct(*rows.columns), key).alias("x")).select("x.*")
    w = Window.partitionBy(group).orderBy(key)
    return first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
