"""Incremental maintenance: latest rows, differences, identities, pending work, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(columns: list[str]) -> Column:
    """Ascending, nulls first: the greatest is the last."""
    return F.struct(*[x for c in columns for x in (F.col(c).isNotNull().alias(f"{c}_"), F.col(c))])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregation with partial results first, so hot keys are reduced before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), _order(order)).alias("_r")).select("_r.*")


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def diff(before: DataFrame, now: DataFrame, key: str, version: str) -> DataFrame:
    """(key, accion): nuevo, cambiado, igual or borrado."""
    b, n = before.select(key, F.col(version).alias("_b")), now.select(key, F.col(version).alias("_n"))
    kind = F.when(F.col("_b").isNull(), "nuevo").when(F.col("_n").isNull(), "borrado").when(F.col("_b") == F.col("_n"), "igual").otherwise("cambiado")
    return b.join(n, key, "full_outer").select(key, kind.alias("accion"))


def replace(stored: DataFrame, fresh: DataFrame, actions: DataFrame, key: str, prefix: str | None = None) -> DataFrame:
    """Stored rows without deleted and changed keys, with the fresh rows of new and changed ones; deletes may be limited to a prefix."""
    gone = actions.where(F.col("accion").isin("borrado", "cambiado"))
    if prefix is not None:
        gone = gone.where((F.col("accion") != "borrado") | F.col(key).startswith(prefix))
    put = actions.where(F.col("accion").isin("nuevo", "cambiado"))
    return stored.join(gone, key, "left_anti").unionByName(fresh.join(put, key, "left_semi"))


def pending(links: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Links that are not done yet; null links are no work."""
    return links.where(F.col(key).isNotNull()).join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def identity(df: DataFrame, key: str, content: str, order: str, version: str = "") -> DataFrame:
    """(order, clave): the first row keeps its id, rows with other contents than the one before get a hash suffix, repeats fall out.

    The suffix is the start of sha256(content + NUL + version). The first content comes out again, with its suffix, if it returns
    after another one. Aggregations only, so a hot id is reduced before the shuffle.
    """
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    v = df.where(F.col(key).isNotNull()).select(F.col(order), F.col(key), F.sha2(F.concat(F.coalesce(F.col(content), F.lit("")), nul, F.lit(version)), 256).alias("v"))
    per = v.groupBy(key, "v").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    first = per.groupBy(key).agg(F.min_by("v", "lo").alias("v1"), F.min("lo").alias("lo1"))
    marked = per.join(first, key)
    second = marked.where("v <> v1").groupBy(key).agg(F.min("lo").alias("lo2"))
    again = marked.where("v = v1").join(second, key).where("hi > lo2").select(key, "v", "lo2")
    again = v.join(again, [key, "v"]).where(F.col(order) > F.col("lo2")).groupBy(key, "v").agg(F.min(order).alias(order))
    suffixed = marked.where("v <> v1").select(key, "v", F.col("lo").alias(order)).unionByName(again)
    return first.select(F.col("lo1").alias(order), F.col(key).alias("clave")).unionByName(suffixed.select(order, F.concat(F.col(key), F.lit("-"), F.substring("v", 1, 12)).alias("clave")))


def collisions(named: DataFrame) -> DataFrame:
    """(clave) of keys that two rows of identity() share: a suffixed id that another row has as its own."""
    return named.groupBy("clave").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("clave")


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """One row that changes with any id: count and sums of two hashes, so nothing is gathered."""
    return df.agg(F.count(key).alias("n"), F.bit_xor(F.xxhash64(key)).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit("s"), key), F.lit(1 << 31))).alias("s"))


def delta(before: DataFrame, now: DataFrame, by: str) -> DataFrame:
    """(by, antes, ahora, cambio) of the counts of two snapshots."""
    a, b = (x.groupBy(by).agg(F.count(F.lit(1)).alias(n)) for x, n in ((before, "antes"), (now, "ahora")))
    j = a.join(b, by, "full_outer").fillna(0, ["antes", "ahora"])
    return j.withColumn("cambio", F.col("ahora") - F.col("antes"))


def crawl_state(rows: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """(key, huella, cambio): 16 hex digits of the hash of the last content of each address, and whether it ever changed."""
    h = rows.where(F.col(key).isNotNull()).withColumn("_h", F.substring(F.sha2(F.coalesce(F.col(content), F.lit("")), 256), 1, 16))
    per = h.groupBy(key, "_h").agg(F.max(_order(order)).alias("_o"))
    return per.groupBy(key).agg(F.max_by("_h", "_o").alias("huella"), (F.count(F.lit(1)) > 1).alias("cambio"))


def member_first(rows: DataFrame, key: str, walled: str, order: list[str]) -> DataFrame:
    """The last row of each address, but a page behind a wall never replaces one that could be read."""
    o = F.struct((~F.coalesce(F.col(walled), F.lit(False))).alias("open"), _order(order).alias("o"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), o).alias("_r")).select("_r.*")


def fingerprints(rows: DataFrame, by: str, ident: str, order: str) -> DataFrame:
    """(by, huella): sha256 of the ids of each group in order, end to end; the ids of one group meet in one place."""
    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, ident))).alias("x"))
    return g.select(by, F.sha2(F.array_join(F.transform("x", lambda r: r[ident]), ""), 256).alias("huella"))


def stale(now: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """(by) whose stored fingerprint is missing or another."""
    return now.join(stored.select(by, F.col("huella").alias("_s")), by, "left").where(~F.col("huella").eqNullSafe(F.col("_s"))).select(by)
