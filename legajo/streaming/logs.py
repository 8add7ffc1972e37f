"""Event logs as streams: append-only files in, windowed counts with late data, state by conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream over a folder of JSON lines; only whole files are seen, `files` of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def windowed_counts(events: DataFrame, when: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(inicio, by, n) by event time; rows later than `late` are dropped. Works on streams and on batches."""
    e = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    return e.groupBy(F.window(when, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("inicio"), by, "n")


def sessions(events: DataFrame, when: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(by, inicio, fin, n) of bursts without a pause of `gap`."""
    e = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    return e.groupBy(by, F.session_window(when, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), "n")


def deduplicated(events: DataFrame, when: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """First delivery of each key within the watermark."""
    return events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late).dropDuplicatesWithinWatermark(keys)


def step_memory(memory: dict, text: str | None) -> tuple[dict, str]:
    """One turn of a conversation: what is done with the procedure in memory.

    memory: {"tema": current procedure or "", "paso": its step, "espera": a suspended procedure and its step}. Rules in order: a
    named procedure opens one (the open one is suspended), "siguiente" advances, "ya hice hasta el paso n" completes up to n, "volver"
    resumes the suspended one, "cancelar" closes; anything else leaves the memory as it is.
    """
    import re

    from legajo.functions.text import fold_py

    f = fold_py(text or "")
    now = dict(memory)
    if m := re.search(r"\bprocedimiento (?:de |para )?(\w+)", f):
        if now.get("tema"):
            now["espera"] = (now["tema"], now["paso"])
        now.update(tema=m[1], paso=1)
        return now, "abrir"
    if now.get("tema"):
        if m := re.search(r"\b(?:hasta el|complete el|hice el|ya el) paso (\d+)", f):
            now["paso"] = int(m[1]) + 1
            return now, "completar"
        if re.search(r"\bsiguiente\b|\bcontinua\b|\blisto\b", f):
            now["paso"] += 1
            return now, "avanzar"
        if re.search(r"\bcancelar\b|\bolvida\b", f):
            now.update(tema="", paso=0)
            return now, "cerrar"
    if now.get("espera") and re.search(r"\bvolver\b|\bvolvamos\b|\bretomar\b", f):
        tema, paso = now.pop("espera")
        now.update(tema=tema, paso=paso)
        return now, "retomar"
    return now, "nada"


def _memory(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    tema, paso, otro, otro_paso = state.get if state.exists else ("", 0, "", 0)
    memory = {"tema": tema, "paso": paso} | ({"espera": (otro, otro_paso)} if otro else {})
    rows = []
    for part in parts:
        for turn, text in part.sort_values("turno")[["turno", "texto"]].itertuples(index=False):
            memory, action = step_memory(memory, text)
            rows.append((key[0], turn, action, memory["tema"], memory["paso"]))
    otro, otro_paso = memory.get("espera", ("", 0))
    state.update((memory["tema"], memory["paso"], otro, otro_paso))
    yield pd.DataFrame(rows, columns=["conv", "turno", "accion", "tema", "paso"])


def conversation_memory(turns: DataFrame) -> DataFrame:
    """(conv, turno, accion, tema, paso) of a stream of (conv, turno, texto), state kept for each conversation."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return turns.groupBy("conv").applyInPandasWithState(_memory, "conv string, turno int, accion string, tema string, paso int", "tema string, paso int, otro string, otro_paso int", "append", GroupStateTimeout.NoTimeout)


def conversation_memory_batch(turns: DataFrame) -> DataFrame:
    """As conversation_memory(), over stored turns. A conversation is one person's, so one group fits a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        memory: dict = {"tema": "", "paso": 0}
        rows = []
        for conv, turn, text in pdf.sort_values("turno")[["conv", "turno", "texto"]].itertuples(index=False):
            memory, action = step_memory(memory, text)
            rows.append((conv, turn, action, memory["tema"], memory["paso"]))
        return pd.DataFrame(rows, columns=["conv", "turno", "accion", "tema", "paso"])

    return turns.groupBy("conv").applyInPandas(run, "conv string, turno int, accion string, tema string, paso int")
