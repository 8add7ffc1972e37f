"""P8. Token ids of a whole corpus under a public byte-level vocabulary.

Method: a table of distinct words. Texts are split by the vocabulary's own pattern in Spark, each distinct word is encoded
once, and its ids are joined back by position. Frequent words (a bounded list) travel to the texts; every other word is
joined by shuffle, so no word that a third of all texts contain is sent to one task. Only the places of those words, and
the lists that have one, are shuffled; a text never is.

Defined cases: null and empty texts give an empty list, blank texts are encoded as they are. Equal texts give equal
lists, rows with equal or null ids come out once each. Strings that look like special tokens are ordinary text. Empty input gives
empty output.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.session import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with the vocabulary, in Java's notation: white space is spelled out, the most frequent kinds come first.
SPLIT = r" ?\p{L}+| ?\p{N}+|'(?:[sdmt]|ll|ve|re)| ?[^\s\x{85}\p{Z}\p{L}\p{N}]+|[\s\x{85}\p{Z}]+(?![^\s\x{85}\p{Z}])|[\s\x{85}\p{Z}]+"
#: The same for the worker that encodes single words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most frequent words that travel to every task: about 100 bytes each.
HOT = 50_000

_encoders: dict = {}


def _encoder(ranks: bytes):
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def split(c: Column) -> Column:
    """The words of a text in order, blanks included; joined they give the text again."""
    return F.regexp_extract_all(c, F.lit(SPLIT), 0)


def word_table(texts: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, n, ids): each distinct word, its occurrences and its ids."""
    ranks = Path(vocabulary).read_bytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoder(ranks)
        for b in batches:
            b["ids"] = [e._encode_single_piece(w.encode()) for w in b["word"]]
            yield b

    counts = texts.where(F.length(text_col) > 0).select(F.explode(split(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.mapInPandas(encode, "word string, n bigint, ids array<int>")


def _hot(table: DataFrame, hot: int) -> dict[str, list[int]]:
    return {r.word: list(r.ids) for r in table.orderBy(F.desc("n"), "word").limit(hot).select("word", "ids").collect()}


def _flat(words: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, list[str], np.ndarray]:
    """All words of a batch, where each row's words begin and end among them, the distinct ones, and which one stands where."""
    flat = words.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False))])
    code = flat.dictionary_encode()
    return flat, ends, code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running sum of n at the ends of the rows."""
    return np.concatenate([[0], np.cumsum(n)])[ends]


def _parts(hot: dict[str, list[int]], keep: list[str]):
    """Ids of the known words, -1 for others; each distinct word of a batch is looked up once, the rest is done on whole arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends, distinct, at = _flat(b.column("ws"))
            lists = [hot.get(w) for w in distinct]
            cold = np.array([x is None for x in lists], dtype=bool)
            size = np.array([1 if x is None else len(x) for x in lists], dtype=np.int64)
            values = np.array([i for x in lists for i in (x if x is not None else (-1,))], dtype=np.int32)
            n = size[at]
            place = np.repeat((np.cumsum(size) - size)[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids = pa.ListArray.from_arrays(pa.array(_sums(n, ends), pa.int32()), pa.array(values[place], pa.int32()))
            gone = cold[at]
            colds = pa.ListArray.from_arrays(pa.array(_sums(gone, ends), pa.int32()), flat.filter(pa.array(gone)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids, colds], [*keep, "ids", "cold"])

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists with the ids of other words in their places; `found` has them in the order of the places."""
    for b in batches:
        ids, found = b.column("ids"), b.column("found").flatten()
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        inner = found.field("ids")
        size = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        open_ = np.flatnonzero(flat == -1)
        n = np.ones(len(flat), dtype=np.int64)
        n[open_] = size
        start = np.cumsum(n) - n
        out = np.empty(n.sum(), dtype=np.int32)
        known = flat != -1
        out[start[known]] = flat[known]
        out[np.repeat(start[open_] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = inner.flatten().to_numpy(zero_copy_only=False)
        full = pa.ListArray.from_arrays(pa.array(_sums(n, ends), pa.int32()), pa.array(out, pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), full], ["doc_id", "ids"])


def _split_rows(texts: DataFrame, id_col: str, text_col: str, keep: list[str]) -> tuple[DataFrame, str]:
    rows = texts.select(F.monotonically_increasing_id().alias("_r"), F.col(id_col).alias("doc_id"), *keep, F.when(F.length(text_col) > 0, split(F.col(text_col))).alias("ws"))
    return rows, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "ws")


def encode(texts: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, ids) of every row. `table` is read twice: written() spares encoding again."""
    rows, kind = _split_rows(texts, id_col, text_col, [])
    parts = written(rows.mapInArrow(_parts(_hot(table, hot), ["_r", "doc_id"]), kind + ", ids array<int>, cold array<string>"), "partes")
    places = parts.where(F.size("cold") > 0).select("_r", F.posexplode("cold").alias("pos", "word"))
    found = places.join(table.select("word", "ids"), "word").groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("found"))
    whole = parts.where(F.size("cold") == 0).select("doc_id", "ids")
    rest = parts.where(F.size("cold") > 0).select("_r", "doc_id", "ids").join(found, "_r").select("doc_id", "ids", "found")
    return whole.unionByName(rest.mapInArrow(_filled, whole.schema))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), through a join of ids with their pieces; an empty list gives an empty text."""
    spark = encoded.sparkSession
    pieces = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())]
    table = spark.createDataFrame(pieces, "id int, piece binary")
    rows = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(table), "id", "left")
    hexed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy("doc_id").agg(F.decode(F.unhex(hexed), "UTF-8").alias("text"))


def _counts(hot: dict[str, int], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends, distinct, at = _flat(b.column("ws"))
            size = np.array([hot.get(w, -1) for w in distinct], dtype=np.int64)[at]
            gone = size < 0
            sums = np.diff(_sums(np.where(gone, 0, size), ends))
            colds = pa.ListArray.from_arrays(pa.array(_sums(gone, ends), pa.int32()), flat.filter(pa.array(gone)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sums, pa.int64()), colds], [*keep, "_n", "cold"])

    return run


def token_counts(texts: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, *keep, tokens) of every row, 0 for null and empty texts. No list of ids is made."""
    keep = keep or []
    rows, kind = _split_rows(texts, id_col, text_col, keep)
    sizes = {w: len(ids) for w, ids in _hot(table, hot).items()}
    parts = written(rows.mapInArrow(_counts(sizes, ["_r", "doc_id", *keep]), kind + ", _n bigint, cold array<string>"), "partes")
    cold = parts.where(F.size("cold") > 0).select("_r", F.explode("cold").alias("word")).groupBy("_r", "word").agg(F.count(F.lit(1)).alias("k"))
    more = cold.join(table.select("word", F.size("ids").alias("s")), "word").groupBy("_r").agg(F.sum(F.col("k") * F.col("s")).alias("_m"))
    return parts.join(more, "_r", "left").select("doc_id", *keep, (F.col("_n") + F.coalesce("_m", F.lit(0))).cast("bigint").alias("tokens"))
