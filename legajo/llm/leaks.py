"""P2. Evaluation passages inside training texts.

Method: a distributed positional inverted index. Postings (term, text, position) are stored for the terms that occur in
the items; each window of an item is looked up by its rarest term, the lists of its other terms are shifted by their
offsets and intersected. Runs of consecutive item words at exactly their place are phrases; with each word up to `slack` places from
where it should be, counted from the rarest term, they are proximity matches, which inserted, dropped and swapped words don't hide.

Defined cases: null, empty and blank texts have no words and match nothing; items with fewer words than `run` have no
window. Repeated rows and items with equal content all come out, each (text, item) once. Terms that no item holds cannot
take part in a match, so leaving them out of the index loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.text import words_py
from legajo.session import small, spread, written

RUN = 12
#: Distinct item terms up to which the vocabulary travels with the tasks (about 30 bytes each); beyond, a join filters.
VOCABULARY = 500_000
#: Item positions up to which the seeds are broadcast; beyond, the list of each term is joined in so many salted parts.
SEEDS, PARTS = 500_000, 16
#: Places a word of a proximity match may lie away from its own.
SLACK = 3


def _tokens(id_col: str, text_col: str, vocabulary: frozenset[str] | None, run: int, close: bool = True):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, terms, at = [], [], []
            for i, t in zip(b[id_col], b[text_col], strict=True):
                ws = words_py(t)
                if len(ws) < run:
                    continue
                if vocabulary is None:
                    keep = range(len(ws))
                else:
                    # a phrase of `run` words lies within a stretch of at least so many item terms
                    known = [p for p, w in enumerate(ws) if w in vocabulary]
                    keep, a = ([], 0) if close else (known, len(known))
                    for k in range(a + 1, len(known) + 1):
                        if k == len(known) or known[k] != known[k - 1] + 1:
                            if k - a >= run:
                                keep += known[a:k]
                            a = k
                for p in keep:
                    ids.append(i)
                    terms.append(ws[p])
                    at.append(p)
            if ids:
                yield pd.DataFrame({"doc": ids, "term": terms, "pos": at})

    return go


def positions(texts: DataFrame, id_col: str, text_col: str, run: int = 1, vocabulary: frozenset[str] | None = None, close: bool = True) -> DataFrame:
    """The index: (doc, term, pos). With a vocabulary only its terms, and if `close` only in stretches of `run` of them."""
    rows = texts.where(F.length(text_col) >= 2 * run - 1).select(id_col, text_col)
    return spread(rows).mapInPandas(_tokens(id_col, text_col, vocabulary, run, close), "doc bigint, term string, pos int")


def anchors(texts: DataFrame, items: DataFrame, id_col: str, text_col: str, run: int, item_id: str, item_text: str, close: bool, rarest: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held, index, found): positions of the items, of the texts, and (doc, item, pos, ipos) of each window's `rarest` rarest terms."""
    held = written(positions(items, item_id, item_text, run), "reserva")
    terms = held.select("term").distinct()
    vocabulary = frozenset(r.term for r in terms.collect()) if small(terms, VOCABULARY) else None
    index = positions(texts, id_col, text_col, run, vocabulary, close)
    if vocabulary is None:
        index = index.join(terms, "term", "left_semi")
    index = written(index, "indice")
    frequency = index.groupBy("term", "doc").agg(F.lit(1)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # the rarest terms of each window of `run` item words; an absent term ends the search for a window that may miss none
    window = Window.partitionBy("doc").orderBy("pos").rowsBetween(0, run - 1)
    ranked = held.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = F.slice(F.array_sort(F.collect_list(F.struct("df", "pos", "term")).over(window)), 1, rarest)
    seeds = ranked.select(F.col("doc").alias("item"), first.alias("x"), F.count(F.lit(1)).over(window).alias("_n")).where(F.col("_n") == run)
    seeds = seeds.select("item", F.explode("x").alias("x")).where("x.df > 0").select("item", "x.term", F.col("x.pos").alias("ipos")).distinct()
    seeds = written(seeds, "semillas")
    if small(seeds, SEEDS):
        found = index.join(F.broadcast(seeds), "term")
    else:
        # a term of many texts is split by position; its few item positions go to every part
        found = index.withColumn("_s", F.pmod("pos", F.lit(PARTS))).join(seeds.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["term", "_s"])
    return held, index, found.select("doc", "item", "pos", "ipos")


def matches(texts: DataFrame, items: DataFrame, id_col: str = "artifact_id", text_col: str = "content", run: int = RUN, item_id: str = "item_id", item_text: str = "content") -> DataFrame:
    """(doc, item, desde, largo): every maximal run of at least `run` words that text and item share at one offset."""
    held, index, found = anchors(texts, items, id_col, text_col, run, item_id, item_text, True)
    found = written(found.select("doc", "item", (F.col("pos") - F.col("ipos")).alias("delta")).distinct(), "candidatos")
    # offset-adjusted lists: where each item term would lie in the text, against where it lies
    expected = found.join(held.select(F.col("doc").alias("item"), "term", F.col("pos").alias("ipos")), "item").withColumn("pos", F.col("ipos") + F.col("delta"))
    hits = expected.join(index.join(found.select("doc").distinct(), "doc", "left_semi"), ["doc", "pos", "term"])
    w = Window.partitionBy("doc", "item", "delta").orderBy("pos")
    islands = hits.withColumn("_i", F.col("pos") - F.row_number().over(w)).groupBy("doc", "item", "delta", "_i").agg(F.min("pos").alias("desde"), F.count(F.lit(1)).alias("largo"))
    return islands.where(F.col("largo") >= run).select("doc", "item", "desde", "largo")


def near_matches(texts: DataFrame, items: DataFrame, id_col: str = "artifact_id", text_col: str = "content", run: int = RUN, slack: int = SLACK, miss: int = 1, item_id: str = "item_id", item_text: str = "content") -> DataFrame:
    """(doc, item, desde, palabras, movidas): proximity matches, each pair of text and item once, with its longest one.

    A match is a window of `run` item words of which at most `miss` are not in the text and all others within `slack` places of
    their own, counted from an anchor: a place of one of its miss + 1 rarest terms, so a lost word never hides the window.
    `palabras` counts the item words found around the anchor, `movidas` those that are not exactly in place.
    """
    held, index, found = anchors(texts, items, id_col, text_col, run, item_id, item_text, False, miss + 1)
    found = written(found.withColumnsRenamed({"pos": "a", "ipos": "r"}), "anclas")
    wide = 2 * slack + 1
    item = held.select(F.col("doc").alias("item"), "term", F.col("pos").alias("ipos"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - run + 1), F.col("pos") + run - 1)).alias("r"))
    place = F.col("a") + F.col("ipos") - F.col("r")
    expected = found.join(F.broadcast(item) if small(item, SEEDS) else item, ["item", "r"]).withColumn("c", place)
    expected = expected.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((F.col("c") - slack) / wide), F.floor((F.col("c") + slack) / wide)))))
    at = index.withColumn("_b", F.floor(F.col("pos") / wide))
    hits = expected.join(at, ["doc", "term", "_b"]).where(F.abs(F.col("pos") - F.col("c")) <= slack)
    hits = hits.groupBy("doc", "item", "r", "a", "ipos").agg(F.min(F.abs(F.col("pos") - F.col("c"))).alias("lejos"), F.min("pos").alias("pos"))
    # words found in each window that holds the anchor; at most 2 * run - 1 rows meet in an anchor
    w = Window.partitionBy("doc", "item", "r", "a").orderBy("ipos").rangeBetween(-(run - 1), 0)
    full = hits.withColumn("_n", F.count(F.lit(1)).over(w)).groupBy("doc", "item", "r", "a")
    ends = full.agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("palabras"), F.count_if(F.col("lejos") > 0).alias("movidas"), F.min("pos").alias("desde"))
    return ends.where(F.col("_n") >= run - miss).groupBy("doc", "item").agg(F.max(F.struct("palabras", (-F.col("movidas")).alias("m"), (-F.col("desde")).alias("d"))).alias("x")).select("doc", "item", (-F.col("x.d")).alias("desde"), "x.palabras", (-F.col("x.m")).alias("movidas"))


def leaked(texts: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(artifact_id, item_id): each pair once."""
    return matches(texts, items, **how).select(F.col("doc").alias("artifact_id"), F.col("item").alias("item_id")).distinct()
