"""P5. Near copies: pairs of texts whose word runs overlap.

Method: binary trie self-join inside min-hash bands. Each text gets `bands * rows` min-hashes of its runs of three words. Their two
lowest bits form the sketch; the expected share of differing bits of two texts with similarity s is (1 - s) / 2. The sketches
of the texts that are equal in a band form a binary trie. Pairs of its nodes are descended together from (root, root), the bits in which
the prefixes of both nodes differ are added up, and a pair is left as soon as they exceed the budget of the prefix so far. The
budget of a prefix is exceeded by texts of the least similarity with a chance of 1 in two million, so it prunes in the upper
levels too. What arrives at two leaves is checked exactly on the words of both texts.

A bucket with more than `group` texts is split at nodes of its trie, which are counted with partial aggregation, into tasks of
pairs of nodes within the budget, so no bucket is gathered in one task; sketches that agree in all of the first 64 bits
are split by hash. Equal texts are one entry and are expanded at the end only where pairs of rows are asked for.

Recall of the bands is 1 - (1 - s**rows)**bands: 0.996 at 0.6, 0.9996 at 0.65; the budgets lose less than 2 in 10 000 at the least
similarity. Defined cases: null texts and texts with fewer than `min_words` words take no part. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from legajo.functions.text import words_py
from legajo.session import small, spread, written

SHINGLE, MIN_WORDS, SIMILARITY = 3, 30, 0.6
BANDS, ROWS = 40, 4
GROUP = 1024
#: Text classes in candidate pairs up to which they are broadcast (16 bytes each).
ENDS = 200_000
#: Pairs of nodes that a worker descends at once, and pairs of rows that it gives at once.
OPEN, ROOM = 1 << 15, 1 << 18


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[w] = xxh64_intdigest(w)
        out[i] = h
    return out


def shingles(words: list[str], known: dict[str, int], k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct runs of k words."""
    h = _word_hashes(words, known)
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _seeds(n: int) -> np.ndarray:
    return (np.random.default_rng(20240229).integers(1, 1 << 32, size=n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def budgets(similarity: float, hashes: int, loss: float = 5e-7) -> np.ndarray:
    """Bits that may differ in a prefix of 0, 1, ... 2 * hashes bits: texts of this similarity exceed them with a chance below `loss`.

    The first half of a sketch has one bit of each hash, the second half the other one. Bits differ in half of the cases in
    which the hashes do; the two bits of one hash differ independently of each other then.
    """
    u = 1 - similarity


    def sums(chances: list[float]) -> list[np.ndarray]:
        out = [np.ones(1)]
        for _ in range(hashes):
            out.append(np.convolve(out[-1], chances))
        return out

    singles, pairs = sums([1 - u / 2, u / 2]), sums([1 - 3 * u / 4, u / 2, u / 4])
    chances = singles + [np.convolve(pairs[e], singles[hashes - e]) for e in range(1, hashes + 1)]
    return np.array([max(0, int((p[::-1].cumsum()[::-1] > loss).sum()) - 1) for p in chances], dtype=np.int64)


def _sketches(bands: int, rows: int, min_words: int, k: int):
    n = bands * rows
    seeds = _seeds(n)[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        weights = np.uint64(0x100000001B3) ** np.arange(rows, dtype=np.uint64)
        seen: set[int] = set()
        for b in batches:
            ids, keys, bits = [], [], []
            for i, t in zip(b["h"], b["texto"], strict=True):
                if i in seen:  # of equal texts one for each task is enough
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(i)
                ws = words_py(t)
                if len(ws) < min_words:
                    continue
                s = shingles(ws, known, k)
                low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
                # odd multipliers modulo 2**32, then the high half decides: one product for each hash and run
                m = np.empty(n, dtype=np.uint32)
                for a in range(0, len(low), 4096):
                    part = (low[None, a : a + 4096] * seeds).min(axis=1)
                    m = part if a == 0 else np.minimum(m, part)
                mixed = m.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
                mixed ^= mixed >> np.uint64(33)
                key = (mixed.reshape(bands, rows) * weights).sum(axis=1)
                key = key * np.uint64(0x9E3779B97F4A7C15) + np.arange(bands, dtype=np.uint64)
                ids.append(i)
                keys.append(key.view(np.int64))
                bits.append(np.packbits(np.concatenate([mixed & np.uint64(1), (mixed >> np.uint64(1)) & np.uint64(1)]).astype(np.uint8)).tobytes())
            if ids:
                yield pd.DataFrame({"h": ids, "keys": keys, "bits": bits})

    return run


class Trie:
    """Binary trie of sorted sketches, one for each bucket. A node is a range of rows; it is split where its rows first differ."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.width = bits, bits.shape[1] * 8
        pad = -bits.shape[1] % 8
        self.words = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b."""
        out, open_ = np.full(len(a), self.width, dtype=np.int64), np.arange(len(a))
        for w in range(self.words.shape[1]):
            x = self.words[a[open_], w] ^ self.words[b[open_], w]
            hit = x != 0
            if hit.any():
                high = x[hit]
                n = np.zeros(len(high), dtype=np.int64)
                for step in (32, 16, 8, 4, 2, 1):
                    low = (high >> np.uint64(64 - step)) == 0
                    n[low] += step
                    high[low] <<= np.uint64(step)
                out[open_[hit]] = 64 * w + n
                open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def differ(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Differing bits of rows a and b at places from start to end."""
        out = np.zeros(len(a), dtype=np.int64)
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        for w in range(self.words.shape[1]):
            lo, hi = np.clip(start - 64 * w, 0, 64), np.clip(end - 64 * w, 0, 64)
            use = np.flatnonzero(hi > lo)
            if len(use):
                mask = (ones >> lo[use].astype(np.uint64)) ^ np.where(hi[use] < 64, ones >> np.minimum(hi[use], 63).astype(np.uint64), np.uint64(0))
                out[use] += np.bitwise_count((self.words[a[use], w] ^ self.words[b[use], w]) & mask)
        return out

    def halves(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First row of each range [lo, hi) that has a 1 at `depth`; rows before it have a 0."""
        a, b = lo.copy(), hi.copy()
        word, place = depth // 64, (63 - depth % 64).astype(np.uint64)
        while (open_ := a < b).any():
            i = np.flatnonzero(open_)
            mid = (a[i] + b[i]) // 2
            one = (self.words[mid, word[i]] >> place[i]) & np.uint64(1) == 1
            b[i[one]] = mid[one]
            a[i[~one]] = mid[~one] + 1
        return a


def _leaves(xlo: np.ndarray, xhi: np.ndarray, ylo: np.ndarray, yhi: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of pairs of leaves, about ROOM at a time: the rows of a leaf have equal sketches."""
    n = xhi - xlo
    of = np.repeat(np.arange(len(n)), n)
    row = xlo[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lo = np.where(same[of], row + 1, ylo[of])
    size = yhi[of] - lo
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ROOM, side="right")))
        m = size[at:end]
        k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(row[at:end], m), np.repeat(lo[at:end], m) + k
        at = end


def descended(bits: np.ndarray, roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of `bits` below the given pairs of nodes (xlo, xhi, ylo, yhi) whose differing bits stay within the budgets, piece by piece.

    A node paired with itself gives each pair of its rows once. Rows of a node are sorted by their bits. At most OPEN pairs of nodes are
    descended at once, the deepest first, so the open ones don't grow with the pairs of a bucket.
    """
    trie = Trie(bits)
    xlo, xhi, ylo, yhi = (np.concatenate(v).astype(np.int64) for v in zip(*roots, strict=True))
    waiting = [(xlo, xhi, ylo, yhi, np.zeros(len(xlo), dtype=np.int64), np.zeros(len(xlo), dtype=np.int64))]
    while waiting:
        piece = waiting.pop()
        if len(piece[0]) > OPEN:
            waiting.append(tuple(v[OPEN:] for v in piece))
            piece = tuple(v[:OPEN] for v in piece)
        xlo, xhi, ylo, yhi, done, spent = piece
        if not len(xlo):
            continue
        dx, dy = trie.shared(xlo, xhi - 1), trie.shared(ylo, yhi - 1)
        same = (xlo == ylo) & (xhi == yhi)
        upto = np.minimum(dx, dy)
        spent = spent + np.where(same, 0, trie.differ(xlo, ylo, done, upto))
        fits = spent <= most[upto]
        leaves = fits & (upto == trie.width)
        if leaves.any():
            yield from _leaves(xlo[leaves], xhi[leaves], ylo[leaves], yhi[leaves], same[leaves])
        go = np.flatnonzero(fits & ~leaves)
        xlo, xhi, ylo, yhi, dx, dy, same, upto, spent = (v[go] for v in (xlo, xhi, ylo, yhi, dx, dy, same, upto, spent))
        cut_x = dx <= dy  # the node that splits first is descended; a node paired with itself gives three pairs
        mid = trie.halves(np.where(cut_x, xlo, ylo), np.where(cut_x, xhi, yhi), upto)
        s, cx, cy = np.flatnonzero(same), np.flatnonzero(~same & cut_x), np.flatnonzero(~same & ~cut_x)
        nxt = [
            (xlo[s], mid[s], xlo[s], mid[s], s), (mid[s], xhi[s], mid[s], xhi[s], s), (xlo[s], mid[s], mid[s], xhi[s], s),
            (xlo[cx], mid[cx], ylo[cx], yhi[cx], cx), (mid[cx], xhi[cx], ylo[cx], yhi[cx], cx),
            (xlo[cy], xhi[cy], ylo[cy], mid[cy], cy), (xlo[cy], xhi[cy], mid[cy], yhi[cy], cy),
        ]
        xlo, xhi, ylo, yhi, of = (np.concatenate(v) for v in zip(*nxt, strict=True))
        pair = ~((xlo == ylo) & (xhi == yhi) & (xhi - xlo == 1))  # one row makes no pair
        waiting.append((xlo[pair], xhi[pair], ylo[pair], yhi[pair], upto[of][pair], spent[of][pair]))


def traverse(bits: np.ndarray, roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All that descended() gives, at once."""
    got = list(descended(bits, roots, most))
    return (np.concatenate([p for p, _ in got]), np.concatenate([q for _, q in got])) if got else (np.empty(0, np.int64), np.empty(0, np.int64))


def _sorted(bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order of the rows by `first`, then by their bits."""
    return np.lexsort((*(np.ascontiguousarray(bits[:, i : i + 8]).view(">u8").ravel() for i in range(bits.shape[1] - 8, -1, -8)), first))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, h, bits, side) of whole buckets of a batch; rows come sorted by key, the last bucket waits for the next batch."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        key, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        bits = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(len(h), -1)
        side = b.column(3).to_numpy(zero_copy_only=False) if b.num_columns > 3 else np.ones(len(h), dtype=np.int32)
        got = (key, h, bits, side)
        if rest is not None:
            got = tuple(np.concatenate(x) for x in zip(rest, got, strict=True))
        last = int(np.searchsorted(got[0], got[0][-1]))
        if last:
            yield tuple(x[:last] for x in got)
        rest = tuple(x[last:].copy() for x in got)
    if rest is not None:
        yield rest


def _join(most: np.ndarray):
    """Rows (key, h, bits) sorted by key: a bucket is one node; where `side` is given, sides 1 and 2 are joined with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h, bits, side in _buckets(batches):
            sizes = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
            node = 2 * np.repeat(np.arange(len(sizes)), sizes) + side - 1
            order = _sorted(bits, node)
            h, bits, node = h[order], bits[order], node[order]
            start = np.searchsorted(node, np.arange(2 * len(sizes) + 1))
            x, y = (start[0:-1:2], start[1::2]), (start[1::2], start[2::2])
            two = y[1] > y[0]
            lo, hi = np.where(two, y[0], x[0]), np.where(two, y[1], x[1])
            full = (x[1] > x[0]) & (hi > lo)
            for p, q in descended(bits, [(x[0][full], x[1][full], lo[full], hi[full])], most):
                out = pd.DataFrame({"a": np.minimum(h[p], h[q]), "b": np.maximum(h[p], h[q])})
                yield pa.RecordBatch.from_pandas(out[out["a"] != out["b"]].drop_duplicates(), preserve_index=False)

    return run


def _overlap(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        kept: dict[int, np.ndarray] = {}

        def own(i: int, t: str) -> np.ndarray:
            s = kept.get(i)
            if s is None:
                if len(kept) > 2_000:
                    kept.clear()
                s = kept[i] = shingles(words_py(t), known, k)
            return s

        for b in batches:
            out = []
            for i, j, x, y in zip(b["a"], b["b"], b["ta"], b["tb"], strict=True):
                p, q = own(i, x), own(j, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / max(1, len(p) + len(q) - both))
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "parecido": out})

    return run


def text_classes(texts: DataFrame, id_col: str = "fila", text_col: str = "texto") -> DataFrame:
    """(id, h): the class of equal texts of each row."""
    return texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))


def sketches(distinct: DataFrame, bands: int = BANDS, rows: int = ROWS, min_words: int = MIN_WORDS, k: int = SHINGLE) -> DataFrame:
    """(h, keys, bits) of the texts (h, texto) with enough words, one row for each class of equal texts."""
    return written(spread(distinct).mapInPandas(_sketches(bands, rows, min_words, k), "h bigint, keys array<bigint>, bits binary").dropDuplicates(["h"]), "bocetos")


def candidates(sk: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, group: int = GROUP) -> DataFrame:
    """(a, b) with a < b: text classes within the Hamming budgets below a common band. sk: what sketches() gives, one row for each class."""
    most = budgets(similarity, bands * rows)
    entries = sk.select(F.explode("keys").alias("key"), "h")
    hot = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group), "calientes")
    any_hot = not hot.isEmpty()
    few = F.broadcast(hot) if small(hot, ENDS) else hot
    bits = sk.select("h", "bits")
    cool = entries.join(few, "key", "left_anti") if any_hot else entries
    # buckets of one text need no node
    members = cool.repartition("key").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").select("key", "h")
    pairs = _bucketed(members.join(bits, "h").select("key", "h", "bits")).mapInArrow(_join(most), "a bigint, b bigint")
    if any_hot:
        tasks = hot_tasks(written(entries.join(few.select("key"), "key", "left_semi").join(bits, "h"), "nodos"), most, group)
        pairs = pairs.union(_bucketed(tasks).mapInArrow(_join(most), "a bigint, b bigint"))
    return pairs.distinct()


def _bucketed(rows: DataFrame) -> DataFrame:
    """Rows of a key one after the other in one partition. They stay rows: a list for each key would be held whole, thousands of them in one batch."""
    return rows.repartition("key").sortWithinPartitions("key")


def hot_tasks(members: DataFrame, most: np.ndarray, group: int) -> DataFrame:
    """(key, h, bits, side): for each pair of trie nodes of a hot bucket within the budget, a key of its own and its texts.

    Nodes are cut every four bits, as high as they hold at most `group` texts; below 64 bits by hash of the text.
    """
    prefix = F.conv(F.hex(F.substring("bits", 1, 8)), 16, -10).cast("bigint")
    members = members.withColumn("p", prefix)
    depths = range(0, 64, 4)
    cut = lambda d: F.struct(F.lit(d).alias("d"), (F.shiftrightunsigned("p", 64 - d) if d else F.lit(0).cast("bigint")).alias("v"))
    above = members.select("key", "h", F.explode(F.array(*[cut(d) for d in depths])).alias("x")).select("key", "h", "x.d", "x.v")
    inner = above.groupBy("key", "d", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
    inner = written(inner, "internos")
    deepest = above.join(F.broadcast(inner) if small(inner, ENDS) else inner, ["key", "d", "v"]).groupBy("key", "h").agg(F.max(F.struct("d", "n")).alias("x"))
    depth = F.col("x.d") + 4
    shares = F.when(depth == 64, F.ceil(2 * F.col("x.n") / group)).otherwise(1)
    # a node: its depth, its prefix filled up with zeros, its share
    placed = members.join(deepest, ["key", "h"]).select("key", "h", "bits", depth.alias("d"), F.when(depth == 64, F.col("p")).otherwise(F.expr("shiftleft(shiftrightunsigned(p, 64 - (x.d + 4)), 64 - (x.d + 4))")).alias("v"), F.pmod(F.xxhash64("h"), shares).cast("int").alias("s"))
    placed = written(placed, "calientes")
    nodes = placed.select("key", "d", "v", "s").distinct()
    x, y = (nodes.select("key", *[F.col(c).alias(c + i) for c in "dvs"]) for i in "12")
    both = x.join(y, "key").where("struct(d1, v1, s1) <= struct(d2, v2, s2)")
    common = F.least("d1", "d2")
    apart = F.bit_count(F.when(common == 64, F.col("v1").bitwiseXOR(F.col("v2"))).otherwise(F.expr("shiftrightunsigned(v1 ^ v2, 64 - least(d1, d2))")))
    allowed = F.element_at(F.array(*[F.lit(int(m)) for m in most[:65]]), common + 1)
    tasks = written(both.where(apart <= allowed).withColumn("t", F.xxhash64("key", "d1", "v1", "s1", "d2", "v2", "s2")), "tareas")
    sides = []
    for i in "12":
        own = tasks if i == "1" else tasks.where("struct(d1, v1, s1) < struct(d2, v2, s2)")
        own = own.select("key", "t", *[F.col(c + i).alias(c) for c in "dvs"])
        sides.append(placed.join(own, ["key", "d", "v", "s"]).select(F.col("t").alias("key"), "h", "bits", F.lit(int(i)).alias("side")))
    return sides[0].union(sides[1])


def similar_texts(texts: DataFrame, id_col: str = "fila", text_col: str = "texto", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, group: int = GROUP, min_words: int = MIN_WORDS, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(classes, links): (id, h) of each row that takes part, and (a, b, parecido) with a < b of classes of equal texts."""
    distinct = texts.where(F.length(text_col) >= 2 * min_words - 1).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("texto"))
    sk = sketches(distinct, bands, rows, min_words, k)
    near = written(candidates(sk, similarity, bands, rows, group), "pares")
    ends = near.select(F.col("a").alias("h")).union(near.select(F.col("b").alias("h"))).distinct()
    # Only texts of candidate pairs are moved; few enough ends are sent to the texts instead.
    bodies = distinct.join(F.broadcast(ends) if small(ends, ENDS) else ends, "h", "left_semi").dropDuplicates(["h"])
    both = near.join(bodies.select(F.col("h").alias("a"), F.col("texto").alias("ta")), "a").join(bodies.select(F.col("h").alias("b"), F.col("texto").alias("tb")), "b")
    links = both.mapInPandas(_overlap(k), "a bigint, b bigint, parecido double").where(F.col("parecido") >= similarity)
    return text_classes(texts, id_col, text_col).join(sk.select("h").distinct(), "h", "left_semi"), links


def near_pairs(texts: DataFrame, id_col: str = "fila", text_col: str = "texto", similarity: float = SIMILARITY, **how) -> DataFrame:
    """(fila_a, fila_b): every pair of rows, copies included."""
    classes, links = similar_texts(texts, id_col, text_col, similarity, **how)
    long, links = written(classes, "clases"), written(links.select("a", "b"), "enlaces")
    many = long.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("a"), F.col("h").alias("b"))
    x, y = long.select(F.col("id").alias("ia"), F.col("h").alias("a")), long.select(F.col("id").alias("ib"), F.col("h").alias("b"))
    pairs = links.union(many).join(x, "a").join(y, "b")
    copies = F.col("a") == F.col("b")
    return pairs.where(~copies | (F.col("ia") < F.col("ib"))).select(F.least("ia", "ib").alias("fila_a"), F.greatest("ia", "ib").alias("fila_b"))


def near_groups(texts: DataFrame, id_col: str = "fila", text_col: str = "texto", similarity: float = SIMILARITY, **how) -> DataFrame:
    """(id, clase, enlaces): each row that takes part, the smallest class hash it is linked to over any number of steps, and its links.

    Labels are spread by alternating minimum over neighbours and pointer jumping; every round is written to the shared folder, and
    rounds end when no label changes.
    """
    classes, links = similar_texts(texts, id_col, text_col, similarity, **how)
    classes, links = written(classes, "clases"), written(links.select("a", "b"), "enlaces")
    label, edges = linked_labels(links)
    degree = edges.groupBy(F.col("a").alias("h")).agg(F.count(F.lit(1)).alias("enlaces"))
    return classes.join(label.select("h", "c"), "h", "left").join(degree, "h", "left").select("id", F.coalesce("c", "h").alias("clase"), F.coalesce("enlaces", F.lit(0)).alias("enlaces"))


def linked_labels(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, edges): (h, c) with the smallest node that h is linked to over any number of links (a, b), and the links both ways."""
    edges = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "aristas")
    label = written(edges.select(F.col("a").alias("h")).distinct().withColumn("c", F.col("h")), "marcas")
    while True:
        around = edges.join(label.select(F.col("h").alias("b"), "c"), "b").groupBy(F.col("a").alias("h")).agg(F.min("c").alias("n"))
        step = label.join(around, "h", "left").select("h", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved"))
        step = written(step, "ronda")
        jump = step.join(step.select(F.col("h").alias("c"), F.col("c").alias("j")), "c", "left").select("h", F.least("c", "j").alias("c"), (F.col("moved") | (F.col("j") < F.col("c"))).alias("moved"))
        label = written(jump, "marcas")
        if label.where("moved").isEmpty():
            return label.select("h", "c"), edges
