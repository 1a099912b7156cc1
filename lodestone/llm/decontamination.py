"""Benchmark decontamination (7): q-gram lemma filtering in diagonal bands, verified by banded alignment.

An item of m characters that occurs in a document with at most e edits shares at least (m - q + 1) - q * e of
its q-grams with it, on diagonals (document position less item position) that differ by at most e. Diagonals
are counted in overlapping bands, each 2 * (e + 1) wide and e + 1 after the last, so that every such match lies
in one band. Bands that reach the bound are aligned exactly, within the band.

The benchmark's q-gram index goes to every task. It is sent in blocks of items of about BLOCK_CHARS characters.
While they are more than one, blocks are gathered, sent, searched and written one after another, so the driver and
the tasks hold one at a time whatever the benchmark's size, at the price of a pass over the documents for each.

An item is looked for as a whole: a document that holds a part of one, short of the item's edit budget, is clean.

Defined cases: letters are compared in lower case where that keeps a letter's length, and white space as blanks;
null or empty items match nothing; items shorter than q characters are searched as they are; null and empty
documents match nothing; rows that repeat are judged and reported each by its own text, whatever their ids, null
ones included; very long and repetitive texts take memory in proportion to their length; an empty table on either
side gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, small_batches, unused

Q, EDIT_RATE = 12, 0.07
BLOCK_CHARS = 2_000_000
#: Places at which an item's grams meet a text's that are laid out at once.
HITS = 1_000_000
_BASE = 0x9E3779B97F4A7C15


def normal(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for blank in "\n\t\r\x0b\x0c":
        low = low.replace(blank, " ")
    return low


def gram_hashes(text: str, q: int = Q) -> np.ndarray:
    """64-bit hashes of all q-grams, by doubling: a 2k-gram is a k-gram and the one k further on."""
    out, size = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), 1
    if len(out) < q:
        return np.zeros(0, dtype=np.uint64)
    base = np.uint64(_BASE)
    with np.errstate(over="ignore"):
        while size < q:
            step = min(size, q - size)
            power = np.uint64(pow(_BASE, 2 * size + 1, 1 << 64))
            out = out[:-step] * power + out[step:]
            out ^= out >> np.uint64(29)
            size += step
        return out * base


class Index:
    """Items with their edit budgets, and their q-grams sorted by hash."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, edit_rate: float = EDIT_RATE):
        items = [(i, normal(t)) for i, t in items if t]
        self.q, self.items = q, [t for t in items if len(t[1]) >= q]
        self.short = [t for t in items if len(t[1]) < q]
        size = np.array([len(t) for _, t in self.items], dtype=np.int64)
        #: the budget never exceeds what leaves a positive bound
        self.edits = np.minimum((size * edit_rate).astype(np.int64), (size - q) // q)
        self.bound = (size - q + 1) - q * self.edits
        grams = [gram_hashes(t, q) for _, t in self.items]
        n = np.array([len(g) for g in grams], dtype=np.int64)
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item, at = np.repeat(np.arange(len(grams), dtype=np.int32), n), np.concatenate([np.arange(k, dtype=np.int32) for k in n]) if len(n) else np.zeros(0, np.int32)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]
        self.shift = np.uint64(64 - max(16, min(24, int(np.ceil(np.log2(max(len(hashes), 1)))) + 5)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.seen[(self.hashes >> self.shift).astype(np.int64)] = True
        self.least = int(self.bound.min()) if len(self.bound) else 1 << 60

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, start, end, edits) of the best region of each item that the text holds."""
        text, found = normal(text), []
        for i, t in self.short:
            if (p := text.find(t)) >= 0:
                found.append((i, p, p + len(t), 0))
        grams = gram_hashes(text, self.q)
        p = np.flatnonzero(self.seen[(grams >> self.shift).astype(np.int64)])
        if len(p) < self.least:
            return found
        # Places of each gram that both sides have: rows first[g] to first[g] + times[g] of p.
        p = p[np.argsort(grams[p], kind="stable")]
        kinds, first, times = np.unique(grams[p], return_index=True, return_counts=True)
        lo, hi = np.searchsorted(self.hashes, kinds, "left"), np.searchsorted(self.hashes, kinds, "right")
        n = hi - lo
        gram = np.repeat(np.arange(len(kinds)), n)
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item = self.item[entry]
        common = np.bincount(item, minlength=len(self.items))
        for k in np.flatnonzero(common >= self.bound):
            rows = item == k
            g = gram[rows]
            best = self._bands(text, int(k), p, first[g], times[g], self.at[entry[rows]].astype(np.int64))
            if best:
                found.append((self.items[k][0], *best))
        return found

    def _bands(self, text: str, k: int, p: np.ndarray, first: np.ndarray, times: np.ndarray, j: np.ndarray):
        width, pattern, edits = int(self.edits[k]) + 1, self.items[k][1], int(self.edits[k])
        m, keys = len(pattern), np.zeros(0, dtype=np.int64)
        for places, at in _meetings(p, first, times, j, width):
            band = (places - at) // width  # a hit lies in the bands that start at this step and at the one before
            keys = np.unique(np.concatenate((keys, band * m + at, (band - 1) * m + at)))  # an item's gram counts once a band
        bands, counts = np.unique(np.floor_divide(keys, m), return_counts=True)
        best = None
        for b in bands[counts >= self.bound[k]]:
            start = max(0, int(b) * width)
            region = text[start : max(0, (int(b) + 2) * width) + m + edits]
            hit = region.find(pattern)
            got = (0, start + hit, start + hit + m) if hit >= 0 else align(pattern, region, edits, start)
            if got and (best is None or got < best):
                best = got
            if hit >= 0:  # later bands begin later
                break
        return best and (best[1], best[2], best[0])


def _meetings(p: np.ndarray, first: np.ndarray, times: np.ndarray, j: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in the text, place in the item) of equal grams, some HITS at a time.

    A gram that repeats is met at the first and the last of its places in each stretch of `width`: whatever is
    subtracted from them, all places between fall into the same bands.
    """
    if times.sum() > HITS:
        shown = {}
        for f, t in set(zip(first.tolist(), times.tolist())):
            x = p[f : f + t]
            new = np.append(True, x[1:] // width != x[:-1] // width)
            shown[f] = x[new | np.append(new[1:], True)]
        p = np.concatenate(list(shown.values()))
        starts = dict(zip(shown, np.concatenate(([0], np.cumsum([len(x) for x in shown.values()])[:-1])).tolist()))
        times = np.array([len(shown[f]) for f in first.tolist()])
        first = np.array([starts[f] for f in first.tolist()])
    upto = np.cumsum(times)
    for lo in range(0, len(j), step := max(1, HITS * len(j) // max(int(upto[-1]), 1))):
        t, f = times[lo : lo + step], first[lo : lo + step]
        which = np.repeat(f - np.concatenate(([0], np.cumsum(t)[:-1])), t) + np.arange(t.sum())
        yield p[which], np.repeat(j[lo : lo + step], t)


def align(pattern: str, region: str, budget: int, offset: int = 0) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the whole pattern inside region, if it needs at most `budget` edits.

    Row i holds the cells on the diagonals from -budget to slack + budget, for slack the spare length of the region.
    """
    a = np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    b = np.frombuffer(region.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    far = 1 << 20
    width = max(0, len(b) - len(a)) + 2 * budget + 1
    steps = np.arange(width)
    cols = steps - budget  # column of each diagonal in row 0
    cost, begin = np.where((cols >= 0) & (cols <= len(b)), 0, far), cols.copy()
    for i in range(1, len(a) + 1):
        at = i + steps - budget  # columns of row i
        inside = (at >= 1) & (at <= len(b))
        same = np.zeros(width, dtype=bool)
        same[inside] = b[at[inside] - 1] == a[i - 1]
        diagonal = np.where(inside, cost + ~same, far)
        above, above_begin = np.append(cost[1:], far) + 1, np.append(begin[1:], 0)
        above = np.where((at >= 0) & (at <= len(b)), above, far)
        take = above < diagonal
        low, origin = np.where(take, above, diagonal), np.where(take, above_begin, begin)
        # gaps to the left: running minimum of cost less position, carrying where it began
        reach = low - steps
        from_left = np.minimum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == from_left, steps, 0))
        cost, begin = np.minimum(low, from_left + steps), origin[source]
        cost = np.where(at <= len(b), cost, far)
    end = len(a) + steps - budget
    i = int(np.argmin(cost))
    if cost[i] > budget:
        return None
    return int(cost[i]), offset + int(begin[i]), offset + int(end[i])


def _blocks(benchmark: DataFrame, q: int, edit_rate: float) -> Iterator[tuple[Index, bool]]:
    """The index of each block of items, and whether it is the last one; made when it is asked for."""
    items = benchmark.where("length(text) > 0").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about BLOCK_CHARS
        yield Index([(r[0], r[1]) for r in rows], q, edit_rate), block == blocks - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits: the best region of each benchmark item in each document that holds it."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType()),
    ])
    item_type = _arrow(schema["item_id"].dataType)
    texts = docs.where("length(text) > 0").select("doc_id", "text")

    def searched(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def search(batches):
            for batch in batches:
                row, out = [], []
                for i, text in enumerate(batch.column("text")):
                    for hit in shared.value.search(text.as_py()):
                        row.append(i), out.append(hit)
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64()))] + [pa.array(list(c), t) for c, t in zip(cols, (item_type, *[pa.int64()] * 3))], names=schema.names)

        return texts.mapInArrow(search, schema)

    found = []
    for index, last in _blocks(benchmark, q, edit_rate):
        found.append(searched(index) if last else materialize(searched(index), "leaks"))
    return reduce(DataFrame.unionByName, found)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The documents that hold no benchmark item, with the columns of docs. The test runs beside each row; nothing is shuffled."""
    spark, names = docs.sparkSession, docs.columns
    small_batches(spark)
    clean, = unused(docs, "clean")

    def tested(rows: DataFrame, index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        @F.arrow_udf("boolean")
        def is_clean(texts: pa.Array) -> pa.Array:
            return pa.array([not (t.is_valid and shared.value.search(t.as_py())) for t in texts], pa.bool_())

        return rows.withColumn(clean, is_clean("text")).where(clean).select(*names)

    left = docs
    for index, last in _blocks(benchmark, q, edit_rate):
        before, left = left, tested(left, index)
        if not last:
            left = materialize(left, "clean")
            if before is not docs:
                discard(before)
    return left
