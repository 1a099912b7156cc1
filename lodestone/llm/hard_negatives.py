"""Hard-negative mining (11): blocked dense products of anchors with all rows, in two passes.

A block of anchors (BLOCK_FLOATS numbers at most) is broadcast. Each task multiplies its rows with it in float64, which
is exact as all components are whole and products stay below 2^53, and keeps the best rows of every anchor; what tasks
have kept is merged by one more ranking, so nothing is gathered per anchor but a few rows a task.

1. The first `positives` rows of the anchor's label, by (score descending, vec_id).
2. Their scores P, a few for each anchor, are broadcast with the block. Of the rows with other labels the first
   `negatives` with low * P <= 100 * score <= high * P are kept for every positive.

Blocks of anchors follow one another; each one's negatives are written before the next.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component take no part, nor do
those whose squared length passes 2^63 (a score might not fit a long); where squared lengths pass 2^53, products are
made in 64-bit integers instead. Vectors are compared with those of their own length only; empty ones have the score 0.
Rows with the anchor's own vec_id are neither its positives nor its negatives. Rows that repeat a vec_id count one by
one; an anchor that is repeated has its rows repeated. No positive or no negative: no row. An empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Numbers of an anchor block that is broadcast; anchors that one product is made with.
BLOCK_FLOATS, COLUMNS = 2_000_000, 1024
EXACT, LONG = 2.0**53, 2.0**63
NONE = np.iinfo(np.int64).min


class Best:
    """The first k (score, id) by score descending, then id, of each of n columns; mergeable, as it is a maximum of sets."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray, at: slice) -> None:
        """scores: rows x the columns `at`, NONE where a row takes no part."""
        last, last_id = self.scores[at, -1], self.ids[at, -1]
        hit = (scores > last) | ((scores == last) & (ids[:, None] < last_id) & (scores != NONE))
        if len(ids) > self.k and np.count_nonzero(hit) > 8 * self.k * len(last):  # the rows' own k-th best is a bound as well
            hit &= scores >= np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
        row, col = np.nonzero(hit)
        if not len(row):
            return
        touched, col = np.unique(col, return_inverse=True)
        s = np.concatenate((self.scores[at][touched].ravel(), scores[row, touched[col]]))
        i = np.concatenate((self.ids[at][touched].ravel(), ids[row]))
        c = np.concatenate((np.repeat(np.arange(len(touched)), self.k), col))
        order = np.lexsort((i, ~s, c))
        c = c[order]
        place = np.arange(len(c)) - np.searchsorted(c, c)
        keep = place < self.k
        order, c, place = order[keep], c[keep], place[keep]
        self.scores[at.start + touched[c], place], self.ids[at.start + touched[c], place] = s[order], i[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column, id and score of all that is held."""
        col, place = np.nonzero(self.scores != NONE)
        return col, self.ids[col, place], self.scores[col, place]


class Anchors:
    """A block of anchors of one length: ids, labels and whole components."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest = float((vectors**2).sum(axis=1).max(initial=0))

    def products(self, batch: pa.RecordBatch, scale: int):
        """(scores, ids, labels, columns) of a batch's rows with COLUMNS anchors at a time; NONE for the anchor itself."""
        ids, labels, x = whole_rows(batch, self.vectors.shape[1], scale)
        exact = self.longest < EXACT and float((x**2).sum(axis=1).max(initial=0)) < EXACT
        for lo in range(0, len(self.ids) if len(ids) else 0, COLUMNS):
            at = slice(lo, min(lo + COLUMNS, len(self.ids)))
            y = self.vectors[at].T
            scores = (x @ y).astype(np.int64) if exact else x.astype(np.int64) @ y.astype(np.int64)
            scores[ids[:, None] == self.ids[at]] = NONE
            yield scores, ids, labels, at


def whole_rows(batch: pa.RecordBatch, width: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and floor(scale * component) of the rows that take part and have `width` components."""
    values = batch.column("embedding")
    fits = pa.array(np.asarray(values.value_lengths().fill_null(-1)) == width)
    batch = batch.filter(fits)
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)  # nulls become nan
    with np.errstate(all="ignore"):
        x = np.floor(scale * x)
        good = np.isfinite(x).all(axis=1) & ((x**2).sum(axis=1) < LONG)
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
    return ids[good], labels[good], x[good]


def _blocks(rows: DataFrame, anchor: Column, scale: int):
    """Anchors by length of their vectors, in blocks; gathered when they are asked for."""
    anchors = rows.where(anchor)
    for width, n in anchors.groupBy(F.size("embedding")).count().orderBy("size(embedding)").collect():  # one row for each length
        blocks = max(1, -(-n * max(width, 1) // BLOCK_FLOATS))
        for b in range(blocks):
            found = anchors.where((F.size("embedding") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).toArrow()  # about BLOCK_FLOATS numbers
            parts = [whole_rows(batch, width, scale) for batch in found.to_batches()]
            if parts and sum(len(p[0]) for p in parts):
                yield Anchors(*(np.concatenate(c) for c in zip(*parts)))


def _merged(found: DataFrame, k: int, *group: str) -> DataFrame:
    best = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _mined(rows: DataFrame, block: Anchors, scale: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark, n = rows.sparkSession, len(block.ids)
    shared = spark.sparkContext.broadcast(block)

    def near(batches):
        own = shared.value
        best = Best(n, positives)
        for batch in batches:
            for scores, ids, labels, at in own.products(batch, scale):
                scores[labels[:, None] != own.labels[at]] = NONE
                best.add(scores, ids, at)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], names=["anchor", "id", "score"])

    kept = Best(n, positives)
    for anchor, id_, score, rank in _merged(rows.mapInArrow(near, "anchor long, id long, score long"), positives, "anchor").collect():  # a few for each anchor of the block
        kept.scores[anchor, rank - 1], kept.ids[anchor, rank - 1] = score, id_
    limits = spark.sparkContext.broadcast(kept)

    def windowed(batches):
        own, top = shared.value, limits.value
        best = [Best(n, negatives) for _ in range(positives)]
        least = np.where(top.scores == NONE, 0, [[-(-low * int(p) // 100) if p != NONE else 0 for p in row] for row in top.scores])
        most = np.where(top.scores == NONE, -1, [[high * int(p) // 100 if p != NONE else -1 for p in row] for row in top.scores])
        for batch in batches:
            for scores, ids, labels, at in own.products(batch, scale):
                scores[labels[:, None] == own.labels[at]] = NONE
                for j, slot in enumerate(best):
                    inside = (scores >= least[at, j]) & (scores <= most[at, j]) & (scores != NONE)
                    slot.add(np.where(inside, scores, NONE), ids, at)
        for j, slot in enumerate(best):
            col, id_, score = slot.rows()
            cols = [col, np.full(len(col), j), own.ids[col], top.ids[col, j], top.scores[col, j], id_, score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "slot", "anchor_id", "positive_id", "positive_score", "id", "score"])

    found = rows.mapInArrow(windowed, "anchor long, slot long, anchor_id long, positive_id long, positive_score long, id long, score long")
    return _merged(found, negatives, "anchor", "slot").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; components are taken as floor(scale * x). anchor: the condition on vec_id and
    label that makes a row an anchor.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where("vec_id is not null and label is not null and embedding is not null")
    out, waiting = [], None
    for block in _blocks(rows, anchor, scale):
        if waiting is not None:
            out.append(materialize(waiting, "negatives"))
        waiting = _mined(rows, block, scale, positives, negatives, low, high)
    if waiting is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, [*out, waiting])


ORACLE = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
    from v a join v b on a.vec_id % 100 = 0 and a.vec_id != b.vec_id),
positives as (
    select anchor_id, other_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank,
    other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""
