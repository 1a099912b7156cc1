"""Quality classifier (1): nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a row of a term-document matrix with three blocks of terms: white-space words and byte pairs,
both hashed into bins, and the text's shape (shares of symbols, capitals, digits, repeated words and lines,
sizes) as one-hot terms. Counts are damped, weighted by inverse document frequency and scaled per block. The
labelled rows' matrix is decomposed by a truncated SVD; its right singular vectors are the latent axes. The
labelled rows' unit vectors on those axes are broadcast, every document is projected and multiplied with all of
them, block by block, and the `k` nearest vote for their label with their similarity as weight.

The classifier is fitted on at most MAX_LABELLED labelled rows, those with the smallest hashes of their ids:
that bounds the matrix on the driver and the broadcast (MAX_LABELLED * DIMS floats). Scoring covers every
document and every word.

Defined cases: null and empty texts are scored by their shape alone; a text without any known axis gets the
share of label 1 among the labelled rows, and 0.5 if there are none; repeated rows are scored alike; ties in
similarity go to the earlier labelled row; rows of `labels` with a null label are not used; if an id is
labelled twice, both rows vote; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Bound on the labelled rows that are fitted, the axes kept, the neighbours that vote.
MAX_LABELLED, DIMS, NEIGHBOURS = 6000, 64, 15
WORD_BINS, PAIR_BINS = 1024, 1024
#: The shape terms: bounds between the buckets of each measure.
SHAPE = {
    "words": [1, 10, 30, 50, 80, 150, 400, 1500, 6000],
    "word_len": [2, 3, 4, 5, 6, 7, 8, 10, 14],
    "symbols": [0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4],
    "capitals": [0.005, 0.02, 0.05, 0.1, 0.3, 0.6],
    "digits": [0.001, 0.01, 0.03, 0.1, 0.3],
    "distinct": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "dup_lines": [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8],
    "word_again": [0.01, 0.03, 0.1, 0.3, 0.6],
}
#: Share of each block in a row's squared length: words, byte pairs, shape.
BLOCKS = (0.2, 0.4, 0.4)
_SHAPE_AT = np.cumsum([0] + [len(b) + 1 for b in SHAPE.values()])
TERMS = WORD_BINS + PAIR_BINS + int(_SHAPE_AT[-1])


class Bins(dict):
    """Word -> bin; made anew in each task and emptied at its bound, which costs time, not results."""

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word) % WORD_BINS
        if len(word) <= 32:
            if len(self) >= 50_000:
                self.clear()
            self[word] = h
        return h


def features(text: str | None, bins_of: Bins) -> np.ndarray:
    """Damped counts of the terms of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, dtype=np.float32)
    words, again = raw.split(), 0
    b = np.frombuffer(raw, dtype=np.uint8)
    if words:
        bins = np.fromiter(map(bins_of.__getitem__, words), dtype=np.int64, count=len(words))
        out[:WORD_BINS] = np.bincount(bins, minlength=WORD_BINS)
        again = int(np.count_nonzero(bins[1:] == bins[:-1]))
    if len(b) > 1:
        pairs = (b[:-1] * np.uint16(40503) + b[1:] * np.uint16(30103)) >> np.uint16(6)
        out[WORD_BINS : WORD_BINS + PAIR_BINS] = np.bincount(pairs, minlength=PAIR_BINS)
    byte = np.bincount(b, minlength=256)
    n, kinds = max(len(raw), 1), byte[33:127]
    letters = int(byte[65:91].sum()), int(byte[97:123].sum()) + int(byte[128:].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    measures = (
        len(words), (len(raw) - int(byte[[9, 10, 11, 12, 13, 32]].sum())) / max(len(words), 1),
        (int(kinds.sum()) - letters[0] - int(byte[97:123].sum()) - int(byte[48:58].sum())) / n,
        letters[0] / max(sum(letters), 1), int(byte[48:58].sum()) / n,
        len(set(words)) / max(len(words), 1), (len(lines) - len(set(lines))) / max(len(lines), 1),
        again / max(len(words), 1),
    )
    for at, (bounds, m) in enumerate(zip(SHAPE.values(), measures)):
        out[WORD_BINS + PAIR_BINS + _SHAPE_AT[at] + np.searchsorted(bounds, m, side="right")] = 1
    return np.log1p(out, out=out)


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf rows, each block scaled to its share."""
    rows = rows * idf
    edges = (0, WORD_BINS, WORD_BINS + PAIR_BINS, TERMS)
    for share, lo, hi in zip(BLOCKS, edges, edges[1:]):
        size = np.linalg.norm(rows[:, lo:hi], axis=1, keepdims=True)
        rows[:, lo:hi] *= np.float32(np.sqrt(share)) / np.maximum(size, np.float32(1e-9))
    return rows


class Model:
    """Latent axes, the labelled rows' unit vectors on them, and their labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dims: int = DIMS):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = (rows > 0).sum(axis=0)
        self.idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
        a = weigh(rows, self.idf) if len(rows) else np.zeros((1, TERMS), np.float32)
        # Right singular vectors from the term-term matrix, whose size does not depend on the rows.
        _, vectors = np.linalg.eigh(a.T @ a)
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :dims], dtype=np.float32)
        self.unit = self.project(rows) if len(rows) else np.zeros((0, dims), np.float32)

    def project(self, rows: np.ndarray) -> np.ndarray:
        v = weigh(rows, self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.float32(1e-9))

    def score(self, rows: np.ndarray, k: int = NEIGHBOURS, block: int = 2048) -> np.ndarray:
        """Similarity-weighted mean label of the k nearest, by exact products over blocks of labelled rows."""
        v = self.project(rows)
        best, votes = np.zeros((len(v), 0), np.float32), np.zeros((len(v), 0), np.float32)
        for lo in range(0, len(self.unit), block):
            best = np.concatenate([best, v @ self.unit[lo : lo + block].T], axis=1)
            votes = np.concatenate([votes, np.broadcast_to(self.labels[lo : lo + block], (len(v), len(self.labels[lo : lo + block])))], axis=1)
            if best.shape[1] > k:
                last = -np.partition(-best, k - 1, axis=1)[:, k - 1 : k]
                above, equal = best > last, best == last  # of those equal to the last one, the earlier rows stay
                taken = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
                best, votes = best[taken].reshape(-1, k), votes[taken].reshape(-1, k)
        # Nearer neighbours count more: a vote weighs the eighth power of its similarity, and nothing below 0.
        weight = np.maximum(best, 0) ** 8
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight * votes).sum(axis=1) / np.maximum(total, 1e-9), self.prior)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, dims: int = DIMS) -> Model:
    """labels: doc_id, label (0 or 1). The rows with the smallest hashes are taken, at most max_labelled of them."""
    taken = labels.where("label is not null and doc_id is not null").select("doc_id", "label").orderBy(
        F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    pick = [(r["doc_id"], int(r["label"])) for r in taken.collect()]  # max_labelled rows at most
    small_batches(docs.sparkSession)
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    ids = spark.createDataFrame(pick, T.StructType([T.StructField("doc_id", id_type), T.StructField("label", T.IntegerType())]))
    # The ids are a bounded list, so the texts are found by a broadcast, without a shuffle of the documents.
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def run(batches):
        bins = Bins()
        for batch in batches:
            rows = [features(t.as_py(), bins) for t in batch.column("text")]
            packed = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([p.astype(np.int16) for p in packed], pa.list_(pa.int16())),
                 pa.array([r[p] for r, p in zip(rows, packed)], pa.list_(pa.float32()))], names=["doc_id", "label", "at", "value"])

    schema = T.StructType([ids.schema["doc_id"], ids.schema["label"], T.StructField("at", T.ArrayType(T.ShortType())), T.StructField("value", T.ArrayType(T.FloatType()))])
    got = texts.mapInArrow(run, schema).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    matrix = np.zeros((len(got), TERMS), dtype=np.float32)
    for i, (at, value) in enumerate(zip(got.column("at"), got.column("value"))):
        matrix[i, np.asarray(at.values)] = np.asarray(value.values)
    return Model(matrix, got.column("label").to_numpy(), dims)


def classify(docs: DataFrame, model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        bins = Bins()
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256)
                rows = np.stack([features(t.as_py(), bins) for t in part])
                score = np.clip(shared.value.score(rows, k), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 256), pa.array(score.astype(np.float64))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
