"""Substring dedup (13): a count-min sketch finds the windows that may repeat, exact grouping decides.

A window is `window` consecutive words. Hashes of 1, 2, 4 ... words are combined by doubling, so that all windows of a
text cost a few vector operations; from every window the gram (a power of two of words, about a third of the window)
with the smallest hash stands for it in the sketch, as documents that share a window share that gram, and a text has
many times fewer such grams than windows. So the count of the gram is never below that of its windows.

1. Every task counts the grams of its documents, a document counting once, and hands on the touched cells in blocks of
   BLOCK; blocks are added up over all tasks. What is broadcast is one bit a cell: two or more documents. The sketch
   follows the size of the texts up to MAX_CELLS. A sketch that would have to be larger stays on the cluster as rows of
   cells (2^WIDE of them): each document's touched cells are written, counted by one aggregate and joined back, and the
   cells that several documents share go to the texts that hold them.
2. Windows whose gram's cells are all set are emitted with a 128-bit hash of their words and grouped: the first
   document of each, in the order of doc_id. Windows that have an earlier document are joined back to their places.

A text that is equal to one of a smaller doc_id needs neither: all its windows start there. Such copies are left out of
the sketch and the grouping.

Defined cases: a window is judged by the ids of the documents it starts in; equal ids are not smaller than each other,
whatever their texts, and a null doc_id is smaller than all others. Null and empty texts have no words and stay as they
are, as do texts with fewer words than a window. Windows may overlap within one document, which changes nothing: only
documents with a smaller id count. Rows that repeat id and text get the same decision. White space before a removed word
goes with the words before it. An empty table gives no rows; the columns of docs stay (`n_words` and `words_removed`
are replaced if they are there already).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch, small_batches, unused, word_hashes
from .jaccard_join import mix

WINDOW = 50
#: Rows of the sketch; cells of a row at most; cells for each gram while that allows it; cells of a block.
DEPTH, MAX_CELLS, SPARE, BLOCK = 2, 1 << 28, 8, 1 << 16
#: Cells, as a power of two, of a sketch that is not broadcast.
WIDE = 44
#: Grams that a task gathers before it hands them on; windows to a batch handed back by Python, about.
GATHERED, WINDOW_ROWS = 1 << 20, 50_000
#: Copies of whole texts that may be broadcast to be left out; beyond, they are by shuffle.
BROADCAST_COPIES = 500_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def gram_words(window: int) -> int:
    return 1 << max(0, (window // 3).bit_length() - 1)


def _joined(a: np.ndarray, b: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = a * odd + b
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def ladder(hashes: np.ndarray, upto: int, odd: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4 ... words, as far as `upto`."""
    out, k, odd = {1: hashes}, 1, np.uint64(odd)
    while 2 * k <= min(upto, len(hashes)):
        out[2 * k] = _joined(out[k][:-k], out[k][k:], odd)
        k *= 2
    return out


def whole(steps: dict[int, np.ndarray], n: int, window: int, odd: int) -> np.ndarray:
    """Hashes of all windows, put together from the runs in `steps`."""
    count, at, out = n - window + 1, 0, None
    for k in sorted(steps, reverse=True):
        if at + k <= window:
            part = steps[k][at : at + count]
            out, at = part if out is None else _joined(out, part, np.uint64(odd)), at + k
    return out


def least(grams: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` neighbours."""
    k = 1
    while 2 * k <= span:
        grams = np.minimum(grams[:-k], grams[k:])
        k *= 2
    return np.minimum(grams[: len(grams) - (span - k)], grams[span - k :])


class Prints:
    """Of a text's words: for each window the gram that stands for it and, when asked for, its 128-bit hash."""

    ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, text: bytes, window: int):
        words = text.split()
        self.n, self.window = len(words), window
        if self.n >= window:
            self.words = word_hashes(words)
            self.steps, gram = ladder(self.words, window, self.ODD[0]), gram_words(window)
            self.grams = least(mix(self.steps[gram], 0), window - gram + 1)

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = whole(self.steps, self.n, self.window, self.ODD[0])[at]
        other = ladder(mix(self.words, 1), self.window, self.ODD[1])
        return high, whole(other, self.n, self.window, self.ODD[1])[at]


def _cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each gram in each row of the sketch."""
    return [(mix(grams, 2 + row) >> np.uint64(64 - bits)).astype(np.int64) for row in range(DEPTH)]


def sketch(texts: DataFrame, window: int, bits: int) -> list[np.ndarray]:
    """For each row the packed bits of the cells that two or more documents have touched. texts: one binary column, text."""
    schema = "row int, block int, cells binary"

    def count(batches):
        gathered, held = [], 0

        def flush():
            grams, times = np.unique(np.concatenate(gathered), return_counts=True)
            for row, cells in enumerate(_cells(np.repeat(grams, np.minimum(times, 2)), bits)):
                cells.sort()
                blocks = cells // BLOCK
                starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                parts = np.split((cells % BLOCK).astype(np.uint16), starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(parts), pa.int32()), pa.array(blocks[starts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["row", "block", "cells"])
            gathered.clear()

        for batch in batches:
            for text in batch.column("text"):
                p = Prints(text.as_py(), window)
                if p.n >= window:
                    gathered.append(np.unique(p.grams))
                    held += len(gathered[-1])
            if held >= GATHERED:
                yield from flush()
                held = 0
        if gathered:
            yield from flush()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.uint8)
        for batch in batches:
            for part in batch.column("cells"):
                seen = np.bincount(np.frombuffer(part.as_py(), np.uint16), minlength=BLOCK)
                total = np.minimum(total + np.minimum(seen, 2), 2).astype(np.uint8)
        packed = np.packbits(total > 1).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["row", "block", "cells"])

    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    size = BLOCK // 8
    for r in texts.mapInArrow(count, schema).groupBy("row", "block").applyInArrow(add, schema).collect():  # DEPTH * MAX_CELLS bits at most
        out[r["row"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["cells"], np.uint8)
    return out


def estimated_repeated(grams: np.ndarray, bits: int, packed: list[np.ndarray]) -> np.ndarray:
    """Positions of the windows whose grams have a count of two or more in every row of the sketch."""
    maybe = np.arange(len(grams))
    for row, cells in enumerate(_cells(grams, bits)):
        c = cells[maybe]
        maybe = maybe[(packed[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1]
    return maybe


def _bits(chars: int, window: int) -> int:
    """Cells of a row as a power of two: SPARE for each gram that so many characters may have."""
    grams = chars / 6 * 2 / (window - gram_words(window) + 2)
    return int(np.ceil(np.log2(max(SPARE * grams, BLOCK))))


def shared_cells(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, shared: the cells of a document's grams that other documents touch as well; the sketch as a table."""
    schema = T.StructType([texts.schema["doc_id"], T.StructField("tag", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))])

    def touched(batches):
        for batch in batches:
            prints = (Prints(t.as_py(), window) for t in batch.column("text"))
            cells = pa.array([np.unique(_cells(p.grams, WIDE)[0]) if p.n >= window else [] for p in prints], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), cells], names=schema.names)

    held = materialize(texts.mapInArrow(touched, schema), "cells").select("doc_id", "tag", F.explode("cells").alias("cell"))
    several = materialize(held.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "shared-cells")
    return materialize(held.join(several.hint("merge"), "cell").groupBy("doc_id", "tag").agg(F.collect_set("cell").alias("shared")), "shared")


def find_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tag (hash of the text), starts (array of the windows' first words) and whole (the text is a copy)."""
    spark = docs.sparkSession
    small_batches(spark)
    tag = F.xxhash64("text")
    keyed = docs.where("text is not null").select("doc_id", tag.alias("tag"), F.xxhash64(F.lit("second"), "text").alias("tag2"), "text")
    keys = materialize(keyed.select("doc_id", "tag", "tag2", F.length("text").alias("chars")), "copy-keys")
    firsts = keys.groupBy("tag", "tag2").agg(F.min(F.struct("doc_id")).alias("low"), F.max(F.struct("doc_id")).alias("high"))
    # Written, so that both sides of the join are dealt anew and a text with very many copies can be split.
    firsts = materialize(firsts.where(~F.col("low").eqNullSafe(F.col("high"))).select("tag", "tag2", F.col("low.doc_id").alias("first")), "copy-firsts")
    copies = materialize(
        keys.join(firsts.hint("merge"), ["tag", "tag2"]).where("doc_id is not null and (first is null or doc_id > first)").select("doc_id", "tag", "tag2"), "copies")
    left_out = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies.hint("merge")
    texts = keyed.join(left_out, ["doc_id", "tag", "tag2"], "left_anti").select("doc_id", "tag", F.col("text").cast("binary").alias("text"))

    bits, shared = _bits(keys.agg(F.sum("chars")).first()[0] or 0, window), None
    if 1 << bits <= MAX_CELLS:
        shared = spark.sparkContext.broadcast(sketch(texts.select("text"), window, bits))
    else:
        found = shared_cells(texts, window).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "shared")
        texts = texts.join(found.hint("merge"), texts["doc_id"].eqNullSafe(found["__id"]) & (texts["tag"] == found["__tag"])).select("doc_id", "tag", "text", "shared")
    kinds = {"tag": T.LongType(), "at": T.IntegerType(), "high": T.LongType(), "low": T.LongType()}
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, t) for c, t in kinds.items()]])

    def emit(batches):
        for batch in batches:
            rows, found, held = [], [], 0

            def flush():
                at = pa.array(np.repeat(rows, [len(f[0]) for f in found]), pa.int64())
                cols = [np.concatenate(c) for c in zip(*found)]
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("tag").take(at), pa.array(cols[0].astype(np.int32)), *[pa.array(c.view(np.int64)) for c in cols[1:]]], names=schema.names)

            for i, text in enumerate(batch.column("text")):
                p = Prints(text.as_py(), window)
                if p.n < window:
                    continue
                at = estimated_repeated(p.grams, bits, shared.value) if shared else np.flatnonzero(np.isin(_cells(p.grams, WIDE)[0], np.asarray(batch.column("shared")[i].values)))
                if len(at):
                    rows.append(i), found.append((at, *p.digests(at)))
                    held += len(at)
                if held >= WINDOW_ROWS:
                    yield flush()
                    rows, found, held = [], [], 0
            if found:
                yield flush()

    windows = materialize(texts.mapInArrow(emit, schema), "windows")
    if shared:
        shared.unpersist()
    doc = F.struct("doc_id")
    several = windows.groupBy("high", "low").agg(F.min(doc).alias("first"), F.max(doc).alias("last"))
    several = materialize(several.where(~F.col("first").eqNullSafe(F.col("last"))).select("high", "low", "first"), "window-firsts")
    later = windows.join(several.hint("merge"), ["high", "low"]).where("struct(doc_id) > first")
    starts = later.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("starts"), F.lit(False).alias("whole"))
    return starts.unionByName(copies.select("doc_id", "tag").distinct().select("doc_id", "tag", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole")))


def cut_windows(text: bytes, starts: np.ndarray | None, window: int) -> tuple[bytes, int, int]:
    """Text without the words of the windows at `starts` (None: of all windows), words before, words removed."""
    n = len(text.split())
    if n < window:
        return text, n, 0
    if starts is None:
        return b"", n, n
    if not len(starts):
        return text, n, 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    gone = np.append(np.cumsum(edge[:-1]) > 0, False)
    begins = np.append(np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64, n), len(text))
    turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))  # where words begin to be removed, and to stay again
    places = begins[turns].tolist()
    kept = [text[a:b] for a, b in zip([0, *places[1::2]], [*places[0::2], len(text)])]
    return b"".join(kept), n, int(gone.sum())


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every word removed from text that a window covers which starts in a document of a smaller id, too;
    n_words (before) and words_removed."""
    docs = docs.drop("n_words", "words_removed")
    with scratch() as kept:
        found = materialize(find_repeats(docs, window), "cuts")
        kept.append(found)
    id_, tag, starts, whole_, result = unused(docs, "__id", "__tag", "__starts", "__whole", "__result")
    cuts = found.select(F.col("doc_id").alias(id_), F.col("tag").alias(tag), F.col("starts").alias(starts), F.col("whole").alias(whole_))
    joined = docs.join(cuts.hint("merge"), docs["doc_id"].eqNullSafe(cuts[id_]) & (F.xxhash64(docs["text"]) == cuts[tag]), "left")

    @F.arrow_udf("text string, n_words long, words_removed long")
    def cut(text: pa.Array, starts: pa.Array, whole: pa.Array) -> pa.Array:
        none, out = np.zeros(0, np.int64), ([], [], [])
        for t, s, w in zip(text, starts, whole):
            at = None if w.as_py() else np.asarray(s.values, np.int64) if s.is_valid else none
            for col, x in zip(out, cut_windows(t.as_py(), at, window) if t.is_valid else (None, 0, 0)):
                col.append(x)
        return pa.StructArray.from_arrays([pa.array(out[0], pa.binary()).cast(pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["text", "n_words", "words_removed"])

    done = joined.withColumn(result, cut(docs["text"].cast("binary"), starts, whole_))
    return done.select(*[F.col(f"{result}.text").alias(c) if c == "text" else docs[c] for c in docs.columns], f"{result}.n_words", f"{result}.words_removed")


ORACLE = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) as h from words, unnest(range(1, len(w) - 48)) as t(pos)),
firsts as (select h, min(doc_id) as first from windows group by h),
gone as (select distinct doc_id, pos + k as pos from windows join firsts using (h), range(50) as r(k) where first < doc_id),
cuts as (select doc_id, count(*) as n, list(pos) as gone_at from gone group by doc_id)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: n is null or not list_contains(gone_at, i)), ' ')) as kept_sha256
from words left join cuts using (doc_id)
"""


def digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what dedup_substrings has returned."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", F.col("words_removed").alias("n_removed"), F.sha2(words, 256).alias("kept_sha256"))
