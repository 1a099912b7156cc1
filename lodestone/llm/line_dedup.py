"""Line dedup (2): winnowing over line hashes, first occurrences of windows joined, later runs deleted.

A gram at line i is the shortest run of lines from i with at least `gram_words` words; a window at line i is the
shortest run with at least `min_words`. From every window the gram with the smallest hash is selected, so two
documents that share a run of lines of at least `min_words` words share a selected gram within it (the
guarantee of winnowing, with windows measured in words: one long line is a window by itself). Selected grams that
are in one place only are dropped. For the others every window that holds one is looked up by a 128-bit hash of its
lines, and each occurrence is joined to the first one of the same window in the order (doc_id, text hash, line),
never to all others. So a gram whose first holder has it in another context hides nothing: the lines of all
windows that have an earlier copy, wherever it is, are deleted, which are the lines of all repeated runs of at
least `min_words` words.

Defined cases: null and empty texts are returned as they are; documents with fewer than `min_words` words
hold no run; rows with equal doc_id and equal text are one document and get the same decision; with equal
doc_id but other texts they are ordered by the hash of the text; a null doc_id comes first; an empty table
gives no rows; the columns of docs stay (`lines_removed` is replaced if it is there already).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, scratch

MIN_WORDS, GRAM_WORDS = 50, 25
#: Windows to a batch handed back by Python, about.
WINDOW_ROWS = 50_000


def _runs(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the end (exclusive) of the shortest run from it with `least` words; 0 where there is none."""
    upto = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(upto, upto[:-1] + least, side="left")
    return np.where(end <= len(words), end, 0)


def select_grams(hashes: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> dict[int, int]:
    """Line -> hash of its gram, for the grams that some window selects."""
    gram_end, window_end = _runs(words, gram_words), _runs(words, min_words)
    grams, picked = {}, {}
    for i in np.flatnonzero(window_end):
        best, j, stop = None, i, window_end[i]
        while j < stop and gram_end[j] and gram_end[j] <= stop:
            g = grams.get(j)
            if g is None:
                g = grams[j] = xxhash.xxh3_64_intdigest(hashes[j : gram_end[j]].tobytes())
            if best is None or g <= best:
                best, at = g, j
            j += 1
        picked[int(at)] = best
    return picked


def windows(words: np.ndarray, seeds: np.ndarray, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the shortest runs of `min_words` words from each line and up to each line that hold a gram at one of `seeds`.

    A run of at least `min_words` words is the union of those within it: a line is in the one from the run's start, or,
    further on, in the one that ends with the line.
    """
    upto = np.concatenate(([0], np.cumsum(words)))
    from_line, back = _runs(words, min_words), np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    starts, ends = np.flatnonzero(from_line), np.flatnonzero(back >= 0)
    pairs = np.unique(np.concatenate((np.stack((starts, from_line[starts]), 1), np.stack((back[ends], ends + 1), 1))), axis=0)
    start, end = pairs[:, 0], pairs[:, 1]
    seeds = np.sort(seeds)
    gram_end = np.append(_runs(words, gram_words)[seeds], len(words) + 1)
    held = gram_end[np.searchsorted(seeds, start)] <= end
    return start[held], end[held]


def merged(runs: np.ndarray) -> np.ndarray:
    """(start, end) rows as disjoint ones in order."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.append(True, runs[1:, 0] > reach[:-1])
    return np.stack((runs[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(runs) - 1)]), 1)


def _repeated(places: DataFrame, by: list[str]) -> DataFrame:
    """`by` and first place of what is in more than one place; a repeated row is the same place."""
    place = F.struct("doc_id", "text_hash", "pos")
    return places.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """doc_id, text_hash and `cuts`, an array of (start, end) lines to delete."""
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    keyed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType([
        id_field, T.StructField("text_hash", T.LongType()), T.StructField("lines", T.ArrayType(T.LongType())),
        T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("at", T.ArrayType(T.IntegerType())),
        T.StructField("grams", T.ArrayType(T.LongType())),
    ])

    def fingerprint(batches):
        for batch in batches:
            cols = ([], [], [], [])
            keep = []
            for row, text in enumerate(batch.column("text")):
                lines = text.as_py().encode("utf-8", "surrogatepass").split(b"\n")
                words = np.array([len(x.split()) for x in lines], dtype=np.int32)
                if words.sum() < min_words:
                    continue
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], dtype=np.uint64)
                picked = select_grams(hashes, words, min_words, gram_words)
                keep.append(row)
                for col, x in zip(cols, (hashes.view(np.int64), words, np.array(list(picked), np.int32), np.array(list(picked.values()), np.uint64).view(np.int64))):
                    col.append(x)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(keep), batch.column("text_hash").take(keep),
                 pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.list_(pa.int32())),
                 pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int64()))],
                names=schema.names)

    prints = materialize(keyed.mapInArrow(fingerprint, schema), "line-prints")
    grams = prints.select("doc_id", "text_hash", F.explode(F.arrays_zip("at", "grams")).alias("g")).select(
        "doc_id", "text_hash", F.col("g.at").alias("pos"), F.col("g.grams").alias("gram"))
    shared = materialize(_repeated(grams, ["gram"]).select("gram"), "line-shared")
    seeds = materialize(
        grams.join(shared.hint("merge"), "gram").groupBy(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2")).agg(F.collect_set("pos").alias("seeds")),
        "line-seeds")
    seeded = prints.join(seeds.hint("merge"), prints["doc_id"].eqNullSafe(seeds["id2"]) & (prints["text_hash"] == seeds["hash2"])).select(
        "doc_id", "text_hash", "lines", "words", "seeds")
    window_schema = T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in ("text_hash", "high", "low")], *[T.StructField(c, T.IntegerType()) for c in ("pos", "end")]])

    def cover(batches):
        for batch in batches:
            cols, rows = ([], [], [], []), []

            def flush():
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), batch.column("text_hash").take(pa.array(rows, pa.int64())),
                     *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[:2]], *[pa.array(c, pa.int32()) for c in cols[2:]]],
                    names=window_schema.names)
                for c in (rows, *cols):
                    c.clear()
                return out

            lines, words, seeds = (batch.column(c) for c in ("lines", "words", "seeds"))
            for i in range(batch.num_rows):
                a = np.asarray(lines[i].values)
                for start, end in zip(*(x.tolist() for x in windows(np.asarray(words[i].values), np.asarray(seeds[i].values), min_words, gram_words))):
                    digest = xxhash.xxh3_128_intdigest(a[start:end].tobytes())
                    rows.append(i), cols[0].append(digest >> 64), cols[1].append(digest & (2**64 - 1)), cols[2].append(start), cols[3].append(end)
                if len(rows) >= WINDOW_ROWS:
                    yield flush()
            yield flush()

    # A repeated row has the same arrays; the join doubles its windows, which _repeated and collect_set undo below.
    places = materialize(seeded.mapInArrow(cover, window_schema), "line-windows")
    for old in (prints, shared, seeds):
        discard(old)
    first = materialize(_repeated(places, ["high", "low"]), "line-firsts")
    later = places.join(first.hint("merge"), ["high", "low"]).where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    cuts = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.col("pos").alias("start"), "end")).alias("cuts"))

    def join_runs(batches):
        for batch in batches:
            runs = []
            for x in batch.column("cuts"):
                flat = x.values
                runs.append([{"start": a, "end": b} for a, b in merged(np.stack((np.asarray(flat.field("start")), np.asarray(flat.field("end"))), 1)).tolist()])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(runs, kind)], names=["doc_id", "text_hash", "cuts"])

    return cuts.mapInArrow(join_runs, cuts.schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """docs with later repeated runs of lines deleted from text, and lines_removed (long)."""
    docs = docs.drop("lines_removed")
    with scratch() as kept:
        found = materialize(find_repeats(docs, min_words, gram_words), "line-cuts")
        kept.append(found)
    cuts = found.select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("cuts").alias("__cuts"))
    runs, lines = cuts["__cuts"], F.split(docs["text"], "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists(runs, lambda c: (i >= c["start"]) & (i < c["end"])))
    # Cuts grow with the documents: the join is the same at every size, by shuffle.
    joined = docs.join(cuts.hint("merge"), docs["doc_id"].eqNullSafe(cuts["__id"]) & (F.xxhash64(docs["text"]) == cuts["__hash"]), "left")
    text = F.when(runs.isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    removed = F.when(runs.isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long")
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], removed.alias("lines_removed"))
