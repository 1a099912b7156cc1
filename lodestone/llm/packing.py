"""Packing (5): cutting-stock column generation over the histogram of piece lengths.

Every document is encoded once and cut into full pieces of `capacity` tokens and one remainder. The
remainders' lengths are counted in classes of `unit` tokens; a linear program over patterns (multisets of
classes that fit one sequence) is solved by column generation on that histogram, which has at most
capacity / unit rows however large the corpus is. Rounded patterns then deal sequence slots to the ranked
pieces of each class. Only the histogram (bounded) reaches the driver.

Defined cases: null text is empty and yields the end token alone; repeated rows are packed once each; an
empty table gives no pieces; a null doc_id is kept. Only doc_id and text of the input are read, so further
columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

CAPACITY, UNIT, END_ID = 2048, 8, 1
#: Pieces that one (class, part) group holds on average, at most, when ranks are dealt out.
PART_ROWS = 1000
#: Words, and the characters of one, that a worker keeps the ids of (some 60 MB); at the bound they are forgotten, which costs time only.
KEPT_WORDS, KEPT_CHARS = 400_000, 32


# --- encoding ---------------------------------------------------------------------------------------------

#: Pre-token pattern of the vocabulary file for texts below U+0180, whose letters and digits are written out.
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\t-\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-ſ]+"
)
#: Texts that are encoded whole: other scripts, control characters (the vocabulary has other signs for them, and Python
#: takes some as white space that the tokenizer does not), special tokens.
_WHOLE = re.compile("[^\t-\r\x20-\x7e\x80-ſ]|<\\|(?:startoftext|endoftext)\\|>")


class _Words(dict):
    """White-space word -> its ids as little-endian 32-bit bytes; words of one pre-token are kept, others are put together."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        pieces = _PIECE.findall(word)
        if len(pieces) != 1:
            return b"".join(map(self.__getitem__, pieces))
        if word.isascii():
            out = array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
        else:
            out = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=1)
def encoder(path: str):
    """text -> ids as little-endian 32-bit bytes. A worker keeps one, with KEPT_WORDS words of KEPT_CHARS characters at most."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    words = _Words(tokenizer)

    def encode(text: str) -> bytes:
        """Ids of a whole text. White space never lies inside a pre-token, so words encode on their own."""
        if _WHOLE.search(text):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(words.__getitem__, text.lower().split()))

    return encode


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: full pieces and one remainder per document."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    ])

    def run(batches):
        encode = encoder(tokenizer_path)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = memoryview(encode(text.as_py() or "") + tail)
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    b = min(n, a + capacity)
                    rows.append(i), start.append(a), length.append(b - a), total.append(n)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
                + [pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- the linear program -----------------------------------------------------------------------------------


def _best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: classes 1..n of sizes 1..n and the given values, into `capacity` units."""
    n = len(value)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for room in range(1, capacity + 1):
        top = min(n, room)
        gains = value[:top] + best[room - 1 :: -1][:top]
        k = int(np.argmax(gains))
        best[room], pick[room] = (gains[k], k + 1) if gains[k] > best[room - 1] else (best[room - 1], 0)
    counts, room = np.zeros(n, dtype=int), capacity
    while room > 0:
        if pick[room]:
            counts[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def cutting_stock(demand: dict[int, int], capacity: int, max_rounds: int = 2000) -> list[tuple[dict[int, int], int]]:
    """Patterns with multiplicities that cover `demand` (size in units -> count) with few bins of `capacity` units.

    Column generation: the restricted master is a simplex basis of patterns, the duals price new columns by
    knapsack dynamic programming, the ratio test swaps them in. Rounding is down; what is left is patterned
    first-fit decreasing.
    """
    sizes = sorted(s for s, n in demand.items() if n > 0)
    if not sizes:
        return []
    need = np.array([demand[s] for s in sizes], dtype=float)
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])  # a column per pattern
    inverse = np.diag(1 / np.diag(basis))
    at = np.array(sizes) - 1
    aim = need + np.linspace(1e-4, 1e-3, m)  # a slight perturbation keeps the simplex steps from stalling
    for _ in range(max_rounds):
        duals, x = inverse.sum(axis=0), inverse @ aim
        value = np.zeros(capacity)
        value[at] = np.maximum(duals, 0)
        worth, counts = _best_pattern(value, capacity)
        if x.sum() * (1 - 1 / max(worth, 1)) < 0.5:  # no plan saves half a sequence over this one
            break
        column = counts[at].astype(float)
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
    x = np.floor(inverse @ need + 1e-6)  # rounding errors cost padding at most: the counts below stay exact
    patterns, left = [], need.copy()
    for j in range(m):
        column = basis[:, j]
        used = int(max(0, min(x[j], min((left[i] // column[i] for i in range(m) if column[i]), default=0))))
        if used:
            left -= used * column
            patterns.append(({sizes[i]: int(column[i]) for i in range(m) if column[i]}, used))
    while left.sum() > 0:  # each pass makes as many copies of one greedy pattern as the leftovers allow
        room, pattern = capacity, {}
        for i in range(m - 1, -1, -1):
            k = int(min(left[i], room // sizes[i]))
            if k:
                pattern[sizes[i]] = k
                room -= k * sizes[i]
        copies = int(min(left[sizes.index(s)] // k for s, k in pattern.items()))
        for s, k in pattern.items():
            left[sizes.index(s)] -= copies * k
        patterns.append((pattern, copies))
    return patterns


def _slot_table(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per class: the first rank of each pattern that uses it, and what turns a rank into sequence and slot."""
    first_sequence, reached, rows = 0, {}, {}
    for pattern, copies in patterns:
        slot = 0
        for size, k in sorted(pattern.items(), reverse=True):
            at = reached.get(size, 0)
            rows.setdefault(size, []).append((at, k, first_sequence, slot))
            reached[size] = at + k * copies
            slot += k
        first_sequence += copies
    return {size: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for size, r in rows.items()}


# --- the operator -----------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence_id and gapless offset there."""
    small_batches(docs.sparkSession)
    pieces = materialize(
        encode_pieces(docs, tokenizer_path, capacity, end_id)
        .withColumn("size_class", F.ceil(F.col("length") / unit).cast("int")),
        "pieces",
    )
    demand = {r["size_class"]: r["n"] for r in pieces.groupBy("size_class").agg(F.count("*").alias("n")).collect()}
    slots = _slot_table(cutting_stock(demand, capacity // unit))
    parts = F.create_map(*[F.lit(x) for size, n in sorted(demand.items()) for x in (size, -(-n // PART_ROWS))]) if demand else None

    # Ranks without a window over a whole class: a class is split by hash, parts are counted, then offset.
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(parts, F.col("size_class"))) if demand else F.lit(0)
    dealt = pieces.withColumn("part", part.cast("int"))
    before = Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        dealt.groupBy("size_class", "part").agg(F.count("*").alias("n"))
        .select("size_class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0")),
        "ranks",
    )
    within = Window.partitionBy("size_class", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("rn", F.row_number().over(within)).join(offsets, ["size_class", "part"])
        .withColumn("rank", F.col("rank0") + F.col("rn") - 1)
    )

    @F.arrow_udf("sequence_id long, slot long")
    def place(size_class: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, slot = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        sizes, ranks = size_class.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            at, k, first, slot0 = slots[int(size)]
            rows = sizes == size
            i = np.searchsorted(at, ranks[rows], side="right") - 1
            inside = ranks[rows] - at[i]
            sequence[rows], slot[rows] = first[i] + inside // k[i], slot0[i] + inside % k[i]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(slot)], names=["sequence_id", "slot"])

    placed = ranked.withColumn("p", place("size_class", "rank")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "p.sequence_id", "p.slot")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
