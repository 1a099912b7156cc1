"""Ranked lexical search (12): a bit-sliced index of impacts.

A term is a run of ASCII letters and digits and of characters beyond ASCII; A-Z count as lower case. What a term adds to a
document's score, its impact, is a whole number that is known once the corpus is counted:
w * ((1000000000 * tf) div (1000 * tf + 8 * m)), m = 25 + ((75 * n * N) div L), w = floor(1000 * ln((2 N + 2) / (2 df + 1))).

1. Texts are split once: length and occurrences of the terms asked for are written for each document; N, L and df are
   aggregates of that table.
2. Documents are laid in blocks of `size`, in the order of doc_id, as they lie in their partitions. Of each term a block
   holds the places of its documents and, slice by slice, one bit of the impacts of each. Nothing is shuffled.
3. A query adds up its terms' slices as binary numbers, all documents of a block at once: sum and carry of two slices
   are a few bitwise operations. The best k are found from the most significant slice downwards: the documents
   that have the bit stay, unless there are fewer than k of them, which are then chosen, and the search goes on among
   the others. Each block hands on its best k of every item.

Every document is indexed and every score is exact. Items come in blocks of BLOCK_CHARS characters, one after another.

Defined cases: null and empty texts have no terms: such documents are found by nothing and count in neither N nor L,
such items find nothing. Repeated terms of an item count as often as they stand. Rows that repeat a doc_id are
documents of their own; a null doc_id comes first among equal scores. Items that repeat id and text are one; of one id
with several texts each is ranked by itself. A term that every document has may weigh 0. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, scratch, small_batches

#: Documents of a block, a multiple of 64 and at most 2^16; characters of items that are searched for at a time.
BLOCK, BLOCK_CHARS = 16_384, 2_000_000
#: Bytes of spread-out slices that a task keeps; beyond, they are made anew, which costs time, not results.
SPREAD_BYTES = 128 << 20
#: Every byte that is no part of a term becomes a blank; bytes of characters beyond ASCII stay.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def count_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document, repeats included), terms and times (of those that have a number)."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        of = shared.value.get
        for batch in batches:
            n, terms, times = [], [], []
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                known = np.array([t for t in map(of, found) if t is not None], np.int32)
                a, b = np.unique(known, return_counts=True)
                n.append(len(found)), terms.append(a), times.append(b.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, kind), pa.array(times, kind)], names=schema.names)

    return docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema).where("n > 0")


def weight(df: int, total: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def slices(impacts: np.ndarray) -> np.ndarray:
    """One row for each bit of the largest impact, lowest first, packed."""
    bits = int(impacts.max(initial=0)).bit_length()
    return np.packbits((impacts >> np.arange(bits)[:, None] & 1).astype(np.uint8), axis=1, bitorder="little")


def build(counted: DataFrame, df: np.ndarray, total: int, length: int, size: int = BLOCK) -> DataFrame:
    """The index: one row for each block of at most `size` documents. counted: as count_terms gives it; df by a term's number."""
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(counted.schema["doc_id"].dataType)), T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("bits", T.ArrayType(T.IntegerType())),
        T.StructField("places", T.BinaryType()), T.StructField("slices", T.BinaryType())])
    weights = counted.sparkSession.sparkContext.broadcast(np.array([weight(int(x), total) for x in df], np.int64))

    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.take(pc.sort_indices(part.column("doc_id"), null_placement="at_start")).combine_chunks()
        n = part.column("n").to_pylist()
        m = np.array([25 + 75 * x * total // length for x in n], np.int64)
        held = np.asarray(pc.list_value_length(part.column("terms")))
        place = np.repeat(np.arange(len(n)), held)
        term, tf = (np.asarray(pc.list_flatten(part.column(c))).astype(np.int64) for c in ("terms", "times"))
        impact = weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
        order = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[order], return_index=True)
        packed = [slices(x) for x in np.split(impact[order], starts[1:])] if len(terms) else []
        sizes = np.diff(np.append(starts, len(order)))
        one = lambda x, kind: pa.array([x], kind)
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [one(part.column("doc_id").to_pylist(), to_arrow_type(schema["ids"].dataType)), one(terms, ints), one(sizes, ints), one([len(p) for p in packed], ints),
             one(place[order].astype(np.uint16).tobytes(), pa.binary()), one(b"".join(p.tobytes() for p in packed), pa.binary())], names=schema.names)

    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, size - held)
                batch = batch.slice(some.num_rows)
                waiting.append(some)
                held += some.num_rows
                if held == size:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
        if held:
            yield block(pa.Table.from_batches(waiting))

    return counted.mapInArrow(run, schema)


class Block:
    """A row of the index, with the slices of the terms that are asked for spread out over the block's documents."""

    def __init__(self, row: dict):
        self.n, self.words = len(row["ids"]), -(-len(row["ids"]) // 64)
        sizes, bits = np.asarray(row["sizes"], np.int64), np.asarray(row["bits"], np.int64)
        self.places, self.packed = np.frombuffer(row["places"], np.uint16), np.frombuffer(row["slices"], np.uint8)
        width = -(-sizes // 8)
        ends, upto = np.cumsum(sizes), np.cumsum(bits * width)
        self.at = {t: x for t, *x in zip(row["terms"], (ends - sizes).tolist(), sizes.tolist(), (upto - bits * width).tolist(), bits.tolist(), width.tolist())}
        self.spread: dict[int, np.ndarray | None] = {}
        self.held = 0

    def term(self, number: int) -> np.ndarray | None:
        """Slices x words of 64 documents; None where no document of the block has the term."""
        if number not in self.spread:
            out = None
            if number in self.at:
                start, size, from_, bits, width = self.at[number]
                own = np.unpackbits(self.packed[from_ : from_ + bits * width].reshape(bits, width), axis=1, count=size, bitorder="little")
                out = np.zeros((bits, self.words * 64), np.uint8)
                out[:, self.places[start : start + size]] = own
                out = np.packbits(out, axis=1, bitorder="little").view("<u8")
                self.held += out.nbytes
            if self.held > SPREAD_BYTES:
                self.spread.clear()
                self.held = 0
            self.spread[number] = out
        return self.spread[number]

    def scores(self, numbers: list[int]) -> np.ndarray:
        """The sum of the terms' impacts, in slices: a ripple-carry addition of all documents at once."""
        total: list[np.ndarray] = []
        for number in numbers:
            added = self.term(number)
            if added is None:
                continue
            carry = None
            for j in range(max(len(total), len(added))):
                if j >= len(added) and carry is None:
                    break
                b = added[j] if j < len(added) else None
                if j == len(total):
                    total.append(np.zeros(self.words, np.uint64))
                a = total[j]
                parts = [x for x in (b, carry) if x is not None]
                if len(parts) == 1:
                    total[j], carry = a ^ parts[0], a & parts[0]
                else:
                    half = a ^ b
                    total[j], carry = half ^ carry, (a & b) | (half & carry)
                if not carry.any():
                    carry = None
            if carry is not None:
                total.append(carry)
        return np.array(total, np.uint64).reshape(len(total), self.words)

    def best(self, numbers: list[int], k: int) -> list[tuple[int, int]]:
        """(place, score) of the k highest scores above 0, of equal ones those that come first."""
        total = self.scores(numbers)
        chosen, open_, have = np.zeros(self.words, np.uint64), np.bitwise_or.reduce(total, axis=0), 0
        for row in total[::-1]:
            with_bit = open_ & row
            more = int(np.bitwise_count(with_bit).sum())
            if have + more > k:
                open_ = with_bit
            else:
                chosen, have = chosen | with_bit, have + more
                open_ = open_ & ~row
                if have == k:
                    break
        places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        found = np.concatenate((places(chosen), places(open_)[: k - have]))
        value = total[:, found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)
        return list(zip(found.tolist(), (value << np.arange(len(total), dtype=np.uint64)[:, None]).sum(axis=0).tolist()))


def search(index: DataFrame, items: list[tuple[object, list[int]]], item_type: T.DataType, k: int) -> DataFrame:
    """item_no, item_id, doc_id, score: the best k of every block for each item, given as id and numbers of its terms."""
    schema = T.StructType([
        T.StructField("item_no", T.IntegerType()), T.StructField("item_id", item_type), T.StructField("doc_id", index.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                block, out = Block(row), []
                for no, (item_id, numbers) in enumerate(shared.value):
                    out += [(no, item_id, row["ids"][place], score) for place, score in block.best(numbers, k)]
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(cols, schema)], names=schema.names)

    return index.mapInArrow(run, schema)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, size: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item of (item_id, text)."""
    spark, item_type = docs.sparkSession, items.schema["item_id"].dataType
    small_batches(spark)
    asked = items.where("length(text) > 0").select("item_id", "text").distinct()
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-chars // BLOCK_CHARS)), []
    best = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_CHARS
        numbers: dict[bytes, int] = {}
        queries = [(r["item_id"], [numbers.setdefault(t, len(numbers)) for t in terms_of(r["text"].encode("utf-8", "surrogatepass"))]) for r in rows]
        with scratch() as kept:
            counted = materialize(count_terms(docs, numbers), "term-counts")
            total, length = counted.agg(F.count("*"), F.sum("n")).first()
            df = np.zeros(len(numbers), np.int64)
            for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the items' terms
                df[term] = n
            index = materialize(build(counted, df, total, length or 1, size), "impacts")
            found = search(index, queries, item_type, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            parts.append(materialize(found.select("item_id", "rank", "doc_id", "score"), "ranked"))
            kept.append(parts[-1])
    return reduce(DataFrame.unionByName, parts)


ORACLE = r"""
with docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark),
totals as (select count(*) filter (len(t) > 0) as n_docs, sum(len(t))::bigint as all_terms from docs),
asked as (select item_id, term, count(*) as times from (select item_id, unnest(t) as term from items) group by all),
held as (select doc_id, n, term, count(*) as tf from (select doc_id, len(t) as n, unnest(t) as term from docs) where term in (select term from asked) group by all),
weights as (
    select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w
    from held, totals group by term, n_docs),
scores as (
    select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // all_terms))))::bigint as score
    from held join weights using (term) join asked using (term), totals group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0 qualify rank <= 10
"""
