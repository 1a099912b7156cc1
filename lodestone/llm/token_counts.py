"""Token counts (10): edit-aware counting over pre-token segment trees.

A text is cut into leaves of about LEAF characters. A leaf starts where a pre-token is sure to start, for pre-token
patterns of the kind "optional blank and letters, or digits, or other signs; else white space": at a single blank, tab
or newline between two characters that are not white space, and where a letter or digit of the scripts in `_SURE` is
followed by punctuation other than an apostrophe. No token reaches over such a place, so leaves are encoded
independently and their token counts add up. A document's tree holds, for every node, the characters and the tokens
below it. Text without such places (one endless run of letters) is one leaf and is encoded anew with each edit.

An edit replaces the characters [start, end) by other text. The leaves it touches are found by descending the
tree by character sums, widened by the leaf before if less than CONTEXT characters lie between its boundary and
the edit, and by the leaf behind if its boundary is no longer sure to be one. Only these are encoded again;
the sums on their ways to the root are then corrected. Edits of a document are applied one after another, each
to the text that the one before has left.

Trees are kept: `plant_trees` gives their leaves as a table keyed by doc_id and the text's hash, `edit_documents`
takes such a table and gives the leaves after the edits along with the texts, from which `trees_of` makes the next table. A
text that the table does not know is planted first, so the table may be behind or empty.

Defined cases: null and empty texts have no leaf and no tokens, and can be edited (inserted into); edits beyond
the text are clipped to it, with end < start taken as end = start, null bounds as 0 and a null replacement as
empty; edits of equal `seq` are applied by start, end, replacement; edits of unknown documents are ignored;
rows that repeat a doc_id are each edited alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

LEAF, CONTEXT = 512, 3
#: Short texts have shorter leaves: about so many, but none shorter than LEAST.
LEAVES, LEAST = 16, 64
#: One blank, tab or newline between characters that no white-space class contains (the pattern's is Unicode's, as
#: Python's); or a letter or digit (ASCII, kana, Han, hangul) before a sign.
_SURE = re.compile(r"(?<=\S)[ \t\n](?=\S)|(?<=[A-Za-z0-9ぁ-ゖァ-ヺ一-鿿가-힣])(?=[!-&(-/:-@\[-`{-~、。，；：！？「」『』（）])")


@lru_cache(maxsize=2)
def counter(ranks_path: str, pattern: str):
    """text -> number of tokens, for a text that begins at a sure boundary or at a document's start."""
    import tiktoken

    with open(ranks_path, "rb") as f:  # a vocabulary file of the machine, named by the caller
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def leaf_of(chars: int, most: int = LEAF) -> int:
    return min(most, max(LEAST, chars // LEAVES))


def boundaries(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of leaves: 0, then the first sure boundary at least `leaf` characters on."""
    out, at = ([0] if text else []), leaf
    while at < len(text):
        m = _SURE.search(text, at)
        if not m:
            break
        out.append(m.start())
        at = m.start() + leaf
    return out


class Tree:
    """Sums of characters and tokens over leaves, in an array: node i has children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.build(chars, tokens)

    def build(self, chars: list[int], tokens: list[int]) -> None:
        n = 1
        while n < max(len(chars), 1):
            n *= 2
        self.n, self.leaves = n, len(chars)
        self.chars = [0] * n + chars + [0] * (n - len(chars))
        self.tokens = [0] * n + tokens + [0] * (n - len(tokens))
        for i in range(n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character `at`; the last leaf beyond the end."""
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.n, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.n
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2


def plant(text: str, count, leaf: int = LEAF) -> Tree:
    starts = boundaries(text, leaf)
    parts = [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)])]
    return Tree([len(p) for p in parts], [count(p) for p in parts])


def apply_edit(text: str, tree: Tree, start: int, end: int, new: str, count, leaf: int = LEAF) -> tuple[str, int]:
    """The edited text and the number of characters encoded again; the tree is corrected in place."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    after = text[:start] + new + text[end:]
    if not tree.leaves:
        fresh = plant(after, count, leaf)
        tree.build(fresh.chars[fresh.n : fresh.n + fresh.leaves], fresh.tokens[fresh.n : fresh.n + fresh.leaves])
        return after, len(after)
    first, left = tree.find(max(start - CONTEXT, 0))
    last, right = tree.find(max(end - 1, start, 0))
    right += tree.chars[last + tree.n]
    shift = len(after) - len(text)
    # The boundary behind the touched leaves must still be a sure one.
    while right < len(text) and not (right + shift > left and _SURE.match(after, right + shift)):
        last += 1
        right += tree.chars[last + tree.n]
    if right < len(text) and right - CONTEXT < end:  # the leaf behind starts within reach of the edit
        last += 1
        right += tree.chars[last + tree.n]
        while right < len(text) and not _SURE.match(after, right + shift):
            last += 1
            right += tree.chars[last + tree.n]
    region = after[left : right + shift]
    starts = boundaries(region, leaf) or [0]
    parts = [region[a:b] for a, b in zip(starts, starts[1:] + [len(region)])]
    sums = [(len(p), count(p)) for p in parts]
    if len(parts) <= last - first + 1:
        for i in range(first, last + 1):
            tree.put(i, *(sums[i - first] if i - first < len(sums) else (0, 0)))
    else:  # more leaves than before: the sums are laid out anew, nothing else is encoded
        chars, tokens = tree.chars[tree.n :][: tree.leaves], tree.tokens[tree.n :][: tree.leaves]
        chars[first : last + 1], tokens[first : last + 1] = [c for c, _ in sums], [t for _, t in sums]
        tree.build(chars, tokens)
    return after, len(region)


EDIT = "struct<start:bigint,`end`:bigint,replacement:string>"
LEAVES_TYPE = "struct<chars:array<int>,tokens:array<int>>"


def plant_trees(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, text_hash, chars, tokens: the leaves of every text, to be written and kept."""
    small_batches(docs.sparkSession)
    none = F.array().cast(f"array<{EDIT}>")
    planted = _run(docs.select("doc_id", "text", none.alias("edits"), F.lit(None).cast(LEAVES_TYPE).alias("leaves")), ranks_path, pattern, leaf, False)
    return planted.select("doc_id", "text_hash", "chars", "tokens")


def trees_of(edited: DataFrame) -> DataFrame:
    """The table of trees after `edit_documents`."""
    return edited.select("doc_id", "text_hash", "chars", "tokens")


def edit_documents(docs: DataFrame, edits: Column | DataFrame, ranks_path: str, pattern: str, trees: DataFrame | None = None, leaf: int = LEAF, texts: bool = True) -> DataFrame:
    """doc_id, text (after; where `texts`), text_hash, chars, tokens (leaves after), n_tokens, n_tokens_after, n_chars_after, n_leaves,
    n_reencoded (characters encoded for edits), n_planted (characters encoded for want of a kept tree).

    edits: a column of array<struct<start, end, replacement>>, or a table (doc_id, seq, start, end, replacement); edits of one
    document are a sequence and come together. trees: as `plant_trees` or `trees_of` has given it.
    """
    small_batches(docs.sparkSession)
    if isinstance(edits, DataFrame):
        lists = edits.where("doc_id is not null").groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("x"))
        lists = lists.select(F.col("doc_id").alias("__id"), F.transform("x", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"))).cast(f"array<{EDIT}>").alias("edits"))
        rows = docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "edits")
    else:
        rows = docs.select("doc_id", "text", edits.cast(f"array<{EDIT}>").alias("edits"))
    if trees is None:
        rows = rows.withColumn("leaves", F.lit(None).cast(LEAVES_TYPE))
    else:  # of repeated rows one tree is enough
        kept = trees.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.any_value(F.struct("chars", "tokens")).cast(LEAVES_TYPE).alias("leaves"))
        rows = rows.join(kept.hint("merge"), rows["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64("text") == kept["__hash"]), "left").select("doc_id", "text", "edits", "leaves")
    return _run(rows, ranks_path, pattern, leaf, texts)


COUNTED = ["n_tokens", "n_tokens_after", "n_chars_after", "n_leaves", "n_reencoded", "n_planted"]


def count_edited(docs: DataFrame, edits: Column, ranks_path: str, pattern: str, leaf: int = LEAF, trees: DataFrame | None = None) -> DataFrame:
    """doc_id and the counts, for texts whose edits lie in their row; without kept trees no text is shuffled."""
    return edit_documents(docs, edits, ranks_path, pattern, trees, leaf, False).select("doc_id", *COUNTED)


def count_tokens(docs: DataFrame, edits: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF, trees: DataFrame | None = None) -> DataFrame:
    """The same for a table of edits (doc_id, seq, start, end, replacement)."""
    return edit_documents(docs, edits, ranks_path, pattern, trees, leaf, False).select("doc_id", *COUNTED)


def _run(rows: DataFrame, ranks_path: str, pattern: str, leaf: int, texts: bool) -> DataFrame:
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        rows.schema["doc_id"], *([T.StructField("text", T.StringType())] if texts else []), T.StructField("text_hash", T.LongType()), T.StructField("chars", ints),
        T.StructField("tokens", ints), *[T.StructField(c, T.LongType()) for c in COUNTED]])

    def run(batches):
        count = counter(ranks_path, pattern)
        for batch in batches:
            out = []
            for text, edits, known in zip(batch.column("text"), batch.column("edits"), batch.column("leaves")):
                null, text = not text.is_valid, text.as_py() or ""
                size = leaf_of(len(text), leaf)
                if known.is_valid:
                    known = known.as_py()
                    tree, planted = Tree(known["chars"], known["tokens"]), 0
                else:
                    tree, planted = plant(text, count, size), len(text)
                before, leaves, again = tree.tokens[1], tree.leaves, 0
                for e in edits.as_py() or []:
                    text, n = apply_edit(text, tree, e["start"] or 0, e["end"] or 0, e["replacement"] or "", count, size)
                    again += n
                held = [i for i in range(tree.n, tree.n + tree.leaves) if tree.chars[i]]
                # As Spark's xxhash64 of the text; a null one that is not edited stays null, and has its seed.
                null = null and not text
                digest = 42 if null else xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
                after = [None if null else text] if texts else []
                out.append((*after, digest - (digest >> 63 << 64), [tree.chars[i] for i in held], [tree.tokens[i] for i in held], before, tree.tokens[1], tree.chars[1], leaves, again, planted))
            cols = list(zip(*out)) or [()] * (len(schema) - 1)
            kinds = [*([pa.string()] if texts else []), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * len(COUNTED)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=schema.names)

    return rows.mapInArrow(run, schema)
