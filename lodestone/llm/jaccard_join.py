"""N-gram Jaccard join (8): prefix filters under several global token orders, intersected before verification.

Two sets with Jaccard similarity of at least t share a token among the first |x| - ceil(t |x|) + 1 tokens of
each, whatever the global order. Order A sorts shingles by how common they are (a counting sketch of bounded
size over all documents), then by hash; its prefixes are the postings that make candidates. Orders B and C sort
by two other hashes; a candidate must share a prefix token under each of them too before its texts are sent and
compared.

Documents with equal sets are one representative. Copies of one text that stay just under the similarity share
most of its shingles, so postings alone would pair them all. Therefore candidates are made in steps that are
each linear in the size of such a group:

1. Every representative is paired with one hub, the first posting of most of its prefix tokens. Where the two
   are alike (at least `NEAR`, below the wanted similarity), its difference from the hub is kept: the tokens that
   only one of them holds. What links is contracted to components.
2. A token whose postings lie in several components sends its representatives to the other hubs of that token,
   so that any two that share a prefix token have their differences from one hub in common. Those without a
   hub are paired with each other, by size classes and parity sketches where a token has many of them.
3. The distance of two sets is that of their differences from a common hub. Where it is small enough, either both
   link to the hub, or their differences overlap by a known number of tokens. These are few and rare, so their
   prefixes, rarest first in the hub's group, are joined, again under orders A, B and C, and verified exactly.

No partner is capped, and no link between different components is lost, so components are exact.

Defined cases: letters A-Z count as lower case, words are separated by ASCII white space; texts with fewer
words than a shingle are one shingle; texts without words, and null texts, have no shingle and link with
nothing; documents with equal sets are linked; rows with a null doc_id keep their row, have a null component
and link nothing; rows that repeat a doc_id belong to the links of all its texts (in `keep_one`, where only texts
count, each text is judged by itself); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, connected_components, discard, materialize, scratch, small_batches, sweep, unused, word_hashes

#: Counters of the sketch that orders shingles by frequency; what one task emits and what is broadcast.
COUNTERS, COUNTER_BLOCK = 1 << 18, 1 << 10
#: Texts that meet in a group; rows of ids that may be broadcast to leave out unneeded texts before a shuffle.
GROUP, BROADCAST_IDS = 64, 500_000
#: Longs of a set's parity sketch; loose postings of a token from which on they are joined by size and sketch.
SKETCH_LONGS, HOT_TOKEN = 8, 8
#: Least similarity, as a fraction, to a hub by whose difference a set may be represented.
NEAR = (1, 2)
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
A, B, C = 0, 1, 2


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit permutation, so that each salt gives another order of the same tokens."""
    x = x ^ _ODD[salt]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(text: str | None, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles in order, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=1)], dtype=np.uint64)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = out * _ODD[0] + h[i : n - k + 1 + i]
        out ^= out >> np.uint64(32)
    return out * _ODD[1]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    return np.unique(rolled(text, k))


def parities(s: np.ndarray) -> np.ndarray:
    """A bit for each bucket of tokens: whether an odd number of them is in the set. Two sets' sketches differ in no more bits
    than the tokens that only one of them holds."""
    odd = np.bincount((mix(s, 3) & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int, num: int, den: int) -> int:
    """|x| - ceil(t |x|) + 1 for t = num / den, in whole numbers."""
    return n - -(-num * n // den) + 1


def _bucket(s: np.ndarray) -> np.ndarray:
    return (mix(s, 3) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _first(s: np.ndarray, key: np.ndarray, p: int) -> np.ndarray:
    """Positions of the p smallest keys, in order."""
    at = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return at[np.argsort(key[at], kind="stable")]


def common_prefix(s: np.ndarray, p: int, counts: np.ndarray) -> np.ndarray:
    """The first p tokens under order A: 20 high bits of frequency, then hash."""
    common = np.minimum(counts[_bucket(s)], (1 << 20) - 1).astype(np.uint64)
    return s[_first(s, (common << np.uint64(44)) | (mix(s, A) >> np.uint64(20)), p)]


def hashed_prefix(s: np.ndarray, order: int, p: int) -> np.ndarray:
    """The first p tokens under order B or C, as the 32 high bits of their keys: equal tokens stay equal."""
    key = mix(s, order)
    return (key[_first(s, key, p)] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def count_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Occurrences of all documents' shingles by bucket: each task adds up its own, blocks of counters are then summed."""

    def run(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text"):
                np.add.at(total, _bucket(rolled(t.as_py(), k)), 1)
        parts = np.minimum(total, (1 << 31) - 1).astype(np.int32).reshape(-1, COUNTER_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])

    def add(table):
        total = np.zeros(COUNTER_BLOCK, dtype=np.int64)
        for part in table.column("counts"):
            total += np.frombuffer(part.as_py(), dtype=np.int32)
        total = np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total], pa.binary())})

    schema = "block int, counts binary"
    out = np.zeros(COUNTERS, dtype=np.int32)
    for r in docs.select("text").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect():  # COUNTERS numbers
        out[r["block"] * COUNTER_BLOCK : (r["block"] + 1) * COUNTER_BLOCK] = np.frombuffer(r["counts"], dtype=np.int32)
    return out


def describe(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n (size of the set), print (hash of the set), its prefix under order A and its parity sketch."""
    counts = docs.sparkSession.sparkContext.broadcast(count_shingles(docs, k))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("print", T.StringType()), T.StructField("a", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))])

    def run(batches):
        none = np.zeros(0, np.int64)
        for batch in batches:
            n, prints, a, parity = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                a.append(common_prefix(s, prefix_length(len(s), num, den), counts.value).view(np.int64) if len(s) else none)
                parity.append(parities(s))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (a, parity)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int32()), pa.array(prints, pa.string()), *lists], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


class Graph:
    """members: doc_id, text_hash, n, rep of every row; owners: rep, doc_id, text_hash of one document for each set;
    links: pairs (a, b) of representatives that reach the similarity and connect every component. tables: those that
    members are read from."""

    def __init__(self, members: DataFrame, owners: DataFrame, links: DataFrame, tables: list[DataFrame]):
        self.members, self.owners, self.links, self.tables = members, owners, links, tables


def similar(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> Graph:
    """Links among the distinct sets of docs; num / den is the least Jaccard similarity."""
    small_batches(docs.sparkSession)
    described = materialize(describe(docs, k, num, den), "shingles")
    kept = described.where("print is not null and doc_id is not null")
    # The written numbers of representatives are as good as random, and longs are cheaper to carry than prints.
    reps = materialize(kept.groupBy("print").agg(F.min("doc_id").alias("owner")).withColumn("rep", F.monotonically_increasing_id()), "reps")
    members = described.select("doc_id", "text_hash", "n", "print").join(reps.select("print", "rep").hint("merge"), "print", "left").drop("print")
    sets = kept.join(reps.hint("merge"), "print").where("doc_id = owner").groupBy("rep").agg(F.first(F.struct("doc_id", "text_hash", "n", "a", "parity")).alias("s"))
    sets = materialize(sets.select("rep", "s.*"), "sets")
    owners = sets.select("rep", "doc_id", "text_hash")
    sweep(docs.sparkSession)

    posts = sets.select("rep", "n", F.posexplode("a").alias("pos", "token"))
    several = posts.groupBy("token").agg(F.count("*").alias("m"), F.min("rep").alias("hub")).where("m > 1").drop("m")
    shared = materialize(posts.join(several.hint("merge"), "token").select("token", "rep", "n", "pos", "hub"), "postings")

    # 1. one hub for each representative
    sweep(docs.sparkSession)
    votes = shared.where("hub != rep").groupBy("rep", "hub").agg(F.count("*").alias("v"))
    star = materialize(votes.groupBy("rep").agg(F.max_by("hub", F.struct("v", -F.col("hub"))).alias("hub")), "stars")
    core = materialize(differences(docs, star, owners, k, num, den, near=True), "differences")
    links = core.where("linked").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    found = connected_components(links)
    own = core.select("rep", F.col("hub").alias("group")).unionByName(
        core.select(F.col("hub").alias("rep")).distinct().join(core.select("rep"), "rep", "left_anti").withColumn("group", F.col("rep")))
    place = materialize(own.join(found.hint("merge"), own["rep"] == found["node"], "left").select("rep", "group", F.coalesce("component", "rep").alias("comp")), "places")

    # 2. what shares a prefix token and is not connected yet
    labelled = materialize(
        shared.join(place.hint("merge"), "rep", "left").select("token", "rep", "n", "pos", "group", F.coalesce("comp", "rep").alias("comp")), "labelled")
    discard(shared, star)
    sweep(docs.sparkSession)
    open_tokens = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    rest = materialize(labelled.join(open_tokens.hint("merge"), "token"), "open-postings")
    discard(labelled)
    # Two sets of n and m members that reach the similarity have so many in common at least ...
    need = lambda n, m: f"(({num} * ({n} + {m}) + {num + den} - 1) div {num + den})"
    groups = rest.where("group is not null").groupBy("token", "group").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.expr("n - pos")).alias("left"))
    x, y = rest.alias("x"), groups.alias("y")
    # ... and no more than this once their first common token stands at these positions.
    able = f"least(x.n - x.pos, y.left) >= {need('x.n', 'y.least')} and x.n * {den} >= y.least * {num} and y.most * {den} >= x.n * {num}"
    halo = x.join(y.hint("merge"), F.expr(
        f"x.token = y.token and not (x.group <=> y.group) and x.rep != y.group and not (y.lo = y.hi and y.lo = x.comp) and {able}"))
    halo = materialize(halo.select("x.rep", F.col("y.group").alias("hub")).distinct(), "halos")
    around = materialize(differences(docs, halo, owners, k, num, den, near=False), "differences")
    links = links.unionByName(around.where("linked").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    pairs = pair_loose(rest.where("group is null"), sets.select("rep", "n", "parity"), num, den)
    pairs = materialize(pairs, "all-pairs")
    pairs = materialize(in_other_orders(docs, pairs, owners, k, num, den), "pairs")
    links = links.unionByName(materialize(verify(docs, pairs, owners, k, num, den), "pair-links"))

    # 3. by differences from a common hub
    links = links.unionByName(materialize(by_differences(core, around, place, num, den), "difference-links"))
    discard(rest, halo, pairs, place)
    sweep(docs.sparkSession)
    return Graph(members, owners, links, [described, reps])


def pair_loose(loose: DataFrame, parity: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the postings `loose` (token, rep, n, pos) that share a token and may reach the similarity.

    Sizes and positions decide first, then the sets' parity sketches, which may differ in no more bits than the sets in
    tokens: texts that share passages are told apart without being sent. Tokens with more than HOT_TOKEN postings are dealt
    by classes of sizes as well, for sets that link have sizes in the same class or the next, and their sketches are
    compared before there is a pair; the pairs of others are no more than a multiple of their postings, and are compared after.
    """
    need = lambda n, m: f"(({num} * ({n} + {m}) + {num + den} - 1) div {num + den})"
    able = f"least(x.n - x.pos, y.n - y.pos) >= {need('x.n', 'y.n')} and x.n * {den} >= y.n * {num} and (x.n < y.n or (x.n = y.n and x.rep < y.rep))"
    ordered = (F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    hot = materialize(loose.groupBy("token").count().where(F.col("count") > HOT_TOKEN).select("token"), "hot-tokens")
    few = loose.join(hot.hint("merge"), "token", "left_anti")
    differ = lambda x, y: " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(SKETCH_LONGS))
    near = lambda x, y, n, m: F.expr(f"({differ(x, y)}) * {num + den} <= {den - num} * ({n} + {m})")
    side = lambda name: parity.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("parity").alias(f"p_{name}")).hint("merge")
    pairs = few.alias("x").join(few.alias("y").hint("merge"), F.expr(f"x.token = y.token and {able}")).select(*ordered).distinct()
    pairs = materialize(pairs, "few-pairs").join(side("a"), "a").join(side("b"), "b").where(near("p_a", "p_b", "n_a", "n_b")).select("a", "b")
    # Wider than the ratio that sets may have, so that rounding parts none.
    size_class = F.floor(F.ln("n") / (1.001 * np.log(den / num)))
    many = loose.join(hot.hint("merge"), "token", "left_semi").join(parity.select("rep", "parity").hint("merge"), "rep").withColumn("class", size_class)
    many = materialize(many.select("token", "rep", "n", "pos", "class", "parity"), "hot-postings")
    x = many.withColumn("class", F.explode(F.array("class", F.col("class") + 1))).alias("x")
    same = F.expr(f"x.token = y.token and x.class = y.class and {able}") & near("x.parity", "y.parity", "x.n", "y.n")
    return pairs.union(x.join(many.alias("y").hint("merge"), same).select(*ordered)).distinct()


def in_other_orders(docs: DataFrame, pairs: DataFrame, owners: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that share a prefix token under order B and under order C; these prefixes are made for the pairs' sets alone."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column("text")]
            cols = [pa.array([hashed_prefix(s, o, prefix_length(len(s), num, den)) for s in sets], pa.list_(pa.int32())) for o in (B, C)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *cols], names=["rep", "b", "c"])

    named = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = _texts(docs, named, owners).mapInArrow(run, "rep long, b array<int>, c array<int>").dropDuplicates(["rep"])
    sets = materialize(sets, "prefixes")
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("b").alias(f"b_{name}"), F.col("c").alias(f"c_{name}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("b_a", "b_b") & F.arrays_overlap("c_a", "c_b")).select("a", "b")


def _texts(docs: DataFrame, roles: DataFrame, owners: DataFrame) -> DataFrame:
    """The texts of the representatives in `roles`, one copy for each role."""
    wanted = materialize(roles.join(owners.hint("merge"), "rep"), "roles")
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    ids = wanted.select("doc_id", "text_hash").distinct()
    # While the ids are few, texts that nothing needs are left out before the shuffle; beyond, the join itself drops them.
    if wanted.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), ["doc_id", "text_hash"], "left_semi")
    return wanted.join(texts.hint("merge"), ["doc_id", "text_hash"]).drop("doc_id", "text_hash")


def _dealt(pairs: DataFrame, hub: str, other: str) -> DataFrame:
    """rep, hub, part: a hub's partners in groups of about GROUP, with the hub itself in each."""
    size = materialize(pairs.groupBy(hub).agg(F.count("*").alias("m")), "hub-sizes")
    parts = F.ceil(F.col("m") / GROUP)
    dealt = pairs.join(size.hint("merge"), hub).select(F.col(other).alias("rep"), F.col(hub).alias("hub"), F.pmod(F.xxhash64(other), parts).alias("part"))
    # The hub's own rows come from its count: nothing is gathered by hub, so the rows of a large one can be split.
    return dealt.union(size.select(F.col(hub).alias("rep"), F.col(hub).alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")))


def difference_overlap(size: int, n: int, hub: int, num: int, den: int) -> tuple[int, int]:
    """Least overlap of this set's difference s from its hub with the difference t of a set that links to it and is not
    connected to it by the hub already: where t is the larger one of the two differences, and where s is.

    Two sets of n and m tokens link where d <= c (n + m), for c = (den - num) / (den + num) and d = |s| + |t| - 2 |s & t|
    the tokens that one of them holds alone. So |s & t| >= (|s| + |t| - c (n + m)) / 2. One of the two does not link to
    the hub of h tokens, |s| > c (n + h) or |t| > c (m + h), and sizes differ from h by no more than |s| or |t|.
    """
    p, q = num + den, den - num
    excess = size * p - q * (n + hub)  # p (|s| - c (n + h)), above 0 where this set does not link to the hub
    apart = max(1, (size * p + q * (hub - n)) // (2 * p) + 1)  # where t's set does not
    if excess <= 0:
        return apart, apart
    other = max(1, size - q * n // num)  # |t| at least, by the triangle inequality and the ratio of n and m
    overlap = lambda t: min(apart, max(1, -(-(excess + 2 * num * t) // (2 * p))))
    return overlap(size), overlap(other)


def differences(docs: DataFrame, pairs: DataFrame, owners: DataFrame, k: int, num: int, den: int, near: bool) -> DataFrame:
    """For pairs (rep, hub): whether they link, and the difference of their sets with its prefixes under orders B and C;
    small and large are the overlaps of `difference_overlap`.

    near: pairs that share no prefix token under B or C, or are less alike than NEAR, are left out. Otherwise those are
    whose distance from the hub is beyond that of its near sets and of anything that links to one of them.
    """
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    kinds = {"rep": T.LongType(), "hub": T.LongType(), "n": T.IntegerType(), "linked": T.BooleanType(), "small": T.IntegerType(), "large": T.IntegerType(), "s": longs, "b": ints, "c": ints}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()])
    p, q = num + den, den - num
    near_p, near_q = NEAR[0] + NEAR[1], NEAR[1] - NEAR[0]

    def run(table):
        hub = table.column("hub")[0].as_py()
        sets = {r.as_py(): t for r, t in zip(table.column("rep"), table.column("text"))}  # repeated rows are one
        rows = []
        if hub in sets:
            base = shingle_set(sets.pop(hub).as_py(), k)
            h, prefixes = len(base), [hashed_prefix(base, o, prefix_length(len(base), num, den)) for o in (B, C)]
            for rep, text in sets.items():
                x = shingle_set(text.as_py(), k)
                n = len(x)
                if near and not all(np.intersect1d(f, hashed_prefix(x, o, prefix_length(n, num, den))).size for o, f in zip((B, C), prefixes)):
                    continue
                s = np.setxor1d(x, base, assume_unique=True)
                size, linked = len(s), len(s) * p <= q * (n + h)
                m = n * den // num + 1  # the size of what links to x is less
                if size * near_p > near_q * (n + h) and (near or size * p * near_p > q * (n + m) * near_p + near_q * (m + h) * p):
                    continue
                small, large = difference_overlap(size, n, h, num, den)
                length = max(0, size - min(small, large) + 1)
                rows.append((rep, hub, n, linked, small, large, s.view(np.int64), *(hashed_prefix(s, o, length) if length and size else np.zeros(0, np.int32) for o in (B, C))))
        cols = list(zip(*rows)) if rows else [[]] * len(kinds)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.table({c: pa.array(list(v), t) for c, v, t in zip(kinds, cols, types)})

    return _texts(docs, _dealt(pairs, "hub", "rep"), owners).groupBy("hub", "part").applyInArrow(run, schema)


def by_differences(core: DataFrame, around: DataFrame, place: DataFrame, num: int, den: int) -> DataFrame:
    """Links between sets of different components that have their differences from one hub in common."""
    p, q = num + den, den - num
    comps = place.select("rep", "comp").hint("merge")
    every = core.unionByName(around).join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # A hub whose whole group is one component has nothing left to connect; the hub's own component counts too.
    hubs = core.unionByName(around).select("hub").distinct().join(place.select(F.col("rep").alias("hub"), "comp").hint("merge"), "hub", "left")
    span = every.select("hub", "comp").unionByName(hubs.select("hub", F.coalesce("comp", "hub").alias("comp")))
    span = span.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("hub")
    span = materialize(span, "open-hubs")  # so that the rows of a large hub can be split
    inside = materialize(every.join(span.hint("merge"), "hub").withColumn("size", F.size("s")), "inside")
    tokens = inside.select("hub", "rep", "comp", F.explode("s").alias("token"))
    # Order A, rarest first. Tokens that connect nothing come before all others, so they need no row.
    useful = tokens.groupBy("hub", "token").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").drop("lo", "hi")
    ranked = tokens.join(useful.hint("merge"), ["hub", "token"]).groupBy("hub", "rep").agg(F.sort_array(F.collect_list(F.struct("m", "token"))).alias("t"))
    ranked = ranked.join(inside.select("hub", "rep", "n", "comp", "size", "small", "large").hint("merge"), ["hub", "rep"])
    before = F.col("size") - F.size("t")
    posts = ranked.select("hub", "rep", "n", "comp", "size", "small", "large", before.alias("before"), F.posexplode("t").alias("at", "t")).select(
        "hub", "t.token", "rep", "n", "comp", "size", "small", "large", (F.col("before") + F.col("at")).alias("pos")).where("pos <= size - least(small, large)")
    posts = materialize(posts, "difference-postings")
    # The smaller difference has more than about half of its tokens in common with the larger one, so its prefix is short
    # and holds its rare tokens; the larger one's prefix is only looked up.
    x, y = posts.where("pos <= size - small").alias("x"), posts.where("pos <= size - large").alias("y")
    able = (f"abs(x.size - y.size) * {p} <= {q} * (x.n + y.n) and least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num} and "
            f"least(x.size - x.pos, y.size - y.pos) * {2 * p} >= (x.size + y.size) * {p} - (x.n + y.n) * {q}")
    pairs = x.join(y.hint("merge"), F.expr(
        f"x.hub = y.hub and x.token = y.token and (x.size < y.size or (x.size = y.size and x.rep < y.rep)) and x.comp != y.comp and {able}"))
    pairs = pairs.select("x.hub", F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    side = lambda name: inside.select("hub", F.col("rep").alias(name), F.struct("n", "s", "b", "c").alias(f"of_{name}")).hint("merge")
    both = pairs.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    both = both.where(F.arrays_overlap("of_a.b", "of_b.b") & F.arrays_overlap("of_a.c", "of_b.c"))
    apart = F.size("of_a.s") + F.size("of_b.s") - 2 * F.size(F.array_intersect("of_a.s", "of_b.s"))
    return both.where(apart * p <= q * (F.col("of_a.n") + F.col("of_b.n"))).select("a", "b").distinct()


def verify(docs: DataFrame, pairs: DataFrame, owners: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. The more frequent side of a pair is its hub."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("d"))
    d = lambda side: degree.select(F.col("rep").alias(side), F.col("d").alias(f"d_{side}")).hint("merge")
    turned = F.col("d_a") >= F.col("d_b")
    turned = pairs.join(d("a"), "a").join(d("b"), "b").select(
        F.when(turned, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("other"))

    def run(table):
        hub = table.column("hub")[0].as_py()
        sets = {r.as_py(): shingle_set(t.as_py(), k) for r, t in zip(table.column("rep"), table.column("text"))}
        base, rows = sets.pop(hub, None), []
        for rep, x in sets.items():
            if base is not None and np.setxor1d(x, base, assume_unique=True).size * (num + den) <= (den - num) * (len(x) + len(base)):
                rows.append(rep)
        return pa.table({"a": pa.array([hub] * len(rows), pa.int64()), "b": pa.array(rows, pa.int64())})

    return _texts(docs, _dealt(turned, "hub", "other"), owners).groupBy("hub", "part").applyInArrow(run, "a long, b long")


def components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; component_id is its own doc_id where nothing links."""
    with scratch() as kept:
        g = similar(docs, k, num, den)
        heads = materialize(_components(g), "components")
        kept += [*g.tables, heads]
    out = g.members.join(heads.hint("merge"), "rep", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _components(g: Graph) -> DataFrame:
    """rep, component: the smallest doc_id that links reach, where ids that repeat link their sets."""
    named = g.members.where("rep is not null and doc_id is not null").select("doc_id", "rep")
    repeated = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b")
    same_id = repeated.join(named, "doc_id").where("a != rep").select("a", F.col("rep").alias("b"))
    found = connected_components(g.links.unionByName(same_id))
    return _heads(g, found, F.min("doc_id")).select("rep", F.col("head").alias("component"))


def _heads(g: Graph, found: DataFrame, best: Column) -> DataFrame:
    """rep, head: the best owner of each representative's component."""
    at = g.owners.join(found.hint("merge"), g.owners["rep"] == found["node"], "left").select("rep", "doc_id", "text_hash", F.coalesce("component", "rep").alias("comp"))
    at = materialize(at, "owners")
    return at.select("rep", "comp").join(at.groupBy("comp").agg(best.alias("head")).hint("merge"), "comp")


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id, with the columns of docs.

    Rows without a shingle or an id stay. Of rows that repeat both id and text of the one that stays, the one with the
    smallest hash over all columns is taken.
    """
    with scratch() as kept:
        g = similar(docs, k, num, den)
        found = connected_components(g.links)
        heads = _heads(g, found, F.min_by("rep", F.struct("doc_id", "text_hash"))).where("rep = head").join(g.owners, "rep").select("doc_id", "text_hash")
        bare = g.members.where("rep is null and doc_id is not null").select("doc_id", "text_hash")
        heads = materialize(heads.unionByName(bare).distinct(), "heads")
        kept.append(heads)
    sweep(docs.sparkSession)
    kept_id, kept_hash, own_hash, row, rank = unused(docs, "__id", "__hash", "__text", "__row", "__rank")
    keys = heads.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash))
    hashed = docs.select(*docs.columns, F.xxhash64("text").alias(own_hash), F.xxhash64(*docs.columns).alias(row))
    joined = hashed.join(keys.hint("merge"), (F.col("doc_id") == F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)))
    first = Window.partitionBy(kept_id, kept_hash).orderBy(row)
    one = joined.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))
