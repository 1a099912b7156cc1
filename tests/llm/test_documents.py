"""Operators without SQL, against brute force, exact round trips and held-out accuracy."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, jaccard_join, line_dedup, packing, quality_knn, queries, token_counts
from tests.llm.conftest import rows_of

LONG = " ".join(f"w{i % 977}" for i in range(30_000))


# --- quality classifier -----------------------------------------------------------------------------------


def test_classifier_held_out(spark, sf):
    rows = queries.QUERIES["op1_quality_classifier"](spark, sf.replace("sf0.001", "sf0.01")).join(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_classifier_odd_rows(spark, make):
    docs = make([(1, None), (2, ""), (3, LONG), (3, LONG), (None, "x"), (5, "a b c")]).withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, None), (None, 1)], "doc_id long, label int")
    got = quality_knn.classify(docs, quality_knn.fit(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    bare = quality_knn.classify(docs, quality_knn.fit(docs, labels.limit(0)))
    assert {r["score"] for r in bare.collect()} == {0.5}
    assert quality_knn.classify(docs.limit(0), quality_knn.fit(docs, labels)).count() == 0


def test_classifier_blocks_are_exact():
    rng = np.random.default_rng(0)
    rows = rng.random((300, quality_knn.TERMS)).astype(np.float32)
    model = quality_knn.Model(rows[:200].copy(), (np.arange(200) % 2).astype(int), 8)
    assert np.allclose(model.score(rows[200:], 5, block=7), model.score(rows[200:], 5, block=1000), atol=1e-5)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_classifier_equals_brute_force(block):
    """Every document against every labelled vector, sorted whole: by similarity, then by place. Vectors of few whole numbers, so many tie."""
    rng = np.random.default_rng(1)
    model = quality_knn.Model(np.zeros((0, quality_knn.TERMS), np.float32), np.zeros(0))
    model.labels, model.unit = rng.integers(0, 2, 150).astype(np.float32), rng.integers(-1, 3, (150, 8)).astype(np.float32)
    docs = rng.integers(-1, 3, (60, 8)).astype(np.float32)
    model.project = lambda rows: rows
    for v, score in zip(docs, model.score(docs, 9, block=block)):
        best = sorted(range(150), key=lambda i: (-float(v @ model.unit[i]), i))[:9]
        weights = [max(float(v @ model.unit[i]), 0.0) ** 8 for i in best]
        assert abs(score - sum(w * model.labels[i] for w, i in zip(weights, best)) / sum(weights)) < 1e-5


def test_classifier_votes_of_all_labelled_rows(spark, sf):
    """The query's scores are those of a plain vote over all pairs of documents and labelled rows."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality_knn.fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op1_quality_classifier"](spark, sf).collect()}
    texts = docs.orderBy("doc_id").collect()
    v = model.project(np.stack([quality_knn.features(r["text"], quality_knn.Bins()) for r in texts]))
    for r, sims in zip(texts, v.astype(np.float64) @ model.unit.T.astype(np.float64)):
        best = np.argsort(-sims, kind="stable")[: quality_knn.NEIGHBOURS]
        w = np.maximum(sims[best], 0) ** 8
        assert abs(got[r["doc_id"]] - (w @ model.labels[best]) / w.sum()) < 0.02


# --- line dedup ---------------------------------------------------------------------------------------------


def brute_dedup(texts, least=50):
    """Lines that a later copy of a run of at least `least` words must lose: those in runs shared with any earlier place."""
    lines = [t.split("\n") for t in texts]
    out = []
    for d, mine in enumerate(lines):
        cut = set()
        for e in range(d + 1):
            theirs = lines[e]
            for i in range(len(mine)):
                for j in range(len(theirs)):
                    if (e == d and j >= i) or mine[i] != theirs[j] or (i and j and mine[i - 1] == theirs[j - 1] and not (e == d and j - 1 >= i - 1)):
                        continue
                    n = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in mine[i : i + n]) >= least:
                        cut |= set(range(i, i + n))
        out.append(cut)
    return out


def test_dedup_cuts_planted_passages(spark, make):
    rng = random.Random(4)
    line = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passages = [[line(9) for _ in range(8)] for _ in range(3)] + [[line(60)]]
    texts = []
    for _ in range(25):
        own = [line(rng.randint(3, 12)) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(own))
        texts.append("\n".join(own[:at] + rng.choice(passages) + own[at:]))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(make(list(enumerate(texts)))).collect()}
    for d, cut in enumerate(brute_dedup(texts)):
        assert got[d]["text"] == "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in cut) and got[d]["lines_removed"] == len(cut)


def test_dedup_with_the_first_gram_in_another_context(spark, make):
    """A long line among others, then twice with the same lines around it: the third is compared with the second, not only the first."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    texts, licence = [], line(30)
    for _ in range(12):
        run = [line(30), *(line(10) for _ in range(3))]
        texts += ["\n".join([line(10), line(15), run[0], line(15), line(10)]), "\n".join([line(12), *run, licence]), "\n".join([line(8), licence, *run, "", licence])]
    texts += ["\n".join([line(5), licence, line(5)]) for _ in range(5)] + ["\n".join([line(10)] * 9), "\n".join([line(60), line(10)])]
    texts.append(texts[-1])
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(make(list(enumerate(texts)))).collect()}
    for d, cut in enumerate(brute_dedup(texts)):
        assert got[d]["lines_removed"] == len(cut) and got[d]["text"] == "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in cut)
    assert all(got[3 * i + 2]["lines_removed"] >= 4 for i in range(12))


def test_dedup_odd_rows(spark, make):
    same = "\n".join(f"line {i} with some more words in it {i}" for i in range(20))
    docs = make([(1, None), (2, ""), (3, same), (3, same), (None, "x"), (9, same), (10, LONG)]).withColumn("cuts", F.lit(1)).withColumn("lines_removed", F.lit("mine"))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "cuts", "lines_removed"]
    assert rows_of(got, "doc_id", "lines_removed") == sorted([(1, 0), (2, 0), (3, 0), (3, 0), (None, 0), (9, 20), (10, 0)], key=repr)
    assert line_dedup.dedup_lines(make([])).count() == 0


# --- Jaccard join -------------------------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        both = Counter(j for x in s for j in holders[x])
        for x in s:
            holders[x].append(i)
        for j, n in both.items():
            if n * den >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, num, den", [(4, 17, 20), (5, 4, 5), (1, 1, 2)])
def test_components_equal_brute_force(spark, make, k, num, den):
    rng = random.Random(k)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 60))] for _ in range(15)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(make(rows), k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


def mixes(docs, seed, of=60, take=6):
    """Documents of `take` shared paragraphs in any order, and a near copy of every tenth."""
    rng = random.Random(seed)
    paragraphs = [" ".join(f"p{i}w{rng.randrange(10**6)}" for _ in range(50)) for i in range(of)]
    rows = []
    for i in range(docs):
        rows.append((2 * i, "\n".join(rng.sample(paragraphs, take))))
        if i % 10 == 0:
            rows.append((2 * i + 1, rows[-1][1] + " and more"))
    return rows


def test_shared_paragraphs_make_few_pairs(spark, make, monkeypatch):
    """Texts that share passages are no pairs: their number grows no faster than that of the documents."""
    made, whole = [], jaccard_join.pair_loose

    def counted(*args):
        pairs = jaccard_join.materialize(whole(*args), "counted")
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard_join, "pair_loose", counted)
    for n in (300, 1200):
        rows = mixes(n, 3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(make(rows), 4, 17, 20).collect()}
        assert got == brute_components(rows, 4, 17, 20)
    assert made[1] <= 8 * made[0] + 100, made
    print(made)


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, 600)).astype(np.uint64)) for _ in range(2))
        x = jaccard_join.parities(a) ^ jaccard_join.parities(b)
        assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in x) <= len(np.setxor1d(a, b)) and len(x) == jaccard_join.SKETCH_LONGS


@pytest.mark.parametrize("hot", [0, 1000])
def test_hot_tokens_lose_no_link(spark, make, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT_TOKEN", hot)
    rng = random.Random(hot)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):  # texts of all lengths from one run of words: sizes at the edge of the ratio
        a = rng.randrange(100)
        rows.append((i, " ".join(base[a : a + rng.randrange(4, 100)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(make(rows), 4, 17, 20).collect()}
    assert got == brute_components(rows, 4, 17, 20)


def near_copies(seed, words, copies, edits):
    """Copies of one text with single words replaced, deleted or put in, out of few, so that some edits meet again."""
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(words)], []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            at = rng.randrange(len(w) // 3) * 3
            w[at : at + rng.choice([0, 1, 1, 1])] = rng.choice([[], ["n1"], ["n1"], ["n2"], ["n1", "n2"]])
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("num, den, words, edits", [(17, 20, 90, (2, 6)), (4, 5, 60, (1, 6)), (1, 2, 25, (1, 8))])
def test_components_of_large_groups(spark, make, num, den, words, edits):
    """Copies just under the similarity, most of which link to few others, with a second text that shares half of the first."""
    rows = near_copies(num, words, 260, edits)
    half = " ".join(f"b{i}" for i in range(words // 2))
    rows += [(1000 + i, f"{half} {t.replace('b', 'c')}"[: 6 * words]) for i, t in near_copies(den, words // 2, 120, edits)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(make(rows), 4, num, den).collect()}
    assert got == brute_components(rows, 4, num, den)
    assert len({c for _, c in got.values()}) > 10


def test_difference_overlap_is_a_lower_bound():
    rng = random.Random(1)
    for _ in range(20_000):
        num, den = rng.choice([(17, 20), (4, 5), (1, 2)])
        hub = set(range(rng.randint(5, 40)))
        some = []
        for _ in range(2):
            x = {t for t in hub if rng.random() > 0.15} | {t + 100 for t in range(6) if rng.random() < 0.4}
            some.append(x or {0})
        (x, y), p, q = some, num + den, den - num
        s, t = sorted((x ^ hub, y ^ hub), key=len)
        if len(x ^ hub) != len(s):
            x, y = y, x
        links = lambda a, b: len(a ^ b) * p <= q * (len(a) + len(b))
        if links(x, y) and not (links(x, hub) and links(y, hub)):
            assert len(s & t) >= jaccard_join.difference_overlap(len(s), len(x), len(hub), num, den)[0]
            assert len(s & t) >= jaccard_join.difference_overlap(len(t), len(y), len(hub), num, den)[1]


def test_join_of_repeated_ids(spark, make):
    """Id 1 has two texts, 2 is near the one and 3 near the other: all are one component, but each text is judged by itself."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    docs = make([(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b[:-1])), (3, " ".join(a[:-1])), (4, "else " * 9)])
    assert rows_of(jaccard_join.components(docs), "doc_id", "component_id") == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert rows_of(jaccard_join.keep_one(docs), "doc_id", "text") == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, "else " * 9)], key=repr)


def test_join_odd_rows(spark, make):
    docs = make([(1, None), (2, ""), (3, LONG), (4, LONG), (4, LONG), (None, "x y"), (6, "X Y"), (7, " \t\n")]).withColumn("rep", F.lit(1)).withColumn("__id", F.lit(1))
    got = jaccard_join.components(docs)
    assert rows_of(got, "doc_id", "component_id") == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (4, 3), (6, 6), (7, 7), (None, None)], key=repr)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 2, 3, 6, 7, None]
    assert jaccard_join.components(make([])).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------


def edits(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark, make):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(8, 25))) for _ in range(6)]
    docs = []
    for i in range(40):
        item = list(rng.choice(items))
        for _ in range(rng.choice([0, 1, 3, 6, 12])):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = rng.choice("abcxyz")
        docs.append((i, " ".join(word() for _ in range(20)) + " " + "".join(item) + " " + " ".join(word() for _ in range(20))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(make(docs), bench).collect()}
    budget = decontamination.Index(list(enumerate(items))).edits
    want = {(d, i): e for d, t in docs for i, item in enumerate(items) if (e := edits(item, t)) <= budget[i]}
    assert {k: r["edits"] for k, r in got.items()} == want
    assert all(edits(items[i], docs[d][1][r["start"] : r["end"]]) == r["edits"] for (d, i), r in got.items())


def test_leaks_odd_rows(spark, make):
    docs = make([(1, None), (2, ""), (3, LONG + " the secret passage of the benchmark item " + LONG), (None, "The Secret passage\nof the benchmark ITEM"), (5, "short one here")]).withColumn("__id", F.lit(1))
    bench = spark.createDataFrame([(1, "the secret passage of the benchmark item"), (2, None), (3, ""), (4, "one"), (1, "the secret passage of the benchmark item")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()} == {(3, 1), (None, 1), (5, 4)}
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == 5 and decontamination.find_leaks(make([]), bench).count() == 0


def test_leaks_are_dropped_by_row(spark, make):
    """Clean rows stay whatever ids they share with rows that hold an item, null ones included."""
    item = "the secret passage of the benchmark item"
    docs = make([(1, "clean text"), (1, item), (None, "clean too"), (None, "x " + item), (2, None), (2, "")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert rows_of(decontamination.drop_contaminated(docs, bench), "doc_id", "text") == sorted([(1, "clean text"), (None, "clean too"), (2, None), (2, "")], key=repr)


def test_leaks_in_blocks(spark, make, monkeypatch):
    """One block of items after another gives the same rows as all at once."""
    rng = random.Random(3)
    items = ["".join(rng.choice("abcde ") for _ in range(60)) for _ in range(12)]
    docs = make([(i, "zz " + items[i] + " yy") for i in range(0, 12, 2)] + [(50, "nothing"), (51, items[1] + items[3])])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = rows_of(decontamination.find_leaks(docs, bench), "doc_id", "item_id", "start", "end", "edits")
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 200)
    assert rows_of(decontamination.find_leaks(docs, bench), "doc_id", "item_id", "start", "end", "edits") == whole and len(whole) == 8
    assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()] == [50] and docs.count() == 8


def test_repetitive_texts(monkeypatch):
    """A text of one sign against an item of it; and meetings in chunks and stretches give the bands of all meetings."""
    index = decontamination.Index([(1, "=" * 500), (2, "ab" * 300)])
    assert index.search("x" + "=" * 100_000) == [(1, 1, 501, 0)]
    rng = random.Random(3)
    for _ in range(60):
        text, item = ("".join(rng.choice("ab") for _ in range(rng.randint(a, b))) for a, b in ((50, 400), (20, 60)))
        if rng.random() < 0.7:
            text = text[:20] + item[:10] + "b" + item[11:] + text[20:]
        index = decontamination.Index([(1, item)], q=4, edit_rate=0.1)
        monkeypatch.setattr(decontamination, "HITS", 10**6)
        whole = index.search(text)
        monkeypatch.setattr(decontamination, "HITS", 5)
        assert index.search(text) == whole


# --- packing ------------------------------------------------------------------------------------------------


def check_packing(docs, pieces):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda p: p["start"])
        at = 0
        for p in parts:
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    return by_sequence


def test_packing_round_trip(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces = queries.QUERIES["op5_packing"](spark, sf).collect()
    sequences = check_packing(docs, pieces)
    tokens = sum(p["length"] for p in pieces)
    assert tokens / (2048 * len(sequences)) > 0.97


def test_packing_odd_rows(spark, make):
    docs = [(1, None), (2, ""), (3, LONG), (4, "Ünïcode  ẞ \x85 <|endoftext|> 你好 it's 12"), (6, "x " * 5000)]
    check_packing(docs, packing.pack(make(docs).withColumn("start", F.lit("mine")), queries.tokenizer_path("word_bpe_49k.json")).collect())
    assert packing.pack(make([(7, "a"), (7, "a"), (None, "b")]), queries.tokenizer_path("word_bpe_49k.json")).count() == 3
    assert packing.pack(make([]), queries.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_cutting_stock_covers_the_demand():
    rng = random.Random(2)
    for _ in range(20):
        demand = {rng.randint(1, 64): rng.randint(1, 300) for _ in range(rng.randint(1, 20))}
        patterns = packing.cutting_stock(demand, 64)
        made = Counter()
        for pattern, copies in patterns:
            assert sum(s * n for s, n in pattern.items()) <= 64
            for s, n in pattern.items():
                made[s] += n * copies
        assert made == demand
        bins = sum(c for _, c in patterns)  # rounding costs a bin a size at most
        assert bins <= 1.03 * least_bins(demand, 64) + len(demand)


def least_bins(demand, capacity):
    """A lower bound on the bins: the best of published dual feasible functions, alone and after leaving out small sizes."""
    def rounded(k):  # (k + 1) x rounded down, in k-ths; what is whole already keeps its size
        return sum(n * (s / capacity if s * (k + 1) % capacity == 0 else s * (k + 1) // capacity / k) for s, n in demand.items())

    def without(cut):  # sizes of more than capacity - cut count as whole bins, those below cut as nothing
        return sum(n * (1 if s > capacity - cut else s / capacity if s >= cut else 0) for s, n in demand.items())

    return max([rounded(k) for k in range(1, 64)] + [without(c) for c in range(capacity // 2 + 1)])


def test_cutting_stock_beats_first_fit():
    """44 with 20, and 22 with two of 21, fill 64: first-fit decreasing needs 217 bins, patterns 200."""
    demand = {44: 100, 20: 100, 22: 100, 21: 200}
    assert sum(c for _, c in packing.cutting_stock(demand, 64)) <= 100 + 100 + 2


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer, encode, rng = Tokenizer.from_file(path), packing.encoder(path), random.Random(5)
    for _ in range(4000):
        text = "".join(chr(rng.randint(1, 0x17F)) if rng.random() < 0.6 else rng.choice("abc 'sIİ你\u0301") for _ in range(rng.randint(0, 40)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


# --- token counts -------------------------------------------------------------------------------------------

ALPHABET = ["文", "，", "(", "-", "が", "가", "_", "a", "b ", "Ü", " ", "  ", "\n", "\t", "'", "s", "'re", "12", "!", "?.", "\xa0", "　", "中", "\x1c", "\x85", "word ", " \n", "ll", "😀"]


def encoder():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_edits_equal_full_encoding():
    path, pattern, encode = encoder()
    count, rng = token_counts.counter(path, pattern), random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 120)))
        leaf = rng.choice([4, 16, 64])
        tree = token_counts.plant(text, count, leaf)
        assert tree.tokens[1] == len(encode(text))
        for _ in range(6):
            a = rng.randint(0, len(text) + 2)
            new = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 30])))
            text, _ = token_counts.apply_edit(text, tree, a, a + rng.randint(-1, 9), new, count, leaf)
            assert tree.tokens[1] == len(encode(text)) and tree.chars[1] == len(text)


@pytest.mark.parametrize("unit", ["line of a list\n", "中文，字。", "a,b;c.", "tab\tapart\t"])
def test_texts_without_blanks_have_leaves(unit):
    path, pattern, encode = encoder()
    count, text = token_counts.counter(path, pattern), unit * 3000
    tree = token_counts.plant(text, count)
    assert tree.leaves > len(text) / token_counts.LEAF / 2 and tree.tokens[1] == len(encode(text))
    after, again = token_counts.apply_edit(text, tree, 7001, 7003, "new", count)
    assert again < 4 * token_counts.LEAF and tree.tokens[1] == len(encode(after))


def test_edits_touch_only_their_region():
    path, pattern, _ = encoder()
    count = token_counts.counter(path, pattern)
    tree = token_counts.plant(LONG, count)
    assert token_counts.apply_edit(LONG, tree, 70_000, 70_010, "new", count)[1] < 4 * token_counts.LEAF


def test_count_tokens_of_a_table(spark, make):
    path, pattern, encode = encoder()
    docs = make([(1, None), (2, ""), (3, LONG), (3, LONG), (None, "x y"), (5, "a b c")]).withColumn("edits", F.lit(1)).withColumn("n_tokens", F.lit(1))
    table = spark.createDataFrame([(1, 1, 0, 0, "new text"), (3, 2, 0, 5, None), (3, 1, None, None, "first "), (5, 1, 99, 3, "!"), (77, 1, 0, 0, "x")], "doc_id long, seq int, start long, `end` long, replacement string").withColumn("text", F.lit(1))
    got = token_counts.count_tokens(docs, table, path, pattern)
    edited = ("first " + LONG)[5:]
    want = [(1, 0, len(encode("new text"))), (2, 0, 0), (None, 2, 2), (5, 3, len(encode("a b c!")))] + [(3, len(encode(LONG)), len(encode(edited)))] * 2
    assert rows_of(got, "doc_id", "n_tokens", "n_tokens_after") == sorted(want, key=repr)
    assert token_counts.count_tokens(make([]), table, path, pattern).count() == 0


def test_trees_are_kept_between_calls(spark, make, tmp_path):
    """A second call encodes only what its edits touch, from the leaves and texts that the first one has given."""
    path, pattern, encode = encoder()
    rng = random.Random(7)
    texts = [None, "", "a b", LONG, *(" ".join(rng.choice(["word", "Wörter,", "x1", "(new)", "don't", "\n", "日本"]) for _ in range(rng.randrange(900))) for _ in range(30))]
    rows = [*enumerate(texts), (3, LONG), (None, "no id here " * 30)]
    docs = make(rows).withColumn("leaves", F.lit("mine"))
    edit = lambda: spark.createDataFrame(
        [(i, s, a, a + rng.randrange(30), rng.choice(["", "new words ", "x"])) for i, t in enumerate(texts) for s, a in enumerate(rng.sample(range(max(len(t or ""), 2)), 2))],
        "doc_id long, seq int, start long, `end` long, replacement string")
    trees = token_counts.plant_trees(docs, path, pattern)
    trees.write.parquet(f"{tmp_path}/t0")
    for call in range(3):
        trees = spark.read.parquet(f"{tmp_path}/t{call}")
        edited = token_counts.edit_documents(docs, edit(), path, pattern, trees if call != 2 else trees.where("doc_id % 2 = 0"))
        edited.write.parquet(f"{tmp_path}/e{call}")
        edited = spark.read.parquet(f"{tmp_path}/e{call}")
        before = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
        rows = sorted(edited.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
        for (_, _, old), r in zip(before, rows):
            assert r["n_tokens"] == len(encode(old)) and r["n_tokens_after"] == len(encode(r["text"] or "")) == sum(r["tokens"]) and sum(r["chars"]) == len(r["text"] or "")
            assert r["n_planted"] == (len(old) if call == 2 and (r["doc_id"] is None or r["doc_id"] % 2) else 0)
        assert sum(r["n_reencoded"] for r in rows if r["doc_id"] == 3) < 2 * 2 * 4 * token_counts.LEAF
        assert edited.where(~F.xxhash64("text").eqNullSafe(F.col("text_hash"))).count() == 0
        token_counts.trees_of(edited).write.parquet(f"{tmp_path}/t{call + 1}")
        docs = edited.select("doc_id", "text")
