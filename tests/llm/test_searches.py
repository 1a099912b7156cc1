"""Hard negatives, ranked search and substring dedup against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives, impact_index, substring_dedup

from .conftest import rows_of

# --- hard negatives -----------------------------------------------------------------------------------------


def brute_negatives(rows, is_anchor):
    good = [(i, x, [math.floor(256 * c) for c in v]) for i, x, v in rows
            if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    good = [r for r in good if sum(c * c for c in r[2]) < 2**63]
    out = []
    for a, label, v in good:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in good if i != a and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            window = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pid, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(window)]
    return sorted(out)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("floats", [2_000_000, 40])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, floats):
    monkeypatch.setattr(hard_negatives, "BLOCK_FLOATS", floats)
    rng = random.Random(3)
    base = [[rng.uniform(-0.6, 0.6) for _ in range(8)] for _ in range(4)]
    rows = [(i, rng.randrange(3), [c + rng.choice([0, 0, 0.01, 0.3]) for c in rng.choice(base)]) for i in rng.sample(range(2000), 400)]
    rows += [(2000 + i, i % 3, [0.5] * 8) for i in range(60)]  # ties
    rows += [(3000, 1, None), (3010, None, [0.1] * 8), (3020, 1, [0.1] * 7 + [None]), (3030, 1, [0.1] * 7 + [float("nan")]), (3040, 1, [float("inf")] * 8),
             (None, 1, [0.1] * 8), (3050, 1, [0.1] * 3), (3051, 1, [0.2] * 3), (3052, 2, [0.18] * 3), (3060, 0, []), (3061, 0, []), (3062, 1, []), (3070, 1, [1e36] * 8),
             (3080, 1, [2e5] * 8), (3081, 1, [2e5] * 8), (3082, 2, [1.9e5] * 8), (-20, 1, [0.3] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert rows_of(got, *NEGATIVES) == sorted(want, key=repr) and len(want) > 400
    assert {3050, 3060, 3080} <= {w[0] for w in want}


def test_hard_negatives_odd_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.mine(spark.createDataFrame([], kind), F.col("vec_id") % 10 == 0).count() == 0
    only = spark.createDataFrame([(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (10, 2, None)], kind)
    assert hard_negatives.mine(only, F.col("vec_id") % 10 == 0).count() == 0
    twice = spark.createDataFrame([(0, 1, [0.5]), (0, 1, [0.5]), (3, 1, [0.5]), (4, 2, [0.5]), (4, 2, [0.5])], kind)
    got = rows_of(hard_negatives.mine(twice, F.col("vec_id") == 0), *NEGATIVES)
    assert got == sorted([(0, 3, r, 4, 16384, 16384) for r in (1, 1, 2, 2)])


# --- ranked search ------------------------------------------------------------------------------------------


def brute_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, split(t)) for i, t in docs]
    found = [(i, t, collections.Counter(t)) for i, t in found if t]
    total, length = len(found), sum(len(t) for _, t, _ in found)
    df = collections.Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in items:
        terms, scores = split(text), []
        for i, t, c in found:
            m = 100 - 75 + (75 * len(t) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms if c[x])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,chars", [(64, 2_000_000), (16_384, 2_000_000), (128, 300)])
def test_ranked_search_equals_brute_force(spark, make, monkeypatch, size, chars):
    monkeypatch.setattr(impact_index, "BLOCK_CHARS", chars)
    rng = random.Random(8)
    words = ["the", "The", "of", "naïve", "ÉTÉ", "été", "x9", "Z_z", "deep-sea", "日本", "\x00nul", "a\x7fb", "ı", "K"] + [f"w{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.choice([1, 3, 8, 30, 200]))) for i in range(500)]
    docs += [(600, None), (601, ""), (602, " .,;"), (None, "the w1 w1 w2"), (700, "the " * 5000), *[(800 + i, "w1 w2 w3") for i in range(40)], (3, "of w7")]
    items = [(i, text(rng.choice([1, 4, 12]))) for i in range(20)] + [(50, None), (51, ""), (52, "?!"), (53, "absent"), (54, "w1 w1 w1 w2"), (None, "w3"), (55, "w5"), (55, "w5"), (55, "w6")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("mine"))
    got = impact_index.rank(make(docs).repartition(4).withColumn("terms", F.lit(0)), table, 10, size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, list(dict.fromkeys(items)), 10)


def test_ranked_search_odd_tables(spark, make):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert impact_index.rank(make([]), items).count() == 0
    assert impact_index.rank(make([(1, "a")]), items.limit(0)).count() == 0
    assert impact_index.rank(make([(1, None), (2, "")]), items).count() == 0
    assert rows_of(impact_index.rank(make([(1, "a"), (2, "c c")]), items), "doc_id") == [(1,)]


def test_slices_add_up_and_order():
    rng = np.random.default_rng(5)
    docs, terms = 300, 6
    impacts = rng.integers(0, 1 << 30, (terms, docs)) * (rng.random((terms, docs)) < 0.4)
    places = [np.flatnonzero(x) for x in impacts]
    packed = [impact_index.slices(x[p]) for x, p in zip(impacts, places)]
    row = {"ids": list(range(docs)), "terms": list(range(terms)), "sizes": [len(p) for p in places], "bits": [len(p) for p in packed],
           "places": np.concatenate(places).astype(np.uint16).tobytes(), "slices": b"".join(p.tobytes() for p in packed)}
    block = impact_index.Block(row)
    for asked in ([0], [1, 1, 1, 2], list(range(terms)), [99], []):
        want = sum((impacts[t] for t in asked if t < terms), np.zeros(docs, np.int64))
        order = sorted((-s, i) for i, s in enumerate(want.tolist()) if s)[:10]
        assert sorted((-s, i) for i, s in block.best(asked, 10)) == order


# --- substring dedup ----------------------------------------------------------------------------------------


def brute_substrings(rows, window):
    """(doc_id, words, removed, kept words) of each row."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    for i, w in enumerate(words):
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < order(i):
                gone |= set(range(at, at + window))
        out.append((rows[i][0], len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def planted(rng, window, n=120):
    word = lambda: rng.choice(["a", "b", "the", "é", "K", f"u{rng.randrange(10**6)}", f"u{rng.randrange(10**6)}"])
    run = lambda k: [word() for _ in range(k)]
    passages = [run(window + d) for d in (-1, 0, 1, 7, 3 * window)]
    texts = []
    for _ in range(n):
        parts = [rng.choice([run(rng.randint(0, window)), rng.choice(passages), run(3)]) for _ in range(rng.randint(0, 5))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t  "]) for p in parts for w in p))
        if texts and rng.random() < 0.15:  # near copy, exact copy, copy with other white space
            w = rng.choice(texts).split()
            if w:
                w[rng.randrange(len(w))] = word()
            texts.append(rng.choice([rng.choice(texts), " ".join(w), " " + rng.choice(texts).replace(" ", "\x0b")]))
    return texts


@pytest.mark.parametrize("window,cells,copies", [(50, 1 << 28, 500_000), (50, 1 << 15, 0), (6, 1 << 28, 500_000), (1, 1 << 28, 0), (3, 1 << 15, 500_000)])
def test_substrings_equal_brute_force(spark, make, monkeypatch, window, cells, copies):
    monkeypatch.setattr(substring_dedup, "MAX_CELLS", cells)
    monkeypatch.setattr(substring_dedup, "BROADCAST_COPIES", copies)
    rng = random.Random(window)
    texts = planted(rng, window)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, rows[5][1]), (None, rows[6][1] + " more"), rows[7], (rows[8][0], rows[9][1]), (3000, rows[10][1])]
    got = substring_dedup.digest(substring_dedup.dedup_substrings(make(rows).repartition(7), window))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, window)


def test_substrings_with_a_full_sketch(spark, make, monkeypatch):
    """Few cells are all touched more than once: the estimate is never too low."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 8)
    texts = make(list(enumerate(planted(random.Random(2), 50)))).where("text is not null").select(F.col("text").cast("binary").alias("text"))
    assert all(p.tolist() == [255] for p in substring_dedup.sketch(texts, 50, 3))


def test_substrings_keep_the_text_around(spark, make):
    rng = random.Random(1)
    p = [f"p{rng.randrange(10**9)}" for _ in range(60)]
    rows = [(1, "A b\n" + " ".join(p)), (2, "Head,\n\n two " + "\n".join(p) + "  tail\n end "), (3, " ".join(p)), (4, " ".join(p[:49]))]
    docs = make(rows).withColumn("n_words", F.lit("mine")).withColumn("tag", F.lit(1)).withColumn("starts", F.lit(2))
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == [rows[0][1], "Head,\n\n two tail\n end ", "", rows[3][1]]
    assert [(got[i]["n_words"], got[i]["words_removed"]) for i in (1, 2, 3, 4)] == [(62, 0), (64, 60), (60, 60), (49, 0)]
    assert got[1].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "tag", "starts", "n_words", "words_removed"}
    assert substring_dedup.dedup_substrings(make([])).count() == 0


def test_substrings_of_very_long_texts(spark, make):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**5)}" for _ in range(60_000)]
    rows = [(5, " ".join(long)), (4, " ".join(long[20_000:20_200])), (6, " ".join(long[50:])), (7, "x " * 30_000)]
    got = substring_dedup.digest(substring_dedup.dedup_substrings(make(rows)))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, 50)
