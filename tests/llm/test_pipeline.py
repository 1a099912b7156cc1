"""The pipeline against its stages in plain Python, stage by stage on what the one before has kept, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontamination, quality_rules
from tests.compare import database, sql_rows
from tests.llm.test_documents import brute_components, check_packing


def brute_lines(texts):
    """Texts in order without the lines of later runs of 50 words or more: every pair of equal lines is followed."""
    places, out = {}, []
    for d, text in enumerate(texts):
        lines, cut = text.split("\n"), set()
        for i, x in enumerate(lines):
            for e, theirs, j in places.get(x, []) + [(d, lines, j) for j in range(i) if lines[j] == x]:
                n, words = 0, 0
                while i + n < len(lines) and j + n < len(theirs) and lines[i + n] == theirs[j + n]:
                    words += len(lines[i + n].encode().split())
                    n += 1
                back = 1
                while i >= back and j >= back and lines[i - back] == theirs[j - back]:
                    words += len(lines[i - back].encode().split())
                    back += 1
                if words >= 50:
                    cut |= set(range(i, i + n))
        for j, x in enumerate(lines):
            places.setdefault(x, []).append((d, lines, j))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in cut))
    return out


def least_edits(item, text):
    """Edits of the best match of a whole item in a text: one row of the table for each character of the item."""
    a, b = (np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in (item, text))
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        low = np.minimum(np.append(row[0], row[:-1] + (b != x)) + np.append(1, np.zeros(len(b), np.int64)), row + 1)
        row = np.minimum.accumulate(low - steps) + steps
    return int(row.min())


def brute_leaks(texts, items):
    index = decontamination.Index(items)
    budget = {i: int(e) for (i, _), e in zip(index.items, index.edits)}
    grams = {i: {t[k : k + 12] for k in range(len(t) - 11)} for i, t in index.items}
    holders = {}
    for i, g in grams.items():
        for x in g:
            holders.setdefault(x, set()).add(i)
    bad = set()
    for d, text in texts.items():
        low = decontamination.normal(text)
        near = set().union(*[holders.get(low[k : k + 12], set()) for k in range(len(low) - 11)]) if len(low) > 11 else set()
        if any(t in low for _, t in index.short) or any(least_edits(dict(index.items)[i], low) <= budget[i] for i in near):
            bad.add(d)
    return bad


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns and docs.schema == before.schema
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    names, rows = sql_rows(database(sf), f"select doc_id from ({quality_rules.ORACLE}) where kept")
    before, after = map(texts, seen["quality rules"])
    assert sorted(map(str, after)) == sorted(rows) and all(before[i] == t for i, t in after.items())

    before, after = map(texts, seen["line dedup"])
    ids = sorted(before)
    assert after == dict(zip(ids, brute_lines([before[i] for i in ids])))
    for r in seen["line dedup"][1].collect():
        assert r["n_chars"] == len(r["text"])

    before, after = map(texts, seen["n-gram Jaccard join"])
    groups = brute_components(list(before.items()), 5, 4, 5)
    assert after == {i: before[i] for i, (_, c) in groups.items() if i == c}

    before, after = map(texts, seen["benchmark decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = brute_leaks(before, items)
    assert bad and after == {i: t for i, t in before.items() if i not in bad}

    check_packing(list(after.items()), seen["packing"][1].collect())


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


CLASHES = ["rep", "m_", "clean", "lines_removed", "lines_removed_", "kept", "__id", "__hash", "__text", "__row", "__lang", "cuts", "hub"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, sf, make, name, stage):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    plain = " ".join(f"p{i}x{i % 7}" for i in range(80))
    other = " ".join(f"q{i}y{i % 5}" for i in range(80))
    rows = [(1, None), (2, ""), (3, long), (None, plain), (4, plain), (4, plain), (4, other), (None, None), (5, " \n\t "), (None, plain)]
    docs = make(rows)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    got = stage(spark, docs, sf)
    if name == "packing":
        assert got.where("start = 0").count() == len(rows) and got.where("doc_id is null").count() == 3 and got.where("doc_id = 3").count() > 10
    else:
        assert got.columns == docs.columns
        kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
        assert all(r[c] == f"mine {c}" for r in got.collect() for c in CLASHES)
        want = {
            "quality rules": [(i, t) for i, t in rows if t in (plain, other, long) and t != long],
            "line dedup": [(i, "" if t == plain and i == 4 else t) for i, t in rows],
            "n-gram Jaccard join": [(1, None), (2, ""), (3, long), (None, plain), (4, plain), (4, other), (None, None), (5, " \n\t "), (None, plain)],
            "benchmark decontamination": rows,
        }[name]
        assert kept == sorted(want, key=repr)
    assert stage(spark, docs.limit(0), sf).count() == 0
