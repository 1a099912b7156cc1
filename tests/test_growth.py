"""Steps whose cost must not grow faster than their input."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import registry
from lodestone.operators import joins, ranking
from lodestone.plans import dense, requests, sparse
from lodestone.sources import files, markdown
from lodestone.streaming import state


def test_terms_that_no_prompt_can_keep_are_not_joined(spark):
    """F5"""
    rows = [(f"c{i:03}", f"s{i % 9}", t) for i, t in enumerate(["colours", "form and", "formed by"] * 60)]
    terms = spark.createDataFrame(rows, "chunk_id string, segment_id string, term string")
    prompts = spark.createDataFrame([(1, "Colours are formed by all"), (2, "a form and colours"), (3, "nothing")], "query_id long, prompt string")
    kept = joins.capped_terms(terms, 5)
    assert kept.count() == 3 * 3 and joins.capped_terms(terms, 2).count() == 3 * 2
    best = lambda t, n: sorted(map(tuple, ranking.one_per_segment(joins.term_hits(prompts, t), n, "query_id").select("query_id", "segment_id", "chunk_id", "term").collect()))
    for n in (1, 2, 4, 5):
        assert best(joins.capped_terms(terms, n), n) == best(terms, n) != []


class Store:
    """A list and a value as a state gives them, and how often it is called."""

    def __init__(self):
        self.rows, self.value, self.calls, self.timers = [], None, 0, set()

    def _(self, new=None):
        self.calls += 1
        if new is not None:
            self.rows = new

    def appendList(self, part):
        self._(self.rows + list(part))

    def clear(self):
        self._([])

    def get(self):
        self._()
        return iter(self.rows) if self.value is None and self.rows else self.value if self.value is not None else None

    def update(self, value):
        self._()
        self.value = value

    def registerTimer(self, at):
        self._()
        self.timers.add(at)

    getListState = getValueState = lambda self, *_: self


def test_prompts_of_a_key_take_few_calls(spark):
    """F6"""
    store, p = Store(), state._PromptsByEventTime("k", 100)
    p.init(store)
    rows = [{"at": at, "id": at, "value": f"v{at}" if at % 50 == 0 else None} for at in range(1000)]
    assert list(p.handleInputRows(("a",), iter(rows[::-1]), None)) == [] and store.calls <= 3
    first = list(p.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 700), None))
    assert {r[1]: r[2] for r in first} == {at: f"v{at // 50 * 50}" for at in range(701) if at % 50} and store.calls <= 7
    assert {r[0] for r in store.rows if r[2]} == set(range(650, 1000, 50)) and 701 in store.timers  # what a read after 700 may find
    second = list(p.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5000), None))
    assert {r[1]: r[2] for r in second} == {at: f"v{at // 50 * 50}" for at in range(701, 1000) if at % 50} and store.rows == []


def test_a_history_takes_two_calls(spark):
    """F11"""
    store, p = Store(), state._Latest("k", T._parse_datatype_string("i long, role string"), ["i"], 3)
    p.init(store)
    assert [r[1:] for r in p.handleInputRows(("a",), iter([{"i": i, "role": "x"} for i in (4, 1, 2, 3)]), None)] == [(4, 2, "x"), (4, 3, "x"), (4, 4, "x")]
    assert [r[1:] for r in p.handleInputRows(("a",), iter([{"i": 9, "role": "y"}]), None)] == [(5, 3, "x"), (5, 4, "x"), (5, 9, "y")] and store.calls == 4


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_text_are_dealt_out_once(spark, sf):
    """F7"""
    assert plan(registry.QUERIES["quantified_words"](spark, sf)).count("Exchange hashpartitioning") == 1
    texts = ["{'word_stats': {'a': 2, 'b': 'x'}}", None, "{'word_stats': [{'word': 'c', 'count': 3}, 4]}", "(", "[]", "{'word_stats': {}}"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(files.quantify("t").alias("s")).collect()
    assert [[tuple(x) for x in r["s"]] for r in got] == [[("a", 2)], [], [("c", 3)], [], [], []]


def test_python_takes_small_batches(spark, sf):
    """F8"""
    import __spark_entry__ as entry

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    entry.queries()["chunk_texts"](spark, sf)
    sizes = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    assert spark.range(0, 5000, 1, 1).select(sizes("id").alias("n")).agg(F.max("n")).first()[0] <= 1000


def test_patterns_are_tried_once_a_line(spark):
    """F9"""
    text = "intro\r\n \n# T\n## A \nx\n y\n\n###\tB\nz\n#### no\n##\n##  \n   \n## C\nlast"
    df = spark.createDataFrame([(text,)], "text string").select(markdown.document_blocks(F.col("text")).alias("b"))
    shown = plan(df)
    assert shown.count("regexp_replace") + shown.count("RLIKE") + shown.count("regexp_extract") < 12
    assert [(x["chapter"], x["heading"], x["sub"], x["number"], x["text"]) for x in df.first()["b"]] == [
        (0, "", "", 1, "intro"), (1, "## A", "", 1, "x\n y"), (1, "## A", "###\tB", 2, "z\n#### no\n##\n##"), (2, "## C", "", 1, "last")]


def test_hits_that_a_task_gathers_are_bounded(spark, monkeypatch):
    """F10"""
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03}", rng.normal(size=4).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(i, rows[i][1]) for i in range(40)], "query_id long, embedding array<double>")
    ranked = lambda: sorted(map(tuple, dense.top_k(v, q, 7).collect()))
    want, blocks, scored = ranked(), [], dense._scored
    monkeypatch.setattr(dense, "HELD_ROWS", 300)
    monkeypatch.setattr(dense, "_scored", lambda vectors, block, *a: blocks.append(len(block)) or scored(vectors, block, *a))
    assert ranked() == want and sum(blocks) == 40 and len(blocks) > 2


def test_intents_read_the_texts_once(spark, sf, monkeypatch):
    """F12"""
    calls, split = [], sparse.split
    for module in (sparse, requests):
        monkeypatch.setattr(module, "split", lambda *a: calls.append(1) or split(*a))
    registry.QUERIES["retrieval_by_intent"](spark, sf)
    assert len(calls) == 1
