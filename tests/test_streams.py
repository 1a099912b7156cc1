"""Keyed state, the ingest loop and the cache of extractions."""

import datetime
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import cache
from lodestone.streaming import ingest, state
from lodestone.streaming import usage as S

TURNS = "talk_id long, turn_index long, role string"


def streamed(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(path))


@pytest.mark.parametrize("files", [1, 5])
def test_history_is_the_same_at_any_split(spark, tmp_path, files):
    rows = [(t, i, "user" if i % 2 == 0 else "assistant") for t in (1, 2, 3) for i in range({1: 30, 2: 3, 3: 8}[t])]
    spark.createDataFrame(rows, TURNS).orderBy(F.xxhash64("talk_id", "turn_index")).repartition(files).write.parquet(str(tmp_path / "t"))
    got = state.history(S.run_available(state.latest(streamed(spark, tmp_path / "t", TURNS), "talk_id", ["turn_index"], ["role"], 8), "turns"), "talk_id")
    want = [(t, n, i, r) for t, i, r in rows for n in [sum(x[0] == t for x in rows)] if i >= n - 8]
    assert sorted(map(tuple, got.select("talk_id", "seen", "turn_index", "role").collect())) == sorted(want)


def at(minute):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minute)


PROMPTS = "prompt_id string, id long, ts timestamp, value string"


@pytest.mark.parametrize("files", [1, 4])
def test_prompts_expire_by_their_own_time(spark, tmp_path, files):
    rows = [("p", 1, at(0), "a"), ("p", 2, at(29), None), ("p", 3, at(30), None), ("p", 4, at(31), "b"), ("p", 5, at(31), None), ("p", 6, at(40), "c"), ("p", 7, at(60), None),
            ("p", 8, at(70), None), ("q", 9, at(5), None), ("p", 10, at(6), "aa"), ("p", 11, at(35), None), ("p", 12, at(40), "d")]
    spark.createDataFrame(rows, PROMPTS).repartition(files).write.parquet(str(tmp_path / "p"))
    time.sleep(1)  # files come in the order of their times; this one moves the watermark on
    spark.createDataFrame([("z", 99, at(10_000), None)], PROMPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    got = S.run_available(state.prompt_states(streamed(spark, tmp_path / "p", PROMPTS), late="2 days"), "prompts")
    assert {r["id"]: r["value"] for r in got.collect()} == {2: "aa", 3: "aa", 5: "b", 7: "d", 8: None, 9: None, 11: "b"}


def test_prompts_expire_by_the_clock(spark, tmp_path):
    path, schema = tmp_path / "c", T._parse_datatype_string(PROMPTS)
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(path))
    put(("p", 1, at(0), "a"), ("p", 2, at(0), None))
    q = state.prompt_states(streamed(spark, path, schema), ttl="6 seconds", late=None).writeStream.format("memory").queryName("clocked").option(
        "checkpointLocation", str(tmp_path / "state")).start()

    def answered(ids):  # this stream always has a further batch to come
        for _ in range(120):
            if q.exception():
                raise q.exception()
            found = {r["id"]: r["value"] for r in spark.table("clocked").collect()}
            if ids <= set(found):
                return found
            time.sleep(0.5)
        raise AssertionError(found)

    try:
        assert answered({2}) == {2: "a"}
        time.sleep(7)
        put(("p", 3, at(0), None))
        assert answered({2, 3}) == {2: "a", 3: None}
        put(("p", 4, at(0), "b"), ("p", 5, at(0), None))
        assert answered({2, 3, 5}) == {2: "a", 3: None, 5: "b"}
    finally:
        q.stop()


def test_recent_values_of_a_user(spark, tmp_path):
    rows = [(1, i, at(i), float(i)) for i in range(20)] + [(2, 50, at(0), 7.9)]
    kind = "user_id long, event_id long, ts timestamp, value double"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(str(tmp_path / "e"))
    got = S.run_available(S.recent_values(streamed(spark, tmp_path / "e", kind)), "recent")
    last = state.history(got.withColumnRenamed("n", "seen"), "user_id").groupBy("user_id").agg(F.max("seen"), F.sum("value")).collect()
    assert sorted(map(tuple, last)) == [(1, 20, sum(range(12, 20))), (2, 1, 7)]


CHUNKS = "rag_partition string, chunk_id string, text string, content_hash string, updated_at timestamp"


def test_ingest_loop_bears_repetition(spark, tmp_path):
    now, later = F.lit(at(100)), "embedded_at timestamp, deprecated_at timestamp"
    base = spark.createDataFrame([("m", f"c{i}", f"text {i}", f"h{i}", at(i), at(i) if i % 2 else None, None) for i in range(10)], f"{CHUNKS}, {later}")
    batches = [spark.createDataFrame([("m", f"c{i}", f"new {i}", f"n{i}", at(50 + i)) for i in ids], CHUNKS) for ids in ([1, 3, 20], [2, 3, 21])]
    table = ingest.VersionedChunks(spark, str(tmp_path / "v"), base)
    calls = spark.sparkContext.accumulator(0)

    def counted():
        from lodestone.functions.models import hashed_embedding

        embed = hashed_embedding()

        def run(texts):
            calls.add(len(texts))
            return embed(texts)

        return run

    run = ingest.step(table, now, 4, counted)
    run(batches[0], 0)
    first = sorted(map(tuple, table.current().select("chunk_id", "content_hash", "embedded_at").collect()))
    assert calls.value == 5 + 3 and len(first) == 11 and all(e is not None for *_, e in first)  # those without a vector, and the batch
    run(batches[0], 0)
    assert sorted(map(tuple, table.current().select("chunk_id", "content_hash", "embedded_at").collect())) == first
    run(batches[1], 1)
    run(batches[1], 1)
    rows = {r["chunk_id"]: r for r in table.current().collect()}
    assert len(rows) == 12 and rows["c3"]["content_hash"] == "n3" and rows["c1"]["content_hash"] == "n1" and rows["c5"]["embedding"] is None and rows["c5"]["embedded_at"] is not None
    assert all(rows[c]["embedding"] is not None for c in ("c0", "c1", "c2", "c3", "c20", "c21"))
    packed = table.compact(ingest.STEPS * 2, str(tmp_path / "packed"))
    assert sorted(map(str, packed.current().collect())) == sorted(map(str, table.current().collect()))


def test_rounds_of_embedding_do_not_read_the_table_anew(spark, tmp_path, monkeypatch):
    base = spark.createDataFrame([("m", f"c{i:02}", f"text {i}", f"h{i}", at(i), None, None) for i in range(30)], f"{CHUNKS}, embedded_at timestamp, deprecated_at timestamp")
    table, reads, sizes = ingest.VersionedChunks(spark, str(tmp_path / "v"), base), [], []
    rows, embed = ingest.VersionedChunks.rows, ingest.embed
    monkeypatch.setattr(ingest.VersionedChunks, "rows", lambda self, before=None: reads.append(before) or rows(self, before))
    monkeypatch.setattr(ingest, "embed", lambda df, **o: sizes.append(sorted(r["chunk_id"] for r in df.collect())) or embed(df, **o))
    assert ingest.embed_waiting(table, 1, F.lit(at(100)), 4) == 8 and len(reads) == 2
    assert sizes == [[f"c{i:02}" for i in range(lo, min(lo + 4, 30))] for lo in range(0, 30, 4)]
    assert table.current().where("embedding is not null and embedded_at is not null").count() == 30


def test_cache_calls_only_for_what_is_new(spark, tmp_path):
    calls, place = spark.sparkContext.accumulator(0), str(tmp_path / "cache")
    schema = T.StructType([T.StructField("n", T.LongType())])
    rows = spark.createDataFrame([("a", "one"), ("b", "two words"), ("c", None), ("a", "one"), ("d", "")], "path string, text string")
    key = lambda **config: cache.cache_key(F.col("path"), F.col("text"), config)
    run = lambda df, **config: sorted(tuple(r) for r in cache.cached(df, key(**config), place, lambda: lambda t: {"n": len(t.split())}, schema, calls=calls).select("path", "n", "from_cache").collect())
    assert run(rows, v=1) == sorted([("a", 1, False), ("a", 1, False), ("b", 2, False), ("c", 0, False), ("d", 0, False)]) and calls.value == 4
    assert {x[2] for x in run(rows, v=1)} == {True} and calls.value == 4
    more = rows.unionByName(spark.createDataFrame([("a", "one more")], rows.schema))
    assert run(more, v=1).count(("a", 2, False)) == 1 and calls.value == 5
    run(rows, v=2)
    assert calls.value == 9
