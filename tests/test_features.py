"""Guarded deletes, invitations in order, the cascade, tools, the embedding service and figures of runs."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models as M
from lodestone.operators import merge, talks, telemetry, tools
from lodestone.plans import cascade
from lodestone.sources import scratch

# --- guarded delete -----------------------------------------------------------------------------------------

POINT = "chunk_id string, source_id string, chunk_type string"


def ids(df):
    return sorted(r["chunk_id"] for r in df.collect())


def test_guarded_delete(spark):
    rows = [(f"c{i}", f"s{i % 3}", "book" if i % 2 else "talk") for i in range(12)]
    points, mirror = spark.createDataFrame(rows, POINT), spark.createDataFrame(rows[:9], POINT)
    books = F.col("chunk_type") == "book"
    done = merge.delete_guarded(mirror, points, books, limit=4)
    assert (done.matched, done.deleted) == (4, 4) and ids(done.mirror) == ["c0", "c2", "c4", "c6", "c8"] and "c9" in ids(done.points) and "c1" not in ids(done.points)
    with pytest.raises(ValueError, match="4 chunks match, 3 are allowed"):
        merge.delete_guarded(mirror, points, books, limit=3)
    dry = merge.delete_guarded(mirror, points, books, limit=4, dry_run=True)
    assert (dry.matched, dry.deleted) == (4, 0) and len(ids(dry.points)) == 12
    both = merge.delete_guarded(mirror, points, books, prefix="s1")
    assert both.matched == 2 and "c1" not in ids(both.points) and "c3" in ids(both.points)
    empty = mirror.limit(0)
    assert merge.delete_guarded(empty, points, books).deleted == 6
    assert merge.delete_guarded(empty, points, prefix="s1").matched == 0  # only the mirror knows prefixes
    assert merge.delete_guarded(empty, points, everything=True, limit=12).deleted == 12
    for bad in (dict(), dict(everything=True, prefix="s"), dict(everything=True), dict(everything=True, limit=11)):
        with pytest.raises(ValueError):
            merge.delete_guarded(empty, points, **bad)


# --- invitations --------------------------------------------------------------------------------------------

INVITATION = "id long, inviter string, email string, code string, status string, created_at timestamp"


def in_turn(stored, new, now, per_day):
    held, verdicts = list(stored), []
    for pos, inviter, email, code in new:
        email = email.strip().lower()
        pending = [h for h in held if h[2] == email and h[4] == "pending"]
        recent = [h for h in held if h[1] == inviter and now - datetime.timedelta(hours=24) <= h[5] <= now]
        verdicts.append((pos, bool(pending) or len(recent) < per_day))
        if verdicts[-1][1]:
            held = [h for h in held if h not in pending] + [(None, inviter, email, code, "pending", now)]
    return sorted(map(repr, held)), verdicts


@pytest.mark.parametrize("seed", [1, 2])
def test_invitations_of_a_batch_are_taken_in_turn(spark, seed):
    rng, now = random.Random(seed), datetime.datetime(2024, 1, 3)
    stored = [(i, f"u{rng.randrange(3)}", f"e{rng.randrange(20)}", f"c{i}", rng.choice(["pending", "pending", "redeemed"]), now - datetime.timedelta(hours=rng.randrange(48))) for i in range(15)]
    new = [(p, f"u{rng.randrange(3)}", f" E{rng.randrange(30)}", f"n{p}") for p in range(60)]
    frame = spark.createDataFrame(stored, INVITATION)
    after, judged = talks.create_invitations(frame, spark.createDataFrame(new, "pos long, inviter string, email string, code string"), F.lit(now), per_day=5)
    want, verdicts = in_turn(stored, new, now, 5)
    assert sorted((r["pos"], r["accepted"]) for r in judged.collect()) == verdicts
    assert sorted(repr(tuple(r)) for r in after.select(*frame.columns).collect()) == want
    assert {a for _, a in verdicts} == {True, False}


@pytest.mark.parametrize("at_once", [0, talks.AT_ONCE])
def test_invitations_need_few_rounds(spark, monkeypatch, at_once):
    """Inviters that hover at their limit: verdicts hang on one another in a long chain, rounds do not follow it row by row."""
    rng, now, rounds = random.Random(7), datetime.datetime(2024, 1, 3), []
    new = [(p, f"u{rng.randrange(4)}", f"e{p * 7 % 40}", f"n{p}") for p in range(600)]
    written = scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: rounds.append(name) or written(df, name))
    frame = spark.createDataFrame([], INVITATION)
    after, judged = talks.create_invitations(frame, spark.createDataFrame(new, "pos long, inviter string, email string, code string"), F.lit(now), per_day=5, at_once=at_once)
    want, verdicts = in_turn([], new, now, 5)
    assert sorted((r["pos"], r["accepted"]) for r in judged.collect()) == verdicts
    assert sorted(repr(tuple(r)) for r in after.select(*frame.columns).collect()) == want
    assert at_once == 0 or len(rounds) <= 4


def test_codes_are_redeemed_once(spark):
    now = datetime.datetime(2024, 1, 3)
    stored = [(1, "u", "a", "x", "pending", now), (2, "u", "b", "y", "pending", now - datetime.timedelta(hours=48)), (3, "u", "c", "z", "redeemed", now)]
    tries = [(1, " A", "x"), (2, "a", "x"), (3, "b", "y"), (4, "c", "z"), (5, "a", "wrong"), (6, "nobody", "x")]
    got = talks.redeem_invitations(spark.createDataFrame(stored, INVITATION), spark.createDataFrame(tries, "pos long, email string, code string"), F.lit(now))
    assert {r["pos"]: r["outcome"] for r in got.collect()} == {1: "redeemed", 2: "invalid", 3: "expired", 4: "invalid", 5: "invalid", 6: "invalid"}


# --- cascade ------------------------------------------------------------------------------------------------


def test_cascade_stops_where_a_request_is_met(spark, monkeypatch):
    text = "some words about colour and form " * 4
    chunks = [(f"c{i}", text + str(i), "typology", "many" if i < 20 else "few" if i < 23 else "other", None, "A", None) for i in range(40)]
    c = spark.createDataFrame(chunks, "chunk_id string, text string, chunk_type string, source_id string, source_title string, author string, parent_id string")
    v = spark.createDataFrame([(f"c{i}", [1.0, i / 40]) for i in range(40)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1], "colour", "m"), (2, [1.0, 0.2], "colour", "f"), (3, [0.5, 0.2], "form", "n")], "query_id long, embedding array<double>, text string, scope string")
    asked = []
    dense = cascade.dense_retrieve
    monkeypatch.setattr(cascade, "dense_retrieve", lambda c_, v_, some, k, w: asked.append((k, sorted(r["query_id"] for r in some.collect()))) or dense(c_, v_, some, k, w))
    scopes = {"m": F.col("source_id") == "many", "f": F.col("source_id") == "few", "n": F.col("source_id") == "absent"}
    got = cascade.typology(c, v, q, scopes).collect()
    assert asked == [(14, [1]), (14, [2]), (14, [3]), (28, [2]), (28, [3])]
    assert {(r["query_id"], r["stage"]) for r in got} == {(1, "narrow"), (2, "wide")} and sum(r["query_id"] == 1 for r in got) == 12


# --- tools --------------------------------------------------------------------------------------------------


def test_tools_check_arguments_and_read_blocks(spark):
    docs = spark.createDataFrame([(1, "intro\n\n## A\nfirst\n\nsecond\n### S\nthird\n\n## A\nother"), (2, None)], "doc_id long, text string")
    args = lambda *a: json.dumps({"addresses": list(a)})
    calls = [(1, 1, "read_blocks", args({"paragraph_id": "ch1.p2"}, {"heading_path": ["## A"]}, {"heading_path": ["## A", "### S"]}, {"heading_path": ["## B"]}, {})),
             (2, 1, "read_blocks", "{}"), (3, 1, "burn", args()), (4, 1, "read_blocks", "[1"), (5, 2, "read_blocks", args({"paragraph_id": "ch0.p1"})), (6, 1, "read_blocks", args())]
    found, refused = tools.invoke(spark.createDataFrame(calls, "call_id long, doc_id long, tool string, args string"), docs)
    assert sorted((r["call_id"], r["address_no"], r["content"]) for r in found.collect()) == [(1, 0, "second"), (1, 1, "first\n\nsecond"), (1, 2, "third")]
    assert {r["call_id"]: r["errors"] for r in refused.collect()} == {2: ["addresses is missing"], 3: ["tool is unknown"], 4: ["args are no object"]}
    assert [t.id for t in tools.available("chat", True)] == ["read_blocks"] and tools.available("chat", False) == [] == tools.available("other", True)
    assert tools.schemas(tools.available("chat", True))[0]["function"]["parameters"]["required"] == ["addresses"]


# --- embedding service --------------------------------------------------------------------------------------


def test_service_gets_small_requests(spark):
    sizes, lost = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def service():
        tries = [0]

        def answer(texts):
            tries[0] += 1
            if tries[0] % 2 == 1:
                lost.add(1)
                raise ConnectionError
            assert 1 <= len(texts) <= 8
            sizes.add(1)
            return [[float(len(t)), 1.0] for t in texts]

        return answer

    docs = spark.createDataFrame([(i, "x" * i if i else None) for i in range(50)], "id long, text string").coalesce(1)
    got = M.embed_by_service(docs, service, wait=0.0).collect()
    assert all(np.allclose(r["embedding"], [r["id"], 1]) for r in got) and sizes.value == 7 and lost.value == 7  # 32 + 18 texts: 4 and 3 requests
    with pytest.raises(ValueError, match="no field body"):
        M.embed_by_service(docs, service, text="body")
    with pytest.raises(ValueError, match="32"):
        M.embed_by_service(docs, service, call=33)


def test_service_is_asked_one_by_one_after_a_wrong_answer(spark):
    def service():
        return lambda texts: [[float(len(t))] for t in texts] if len(texts) == 1 else [[1.0]]

    docs = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, text string").coalesce(1)
    assert all(r["embedding"] == [float(r["id"])] for r in M.embed_by_service(docs, service).collect())
    with pytest.raises(Exception, match="no 1 vectors"):
        M.embed_by_service(docs, lambda: lambda texts: []).collect()


# --- figures of runs ----------------------------------------------------------------------------------------


def test_runs_leave_figures(spark, tmp_path):
    sink = str(tmp_path / "sink")
    out = telemetry.recorded(spark.range(10), str(tmp_path / "a"), sink, "retrieval", "r", odd=F.count_if(F.col("id") % 2 == 1))
    with pytest.raises(Exception, match="broken"):
        telemetry.recorded(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), str(tmp_path / "b"), sink, "retrieval", "f")
    rows = {r["name"]: r for r in spark.read.parquet(sink).collect()}
    assert out.count() == rows["r"]["rows"] == 10 and rows["r"]["figures"] == {"odd": 5.0} and rows["r"]["seconds"] > 0 and rows["r"]["error"] is None
    assert rows["f"]["rows"] is None and rows["f"]["error"]
    assert telemetry.recorded(spark.range(4), str(tmp_path / "c"), "/proc/nowhere/sink", "retrieval", "x").count() == 4  # figures that cannot be kept hurt nothing


# --- counting through ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_over_parts(spark, parts):
    from lodestone.operators import ranking

    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").orderBy(F.rand(1))
    want, state = {}, {}
    for k, i, v in rows:
        n, s = state.get(k, (0, 0))
        state[k] = n + 1, s + (v or 0)
        want[i] = state[k]
    assert {r["i"]: (r["n"], r["upto_v"]) for r in ranking.running(df, "k", "i", ["v"], parts).collect()} == want
    assert ranking.running(df.limit(0), "k", "i", ["v"], parts).count() == 0
