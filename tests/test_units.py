"""Small cases of functions and operators that the tables do not hold."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models as M
from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators import filters, joins, merge, ranking
from lodestone.plans import context, fusion
from lodestone.sources import files, markdown


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("f, given, want", [
    (X.embedding_text, "12| a <q id='1'>b</q> so­ft", "a b soft"),
    (X.html_to_text, "<p>a&nbsp;&amp; b</p>\n<i>c</i>", "a & b c"), (X.html_to_text, "x &#8211; &auml;&#x41;&#150;&notin;&copy2;", "x – äA–∉©2;"), (X.nfc, "u\u0308", "ü"),
    (X.section_b, "a) x b) y\nz", "y\nz"), (X.section_b, "B) y\n c) z", "y"), (X.section_b, "nothing", ""), (X.html_to_text, "plain  text", "plain text"),
    (lambda c: X.redact(c, ["Max", "Max Muster"]), "Von Max Muster  hier", "Von hier"), (lambda c: X.redact(c, ["Max"]), "Max", "Max"),
    (lambda c: X.redact(c, ["Max"]), "Maximal Max", "Maximal"), (X.lemma, "Die  freien Geister", "geister"), (X.lemma, "das Ich", "ich"),
    (lambda c: X.snippet(c, 5), "abcdefgh", "abcd…"), (lambda c: X.truncate(c, 6), "abcdefgh", "abc..."),
    (lambda c: X.trim_to_sentence(c, 12), "One. Two three four", "One."), (lambda c: X.trim_to_sentence(c, 5), "abcdefgh", "abcde…"),
    (X.first_sentence, "A b. C", "A b."), (X.quote_key, "A  [x] B", "a b"), (X.person_name, "Rudolf_Steiner ", "rudolf steiner"),
    (X.book_title, "A_B#T_U#4", "A B: T U (GA 4)"), (X.year_of, "x [Berlin 1904] y", "1904"), (X.page_of, "x [GA4, S. 12]", "12"),
    (X.fenced_json, 'a ```json\n{"b":1}\n``` c', '{"b":1}'), (X.strip_usage_comment, "a\n<!-- usage: 1 -->\n", "a"),
])
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_references_that_are_cut_off(spark):
    given = "<b>x &amp</b> &amp; &copy2; &#38 &#38; &quo &am &nosuch; &amp;lt;"
    assert one(spark, given, lambda c: X.html_to_text(c, closed=True)) == "x &amp & &copy2; &#38 & &quo &am &nosuch; &lt;"
    assert one(spark, given, X.html_to_text) == "x & & ©2; & & &quo &am &nosuch; &lt;"


def test_words_of_requests(spark):
    asks = lambda t, **o: one(spark, t, lambda c: X.requests_write(c, F.lit(True), **o))
    assert asks("Trag ihn, ein Wort") and asks("Trag ihn, ein Wort", ascii_words=True)
    assert not asks("Trag ihn beöein") and asks("Trag ihn beöein", ascii_words=True)
    assert not asks("Trag ihn schein", ascii_words=True) and not asks("Trag ihn\nein", ascii_words=True)
    assert asks("Trag ihn\u2028ein") and asks("Trag ihn\rein", ascii_words=True)  # a line ends at a newline only


def test_flags(spark):
    assert one(spark, "„Ich stimme zu", X.agrees) and not one(spark, "Nein, ich stimme zu", X.agrees)
    assert one(spark, "Ja, ich lege an\nx", X.announces_create) and one(spark, " ", lambda c: X.is_incomplete(c, 1))
    assert [one(spark, s, X.paragraph_number) for s in ("3", "0", "x", None)] == [3, None, None, None]
    assert one(spark, "See [2], [1], [2]", X.citation_numbers) == [2, 1] and one(spark, "leben", X.lemma_variants) == ["leben", "leb"]


@pytest.mark.parametrize("name", ["doc-1", "Größe#7", ""])
def test_point_id_is_uuid5(spark, name):
    assert one(spark, name, X.point_id) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], V.unit, "array<double>") == [0.6, 0.8] and one(spark, [0.0, 0.0], V.unit, "array<double>") == [0.0, 0.0]
    assert one(spark, [[1.0, 2.0], [2.0, 5.0]], V.mean_pool, "array<array<double>>") == [1.5, 3.5]
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0]
    with pytest.raises(Exception, match="ragged"):
        one(spark, [[1.0], [1.0, 2.0]], V.mean_pool, "array<array<double>>")


def test_chunks_cover_the_text():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["abc ", ". ", "\n\n", "x", "! "]) for _ in range(rng.randint(0, 400)))
        for size, overlap in ((100, 20), (10, 9), (7, 7)):
            spans = M.chunk_spans(text, size, overlap)
            assert all(b - a <= size + 2 for a, b in spans) and (not text or (spans[0][0] == 0 and spans[-1][1] == len(text)))
            assert all(c <= b and c > a for (a, b), (c, _) in zip(spans, spans[1:]))


def test_embedder_and_retry(spark):
    got = M.embed(spark.createDataFrame([("a b",), (None,)], "text string")).collect()
    assert abs(np.linalg.norm(got[0]["embedding"]) - 1) < 1e-6 and not any(got[1]["embedding"])
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    M.with_retry(flaky, first_wait=0)()
    assert len(calls) == 3


def test_pack_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, "a", "x" * 4), (1, 2, "b", " "), (1, 3, "c", "y" * 9), (1, 4, "d", "z")], "query_id int, rank int, chunk_id string, text string")
    assert [(r["chunk_id"], r["packed"]) for r in context.pack(hits, 10).orderBy("rank").collect()] == [("a", True), ("c", False)]
    numbered = context.pack_numbered(hits, 10, start=7).collect()
    assert [(r["n"], r["line"]) for r in numbered] == [(7, "[7] xxxx")]
    assert context.context_text(context.pack(hits, 100)).first()["context"] == "xxxx\n\nyyyyyyyyy\n\nz"


def test_fusion_keeps_first_appearance_on_ties(spark):
    make = lambda ids: spark.createDataFrame([(1, i + 1, c, 0.5) for i, c in enumerate(ids)], "query_id int, rank int, chunk_id string, score double")
    assert [r["chunk_id"] for r in fusion.rrf(make("ab"), make("ba"), 9).orderBy("rank").collect()] == ["a", "b"]
    assert [r["chunk_id"] for r in fusion.slots(make("abc"), make("bxy"), 4, 2).orderBy("rank").collect()] == ["a", "b", "x", "y"]
    assert [r["chunk_id"] for r in fusion.ordered_union(make("a"), make("bac"), 2).orderBy("rank").collect()] == ["a", "b"]


def test_swaps(spark):
    chunks = spark.createDataFrame([("q1", "quote", None), ("b1", "book", None), ("e1", "quote_explanation", "q1"), ("e2", "quote_explanation", "q9"), ("e3", "quote_explanation", "b1")], "chunk_id string, chunk_type string, parent_id string")
    hits = chunks.where("chunk_id like 'e%'").select(F.lit(1).alias("query_id"), F.substring("chunk_id", 2, 1).cast("int").alias("rank"), "*", F.lit(1.0).alias("score"))
    ids = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert ids(joins.swap_or_drop(hits, chunks)) == ["q1"] and ids(joins.swap_or_keep(hits, chunks)) == ["b1", "e2", "q1"]
    twice = hits.unionByName(hits.where("chunk_id = 'e1'").withColumn("rank", F.lit(9)))
    assert ids(joins.swap_once(twice, chunks)) == ["q1"]


def test_terms_within_words(spark):
    prompts = spark.createDataFrame([(1, "Die Geisteswissenschaft\nund 𝒳y"), (2, "nichts"), (None, "ein Geist"), (4, "ein Geist")], "query_id int, prompt string")
    terms = spark.createDataFrame([("a", "s", "geist"), ("b", "s", "GEISTESWISSEN"), ("c", "t", "t\nund 𝒳"), ("d", "t", "geisteswissenschaften"), ("e", "u", ""), ("f", "u", None), ("g", "u", "wissenschaft")], "chunk_id string, segment_id string, term string")
    got = sorted(((r["query_id"], r["chunk_id"]) for r in joins.term_hits(prompts, terms).collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "b"), (1, "c"), (1, "g"), (None, "a"), (4, "a")], key=repr)


def test_quotes_within_paragraphs(spark):
    cols = "chunk_id string, content_hash string, segment_id string, text string"
    paragraphs = spark.createDataFrame([("p1", "x1", "y1", "s", "One two [1] three four"), ("p2", "x2", "y2", "s", "seven eight"), ("p3", "x3", "y3", "s", "twice"), ("p4", "x4", "y4", "s", "twice"), ("p5", "x5", "y5", "t", "One two three"), ("p6", "x6", "y6", "s", "")], "paragraph_id string, " + cols)
    texts = {"part": ("s", "TWO  three"), "whole": ("s", "six seven eight nine"), "both": ("s", "twice"), "many": ("s", "t"), "other": ("u", "two three"), "empty": ("s", "[2]"), "within": ("s", "eve")}
    quotes = spark.createDataFrame([(k, "c" + k, "h" + k, *v) for k, v in texts.items()], "quote_id string, " + cols)
    got = {r["quote_id"]: (r["paragraph_id"], r["how"]) for r in joins.match_quotes(quotes, paragraphs).collect()}
    none = (None, None)
    assert got == {"part": ("p1", "part"), "whole": ("p2", "part"), "both": none, "many": none, "other": none, "empty": ("p6", "text"), "within": ("p2", "part")}


def test_scopes(spark):
    rows = spark.createDataFrame([("main", "book", "s1", None, None), ("__shared__", "book", "s1", None, None), ("__shared__", "quote", "s2", None, None)], "rag_partition string, chunk_type string, source_id string, embedded_at timestamp, deprecated_at timestamp")
    n = lambda **k: rows.where(filters.embed_scope("main", **k)).count()
    assert (n(), n(shared_sources=[]), n(shared_sources=["s2"]), n(types=[]), n(types=["book"])) == (3, 1, 2, 0, 2)


def test_continuation_stops_at_a_gap(spark):
    rows = spark.createDataFrame([("s", i) for i in (75, 76, 77, 78, 82, 86)], "segment_id string, source_index int")
    anchor = spark.createDataFrame([("s", 75)], "segment_id string, max_index int")
    assert sorted(r["source_index"] for r in ranking.continuation(rows, anchor).collect()) == [76, 77, 78]


def test_upsert_twice_changes_nothing(spark):
    cols = "rag_partition string, chunk_id string, content_hash string, author string, updated_at timestamp, embedded_at timestamp, deprecated_at timestamp"
    t = "2024-01-01 00:00:00"
    old = spark.sql(f"select 'm' rag_partition, c chunk_id, h content_hash, 'A' author, timestamp'{t}' updated_at, timestamp'{t}' embedded_at, cast(null as timestamp) deprecated_at from values ('1','a'),('2','b') v(c,h)")
    batch = spark.sql(f"select 'm' rag_partition, c chunk_id, h content_hash, 'A' author, timestamp'{t}' updated_at from values ('1','a'),('2','x'),('3','c') v(c,h)")
    now = F.expr("timestamp'2025-01-01 00:00:00'")
    once = merge.upsert(old, batch, now)
    assert {r["chunk_id"]: r["action"] for r in once.collect()} == {"1": "kept", "2": "updated", "3": "inserted"}
    assert {r["chunk_id"]: r["embedded_at"] is None for r in once.collect()} == {"1": False, "2": True, "3": True}
    assert {r["action"] for r in merge.upsert(once.drop("action"), batch, now).collect()} == {"kept"}
    assert cols and merge.stale_points(spark.sql("select 's' source_id, 't' chunk_type, 'c' chunk_id"), spark.createDataFrame([], "source_id string, chunk_type string, chunk_id string"), spark.sql("select 's' source_id, 't' chunk_type")).count() == 1


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('\n# c\n{"id": "1", "text": "x", "metadata": {"chunk_id": "1"}}\n{broken\n')
    assert files.read_json_lines(spark, str(p), strict=False).where("bad is not null").count() == 1
    with pytest.raises(Exception, match="not a record"):
        files.read_json_lines(spark, str(p)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "Idealismus").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "Idealismus" / "A_B@T_U.txt").write_bytes("Größe".encode("latin-1"))
    (tmp_path / ".hidden" / "x.txt").write_text("x")
    (tmp_path / "a.bin").write_bytes(b"\x00")
    got = [(r["category"], r["author"], r["title"]) for r in files.catalogue(spark, str(tmp_path)).collect()]
    assert got == [("Idealismus", "A B", "T U")]
    texts = {r["kind"]: (r["text"], r["error"]) for r in files.read_texts(spark, str(tmp_path)).where("path not like '%hidden%'").collect()}
    assert texts["txt"] == ("Größe", None) and texts["unknown"][1] == "unknown file type: bin"
    assert one(spark, "{'word_stats': {'a': 2}}", files.quantify) == [("a", 2)] and one(spark, "nonsense", files.quantify) == []


def test_blocks(spark):
    flat = markdown.flatten(spark.createDataFrame([(1, "# T\n## A\np1\n\np2\n### S\np3\n## B\n### S\np4")], "doc_id int, text string"))
    want = lambda p, h: sorted(r["text"] for r in markdown.read_blocks(flat, spark.createDataFrame([(1, p, h)], "doc_id int, paragraph_id string, heading_path array<string>")).collect())
    assert want("ch1.p2", None) == ["p2"] and want(None, ["## A"]) == ["p1", "p2"] and want(None, ["## B", "### S"]) == ["p4"] and want("ch9.p9", None) == []
    assert one(spark, "\n# My title\nx", markdown.document_title) == "My title" and one(spark, "x", markdown.document_title) == "Ohne Titel"


def test_chunk_types(spark):
    assert one(spark, ["Quote", " text ", "talk", "", "x"], X.chunk_types, "array<string>") == ["quote", "quote_explanation", "book", "secondary_book", "talk", "x"]
    assert len(one(spark, [" "], X.chunk_types, "array<string>")) == 8 and len(one(spark, None, X.chunk_types, "array<string>")) == 8


def test_sufficiency_has_all_queries(spark):
    q = spark.createDataFrame([(i,) for i in range(5)], "query_id int")
    hits = spark.createDataFrame([(0, 0.8, "x" * 900)] * 3 + [(1, 0.1, "y" * 300)] * 2 + [(2, 0.6, "z"), (3, 0.2, "z")], "query_id int, score double, text string")
    assert {r["query_id"]: r["sufficiency"] for r in fusion.sufficiency_by_score(hits, q).collect()} == {0: "high", 1: "medium", 2: "medium", 3: "low", 4: "insufficient"}
    assert {r["query_id"]: (r["n"], r["sufficiency"]) for r in fusion.sufficiency_by_text(hits, q).collect()} == {0: (3, "high"), 1: (2, "medium"), 2: (1, "low"), 3: (1, "low"), 4: (0, "low")}


def test_manifests_and_tools(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("id: x\nqueries:\n  - name: a\n    k: 3\n")
    (tmp_path / "none.yaml").write_text("")
    assert files.manifest(spark, str(tmp_path / "m.yaml")) == {"id": "x", "queries": [{"name": "a", "k": 3}]} and files.manifest(spark, str(tmp_path / "none.yaml")) == {}
    actions = spark.createDataFrame([("z", "Z", None), ("b", "B", True), ("a", "A", False), ("m", "M", False)], "id string, label string, beta boolean")
    assert [r["id"] for r in files.list_actions(actions, ["m", "z"]).collect()] == ["m", "z", "a"]
    assert [(r["id"], r["label"]) for r in files.list_actions(actions, ["b"], beta=True).collect()][0] == ("b", "B (beta)")
    tools = spark.createDataFrame([("a", None, []), ("b", True, ["x"]), ("c", False, ["y"])], "id string, requires_document boolean, modes array<string>")
    assert [r["id"] for r in tools.where(filters.tool_available(True, "x")).orderBy("id").collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b, c")], "id int, name string")
    files.write_report(rows, f"{tmp_path}/report")
    assert sorted(map(tuple, spark.read.option("header", "true").csv(f"{tmp_path}/report").collect())) == [("1", "a"), ("2", "b, c")]
    rows.write.parquet(f"{tmp_path}/from")
    assert files.copy_checked(spark, f"{tmp_path}/from", f"{tmp_path}/to") == 2
    newer, broken = spark.createDataFrame([(2, "new"), (3, "d")], "id int, name string"), spark.createDataFrame([(1,)], "other int")
    done, failed = files.sync_tables(spark, {"t": (newer, ["id"]), "fresh": (rows, ["id"]), "bad": (broken, ["id"])}, {"t": rows, "bad": rows})
    assert sorted(map(tuple, done["t"].collect())) == [(1, "a"), (2, "new"), (3, "d")] and done["fresh"].count() == 2 and list(failed) == ["bad"]
    lines = ['{"metadata": {"chunk_id": "q1", "content_hash": "h", "chunk_type": "quote", "paragraph": 3}}', '{"metadata": {"chunk_id": "q2", "chunk_type": "quote", "paragraph": 0}}', "no json"]
    (tmp_path / "q.jsonl").write_text("\n".join(lines))
    assert [(r["chunk_id"], r["paragraph"]) for r in files.quote_records(spark, [str(tmp_path / "q.jsonl")]).collect()] == [("q1", 3)]


def test_changes_of_search_keys_only(spark):
    stored = spark.createDataFrame([("a", "h", "quote", "X", "p"), ("b", "h", "quote", None, "p")], "chunk_id string, content_hash string, chunk_type string, venue string, worldview string")
    batch = spark.createDataFrame([("a", "h", "quote", "X", "other"), ("b", "h", "quote", "Y", "p"), ("c", "h", "quote", "Y", "p")], stored.schema)
    assert {r["chunk_id"]: r["change"] for r in merge.classify(batch, stored).collect()} == {"a": "unchanged", "b": "payload_only", "c": "new"}
    with pytest.raises(ValueError):
        merge.classify(batch.drop("venue"), stored)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from lodestone.sources import scratch

    class Conf(dict):
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"getConf": staticmethod(Conf)})

    with pytest.raises(ValueError):
        scratch.folder(Session, "x")
    assert scratch.folder(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_dense_queries_in_blocks(spark, monkeypatch):
    """Query vectors in several blocks give the hits of one block."""
    from lodestone.plans import dense

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(f"c{i}", [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(60)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(9)], "query_id int, embedding array<double>")
    whole = sorted(map(tuple, dense.top_k(v, q, 3).collect()))
    monkeypatch.setattr(dense, "BLOCK_FLOATS", 12)
    assert sorted(map(tuple, dense.top_k(v, q, 3).collect())) == whole and len(whole) == 27
    assert dense.top_k(v, q.limit(0), 3).count() == 0
