"""Retrieval queries: every 20th vector or benchmark item is a query against all chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import filters, ranking, telemetry
from ..plans import cascade, context, fusion
from ..plans.dense import dense_retrieve, top_k, with_payload
from ..plans.sparse import sparse_retrieve, sparse_top
from ..registry import query
from ..schemas import overfetch
from ..sources.scratch import folder
from ..sources.testdata import CHUNKS_SQL, chunks, table, vectors
from .citations import PARAGRAPHS_SQL, paragraphs

FIELDS = ("text", "chunk_type", "source_id", "source_title", "author", "parent_id")


def vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def text_queries(spark, d):
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def item_vectors(spark, d):
    """The vectors that stand for the benchmark items of text_queries."""
    return vector_queries(spark, d).join(text_queries(spark, d).select("query_id"), "query_id", "left_semi")


# --- the same lists in SQL ----------------------------------------------------------------------------------

_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_Q = """
vq as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 20 = 0),
tq as (select item_id as query_id, text as qtext from benchmark where item_id % 20 = 0),
iq as (select * from vq where query_id in (select query_id from tq))"""


def _cap(name: str, source: str, k: int) -> str:
    return f"""
{name} as (select * exclude (rank), row_number() over (partition by query_id order by rank) as rank from {source}
  where length({_STRIP}) >= 80 qualify row_number() over (partition by query_id order by rank) <= {k})"""


def dense_sql(name: str, k: int, queries: str = "vq", where: str = "true") -> str:
    return f"""
{name}_all as (select query_id, chunk_id, round(list_cosine_similarity(e.embedding::double[], qv), 9) as score, {", ".join(f"c.{f}" for f in FIELDS)}
  from chunks c join embeddings e on e.vec_id = c.doc_id, {queries} where {where}),
{name}_top as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from {name}_all
  qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {overfetch(k)}),""" + _cap(name, f"{name}_top", k)


def sparse_sql(name: str, k: int, where: str = "true", idf: bool = True) -> str:
    weight = "ln(1 + (n - df + 0.5::double) / (df + 0.5::double))" if idf else "1.0::double"
    return rf"""
{name}_scope as (select * from chunks c where {where}),
{name}_ws as (select chunk_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ws from {name}_scope),
{name}_stats as (select count(*) as n, avg(len(ws)::double) as avg_len from {name}_ws),
{name}_q as (select query_id, term, count(*) as w from (select query_id, unnest(regexp_extract_all(lower(qtext), '[\p{{L}}\p{{N}}]+')) as term from tq) group by all),
{name}_post as (select chunk_id, len, term, count(*)::double as tf from (select chunk_id, len(ws)::double as len, unnest(ws) as term from {name}_ws) where term in (select term from {name}_q) group by all),
{name}_df as (select term, count(*) as df from {name}_post group by 1),
{name}_all as (select query_id, chunk_id, round(sum(w * {weight} * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)))::double), 6) as score
  from {name}_post join {name}_q using (term) join {name}_df using (term), {name}_stats group by all),
{name}_top as (select a.*, {", ".join(f"c.{f}" for f in FIELDS)}, row_number() over (partition by query_id order by score desc, chunk_id) as rank from {name}_all a join {name}_scope c using (chunk_id)
  qualify row_number() over (partition by query_id order by score desc, chunk_id) <= {overfetch(k)}),""" + _cap(name, f"{name}_top", k)


def rrf_sql(name: str, a: str, b: str, k: int) -> str:
    return f"""
{name} as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, seen) as rank from
  (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as score, min(list * 100000 + rank) as seen from
    (select query_id, chunk_id, rank, 0 as list from {a} union all select query_id, chunk_id, rank, 1 from {b}) group by all)
  qualify row_number() over (partition by query_id order by score desc, seen) <= {k})"""


def sql(*parts: str, end: str) -> str:
    return "with " + ",".join([CHUNKS_SQL, _Q, *parts]) + " " + end


_LIST = "select query_id, rank, chunk_id, round(score, 6) as score from "


def listed(hits):
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


# --- lists --------------------------------------------------------------------------------------------------


@query(sql(dense_sql("h", 10), end=_LIST + "h"))
def dense_topk(spark, d):
    return listed(dense_retrieve(chunks(spark, d), vectors(spark, d), vector_queries(spark, d), 10))


@query(sql(dense_sql("h", 10, where="list_contains(worldviews, 'Idealismus') and chunk_type in ('chapter_summary', 'secondary_book', 'quote_explanation', 'typology') and author = 'Author B'"), end=_LIST + "h"))
def dense_topk_filtered(spark, d):
    where = filters.payload("Idealismus", ["chapter_summary", "secondary", "quote_explanation", "typology"], "Author B")
    return listed(dense_retrieve(chunks(spark, d), vectors(spark, d), vector_queries(spark, d), 10, where))


@query(sql(sparse_sql("h", 10), end=_LIST + "h"))
def sparse_bm25_topk(spark, d):
    return listed(sparse_retrieve(chunks(spark, d), text_queries(spark, d), 10))


@query(sql(sparse_sql("h", 10, where="deprecated_at is null", idf=False), end=_LIST + "h_top where rank <= 20"))
def sparse_tf_topk_active(spark, d):
    scope = chunks(spark, d).where(filters.active())
    return listed(sparse_top(scope, text_queries(spark, d), overfetch(10), idf=False).where("rank <= 20"))


@query(sql(dense_sql("a", 20, "iq"), sparse_sql("b", 20), rrf_sql("f", "a", "b", 30), end=_LIST + "f"))
def rrf_hybrid(spark, d):
    c = chunks(spark, d)
    return listed(fusion.rrf(dense_retrieve(c, vectors(spark, d), item_vectors(spark, d), 20), sparse_retrieve(c, text_queries(spark, d), 20), 30))


_BRANCHES = {"quotes": "chunk_type in ('quote', 'quote_explanation')", "books": "chunk_type in ('book', 'secondary_book') and author = 'Author A'"}


@query(sql(*[dense_sql(f"{n}_d", 10, "iq", w) for n, w in _BRANCHES.items()], *[sparse_sql(f"{n}_s", 10, w) for n, w in _BRANCHES.items()],
           *[rrf_sql(n, f"{n}_d", f"{n}_s", 15) for n in _BRANCHES], rrf_sql("f", "quotes", "books", 20), end=_LIST + "f"))
def quote_parallel_hybrid(spark, d):
    """Two filtered hybrid branches, fused again."""
    c, v = chunks(spark, d), vectors(spark, d)
    scopes = filters.payload(book_types=["quote", "quote_explanation"]), filters.payload(book_types=["primary", "secondary"], author="Author A")
    one = [fusion.rrf(dense_retrieve(c, v, item_vectors(spark, d), 10, w), sparse_retrieve(c, text_queries(spark, d), 10, w), 15) for w in scopes]
    return listed(fusion.rrf(*one, 20))


@query(sql(dense_sql("a", 12, "iq"), sparse_sql("b", 12), end="""
, h as (select query_id, chunk_id, score, 0 as list, rank from a where rank <= 8), t as (select query_id, chunk_id, score, 1 as list, rank from b where (query_id, chunk_id) not in (select (query_id, chunk_id) from h))
select query_id, n as rank, chunk_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by list, rank) as n from (from h union all from t)) where n <= 12"""))
def dense_plus_sparse_slots(spark, d):
    c = chunks(spark, d)
    return listed(fusion.slots(dense_retrieve(c, vectors(spark, d), item_vectors(spark, d), 12), sparse_retrieve(c, text_queries(spark, d), 12), 12))


_RERANK = """
select query_id, row_number() over (partition by query_id order by dt desc, rank) as rank, chunk_id, round(score, 6) as score from
  (select h.*, round(list_dot_product(e.embedding::double[], q.qv), 9) as dt from h join embeddings e on 'doc-' || e.vec_id = h.chunk_id join iq q on q.query_id = h.query_id)
  qualify row_number() over (partition by query_id order by dt desc, rank) <= 8"""


def _with_vectors(spark, d, hits, queries):
    return hits.join(vectors(spark, d).select("chunk_id", "embedding"), "chunk_id").join(
        queries.select("query_id", F.col("embedding").alias("query_embedding")), "query_id")


@query(sql(sparse_sql("h", 30), end=_RERANK))
def rerank_dot(spark, d):
    """Sparse hits that have a vector, reordered by it; the sparse scores are kept."""
    hits = sparse_retrieve(chunks(spark, d), text_queries(spark, d), 30)
    return listed(fusion.rerank(_with_vectors(spark, d, hits, item_vectors(spark, d)), 8))


@query(sql(end="""
select query_id, rank, chunk_id, round(score, 6) as score from (select query_id, 'doc-' || vec_id as chunk_id, round(list_cosine_similarity(embedding::double[], qv), 9) as score,
  row_number() over (partition by query_id order by round(list_cosine_similarity(embedding::double[], qv), 9) desc, 'doc-' || vec_id) as rank from embeddings, vq) where rank <= 5"""))
def batch_topk_per_query(spark, d):
    """In-memory similarity search: no filters, no length rule."""
    return listed(top_k(vectors(spark, d), vector_queries(spark, d), 5))


@query(sql(dense_sql("h", 20), end="""
select vq.query_id, case when count(chunk_id) = 0 then 'insufficient' when count(*) filter (score > 0.7) >= 3 then 'high'
  when count(chunk_id) >= 2 or count(*) filter (score > 0.5) > 0 then 'medium' else 'low' end as sufficiency
from vq left join (select * from h where source_id = 'src' || (query_id // 20 % 20)) h on h.query_id = vq.query_id group by 1"""))
def sufficiency_score(spark, d):
    """Hits are those of the query's own source, so some queries have none."""
    q = vector_queries(spark, d)
    hits = dense_retrieve(chunks(spark, d), vectors(spark, d), q, 20).where(F.col("source_id") == F.concat(F.lit("src"), F.expr("query_id div 20 % 20")))
    return fusion.sufficiency_by_score(hits, q)


@query(sql(dense_sql("h", 8, where="chunk_type in ('book', 'quote')"), end=f"""
select query_id, n, chars, case when chars < 200 or n = 0 then 'low' when chars >= 2000 and n >= 3 then 'high' when chars >= 600 then 'medium' else 'low' end as sufficiency
from (select vq.query_id, count(chunk_id) as n, coalesce(sum(length({_STRIP})), 0)::bigint as chars
  from vq left join (select * from h where source_id > 'src' || (query_id // 20 % 20)) h on h.query_id = vq.query_id group by 1)"""))
def sufficiency_text(spark, d):
    q = vector_queries(spark, d)
    hits = dense_retrieve(chunks(spark, d), vectors(spark, d), q, 8, filters.payload(book_types=["primary", "quote"]))
    return fusion.sufficiency_by_text(hits.where(F.col("source_id") > F.concat(F.lit("src"), F.expr("query_id div 20 % 20"))), q)


# --- widening, choosing, cascades ---------------------------------------------------------------------------


@query(sql(dense_sql("b", 4, where="chunk_type in ('book', 'quote') and author = 'Author A' and worldview = 'Spiritualismus'"), dense_sql("w", 20), end="""
, ok as (select query_id from b group by 1 having count(*) >= 4 and sum(length(text)) >= 400)
select query_id, rank, chunk_id, round(score, 6) as score, false as widened from b where query_id in (from ok)
union all select query_id, rank, chunk_id, round(score, 6), true from w where query_id not in (from ok)"""))
def widen_when_thin(spark, d):
    c, v, q = chunks(spark, d), vectors(spark, d), vector_queries(spark, d)
    base = dense_retrieve(c, v, q, 4, filters.payload("Spiritualismus", ["primary", "quote"], "Author A"))
    both = fusion.widened(base, dense_retrieve(c, v, q, 20), 4)
    return both.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"), "widened")


@query(sql(dense_sql("a", 6, "iq", "author = 'Author A'"), sparse_sql("b", 8), end="""
, x as (select query_id, count(*) as n, sum(length(text)) as c from a group by 1), y as (select query_id, count(*) as n, sum(length(text)) as c from b group by 1)
select coalesce(x.query_id, y.query_id) as query_id, case when x.query_id is null or y.n > x.n or (y.n = x.n and y.c > x.c) then 'second' else 'first' end as choice from x full join y on x.query_id = y.query_id"""))
def better_candidate(spark, d):
    c = chunks(spark, d)
    return fusion.better(dense_retrieve(c, vectors(spark, d), item_vectors(spark, d), 6, filters.payload(author="Author A")), sparse_retrieve(c, text_queries(spark, d), 8))


_SCOPES = {"many": "chunk_type = 'typology' and author = 'Author A'", "few": "chunk_type = 'typology' and source_id = 'src1'", "none": "chunk_type = 'typology' and source_id = 'src1' and author = 'Author C'"}
_TYPO_STEPS = [
    "\nmq as (select item_id as query_id, qtext, embedding::double[] as qv, case item_id % 3 when 0 then 'many' when 1 then 'few' else 'none' end as scope from (select item_id, text as qtext from benchmark) join embeddings on vec_id = item_id)",
    *[f"\nq_{s} as (select * from mq where scope = '{s}')" for s in _SCOPES],
    *[dense_sql(f"{n}_{s}", k, f"q_{s}", w) for s, w in _SCOPES.items() for n, k in (("a", 14), ("b", 28))],
    "\na as (" + " union all ".join(f"select query_id, rank, chunk_id from a_{s}" for s in _SCOPES) + ")",
    "\nb as (" + " union all ".join(f"select query_id, rank, chunk_id from b_{s}" for s in _SCOPES) + ")",
    "\nna as (select query_id from a group by 1 having count(*) >= 6)", "\nnb as (select distinct query_id from b where query_id not in (from na))",
    "\nd_all as (select query_id, chunk_id, round(list_cosine_similarity(e.embedding::double[], qv), 9) as score from chunks c join embeddings e on e.vec_id = c.doc_id, mq)",
    "\nd as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from d_all qualify rank <= 24)",
]


def _typology_sql() -> str:
    sparse = sparse_sql("s", 24).replace(" from tq)", " from mq)")
    sparse = sparse[: sparse.index("s_top as")].rstrip().rstrip(",")
    steps = [*_TYPO_STEPS, sparse, "\ns as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s_all qualify rank <= 24)", rrf_sql("f", "d", "s", 40),
             "\nh as (select query_id, row_number() over (partition by query_id order by rank) as rank, chunk_id from f join chunks c using (chunk_id) join mq using (query_id) where (" + " or ".join(
                 f"(scope = '{s}' and {w})" for s, w in _SCOPES.items()) + f") and length({_STRIP}) >= 80)",
             "\nx as (select *, 'narrow' as stage from a where query_id in (from na) union all select *, 'wide' from b where query_id in (from nb) union all select *, 'hybrid' from h where query_id not in (from na) and query_id not in (from nb))",
             "\nr as (select query_id, chunk_id, stage, row_number() over (partition by query_id order by round(list_dot_product(e.embedding::double[], qv), 9) desc, rank) as rank from x join embeddings e on 'doc-' || e.vec_id = chunk_id join mq using (query_id) qualify rank <= 12)",
             f"\np as (select query_id, rank, chunk_id, stage, sum(length({_STRIP})) over (partition by query_id order by rank) as cum, length({_STRIP}) as n from r join chunks using (chunk_id))"]
    return sql(*steps, end="select query_id, rank, chunk_id, stage, cum::bigint as cum, cum <= 14000 as packed from p where cum <= 14000 or cum - n <= 14000")


@query(_typology_sql())
def typology_cascade(spark, d):
    """Every benchmark item asks within one of three scopes: with many chunks, with few, and with none."""
    scope = F.element_at(F.array(*[F.lit(s) for s in _SCOPES]), (F.col("query_id") % 3 + 1).cast("int"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(
        table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").withColumn("scope", scope)
    found = cascade.typology(chunks(spark, d), vectors(spark, d), q, {s: F.expr(w) for s, w in _SCOPES.items()})
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "stage", F.col("cum").cast("long").alias("cum"), "packed")


@query(sql(dense_sql("a", 6, where="chunk_type = 'book'"), dense_sql("b", 4, where="chunk_type = 'secondary_book'"), dense_sql("c", 2, where="chunk_type = 'quote'"), end=" union all ".join(
    f"select '{s}' as slot, query_id, rank, chunk_id from {t}" for s, t in (("primary", "a"), ("secondary", "b"), ("quotes", "c")))))
def broad_slots(spark, d):
    """One list a slot; each slot has its own filter and length."""
    c, v, q = chunks(spark, d), vectors(spark, d), vector_queries(spark, d)
    one = [dense_retrieve(c, v, q, k, filters.payload(book_types=[t])).select(F.lit(s).alias("slot"), "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")
           for s, t, k in (("primary", "primary", 6), ("secondary", "secondary", 4), ("quotes", "quote", 2))]
    return one[0].union(one[1]).union(one[2])


_VIEWS = ("Dynamismus", "Idealismus", "Psychismus")


@query(sql(*[dense_sql(f"v{i}{part}", k, "iq", f"worldview = '{w}'{more}") for i, w in enumerate(_VIEWS) for part, k, more in (("a", 4, ""), ("b", 2, " and chunk_type in ('book', 'secondary_book')"))],
           end=" union all ".join(f"select '{w}' as worldview, '{slot}' as slot, query_id, rank, chunk_id from v{i}{part}" for i, w in enumerate(_VIEWS) for part, slot in (("a", "all"), ("b", "books")))))
def worldview_fan_out(spark, d):
    """Two contexts for each worldview and query, each retrieved within the worldview."""
    c, v, q = chunks(spark, d), vectors(spark, d), item_vectors(spark, d)
    out = None
    for w in _VIEWS:
        for slot, k, types in (("all", 4, []), ("books", 2, ["primary", "secondary"])):
            one = dense_retrieve(c, v, q, k, filters.payload(w, types)).select(F.lit(w).alias("worldview"), F.lit(slot).alias("slot"), "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")
            out = one if out is None else out.union(one)
    return out


# --- context ------------------------------------------------------------------------------------------------

_PACK = f"""
, t as (select query_id, rank, chunk_id, {_STRIP} as text from h where {_STRIP} <> ''),
s as (select *, sum(length(text)) over (partition by query_id order by rank)::bigint as cum from t)
select query_id, rank, chunk_id, length(text)::bigint as chars, cum, cum <= 6000 as packed from s where cum - length(text) <= 6000"""


@query(sql(dense_sql("h", 12), end=_PACK))
def context_pack(spark, d):
    hits = dense_retrieve(chunks(spark, d), vectors(spark, d), vector_queries(spark, d), 12)
    return context.pack(hits, 6000).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.length("text").cast("long").alias("chars"), "cum", "packed")


@query(sql(dense_sql("h", 12), end=f"""
, t as (select *, {_STRIP} as body, row_number() over (partition by query_id order by rank) + 2 as n from h where {_STRIP} <> ''),
l as (select query_id, n, chunk_id, '[' || n || '] (r: ' || printf('%.4f', round(score, 4)) || ', ' || chunk_type || ') ' || body as line from t),
s as (select *, sum(length(line)) over (partition by query_id order by n) as cum from l)
select query_id, n, chunk_id, length(line)::bigint as chars, sha256(line) as line_sha256 from s where cum <= 6000"""))
def context_pack_numbered(spark, d):
    hits = dense_retrieve(chunks(spark, d), vectors(spark, d), vector_queries(spark, d), 12)
    packed = context.pack_numbered(hits, 6000, start=3, with_score=True)
    return packed.select("query_id", F.col("n").cast("long").alias("n"), "chunk_id", F.length("line").cast("long").alias("chars"), F.sha2("line", 256).alias("line_sha256"))


# --- search of the app ----------------------------------------------------------------------------------------

_TITLE = """select query_id, chunk_id, 1.0::double / n as score, row_number() over (partition by query_id order by kind, updated_at desc, chunk_id) as rank from (
  select query_id, chunk_id, updated_at, case when lower(segment_title) = lower(q) then 0 when lower(source_title) = lower(q) then 1 else 2 end as kind,
  case when lower(segment_title) = lower(q) then 1.0 when lower(source_title) = lower(q) then 1.25 else 2.0 end as n
  from chunks, (values (0, 'Chapter 7'), (20, 'volume 1')) t(query_id, q) where chunk_type = 'chapter_summary' and (segment_title ilike '%' || q || '%' or source_title ilike '%' || q || '%'))
  qualify row_number() over (partition by query_id order by kind, updated_at desc, chunk_id) <= 10"""


def title_hits(spark, d):
    """Chapter summaries whose chapter or volume title holds the query: exact chapter, exact volume, other."""
    q = spark.createDataFrame([(0, "Chapter 7"), (20, "volume 1")], "query_id long, q string")
    hit = F.expr("segment_title ilike concat('%', q, '%') or source_title ilike concat('%', q, '%')")
    kind = F.when(F.lower("segment_title") == F.lower("q"), 0).when(F.lower("source_title") == F.lower("q"), 1).otherwise(2)
    found = chunks(spark, d).where("chunk_type = 'chapter_summary'").join(F.broadcast(q), hit).withColumn("kind", kind)
    score = F.when(F.col("kind") == 0, 1.0).when(F.col("kind") == 1, 0.8).otherwise(0.5)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("kind", F.desc_nulls_last("updated_at"), "chunk_id"))
    return found.withColumn("rank", n).where("rank <= 10").select("query_id", "rank", "chunk_id", score.alias("score"))


@query(f"with {CHUNKS_SQL} select query_id, rank, chunk_id, round(score, 6) as score from ({_TITLE})")
def title_match_search(spark, d):
    return listed(title_hits(spark, d))


@query(sql(PARAGRAPHS_SQL, f"t as ({_TITLE})", dense_sql("a", 20, "iq"), sparse_sql("b", 20), rrf_sql("f", "a", "b", 20), end="""
, u as (select query_id, chunk_id, score, 0 as list, rank from t union all select query_id, chunk_id, score, 1, rank from f where (query_id, chunk_id) not in (select (query_id, chunk_id) from t)),
o as (select query_id, chunk_id, score, row_number() over (partition by query_id order by list, rank) as pos from u),
cut as (select * from o where pos <= 12 or query_id not in (select query_id from t)),
w as (select cut.*, c.chunk_type, c.parent_id, m.chunk_type as parent_type from cut join chunks c using (chunk_id) left join chunks m on m.chunk_id = c.parent_id),
x as (select query_id, case when chunk_type = 'quote_explanation' then parent_id else chunk_id end as chunk_id, case when chunk_type = 'quote_explanation' then 'quote' else chunk_type end as chunk_type, score, pos
  from w where chunk_type <> 'quote_explanation' or parent_type = 'quote'),
y as (select * from x qualify row_number() over (partition by query_id, chunk_id order by score desc, pos) = 1),
z as (select *, count(*) filter (chunk_type = 'chapter_summary') over (partition by query_id order by pos) as n from y),
low as (select l.chunk_id, p.paragraph_id, p.source_id from l join p using (paragraph_id) where deleted_at is null qualify row_number() over (partition by l.chunk_id order by paragraph_number, paragraph_id) = 1),
nav as (select z.*, c.source_id as own, low.paragraph_id, low.source_id as theirs, z.chunk_type in ('book', 'secondary_book', 'talk', 'quote', 'quote_explanation') as opens
  from z join chunks c using (chunk_id) left join low using (chunk_id) where z.chunk_type <> 'chapter_summary' or n <= 3)
select query_id, pos, chunk_id, chunk_type, round(score, 6) as score, paragraph_id, case when opens then coalesce(theirs, own) else own end as source_id, opens and paragraph_id is null as navigation_error from nav"""))
def app_search(spark, d):
    """Title hits first, hybrid hits behind, explanations swapped for their quotes, best of each chunk, summaries capped;
    with the paragraph that opens, its source, and a mark where one is missing."""
    from ..operators.citations import navigable
    from ..operators.joins import swap_or_drop

    c = chunks(spark, d)
    hybrid = fusion.rrf(dense_retrieve(c, vectors(spark, d), item_vectors(spark, d), 20), sparse_retrieve(c, text_queries(spark, d), 20), 20)
    union = fusion.ordered_union(title_hits(spark, d), hybrid, 12)
    hits = with_payload(union, c, "chunk_type", "parent_id")
    best = ranking.best_hit(swap_or_drop(hits, c), "rank", ["query_id"])
    shown = with_payload(ranking.cap_type(best).drop("source_id"), c, "source_id").withColumn("paragraph_id", F.lit(None).cast("string"))
    opened, links = paragraphs(spark, d)
    return navigable(shown, links, opened).select(
        "query_id", F.col("rank").cast("long").alias("pos"), "chunk_id", "chunk_type", F.round("score", 6).alias("score"), "paragraph_id", "source_id", "navigation_error")


# --- vectors ------------------------------------------------------------------------------------------------


@query("""select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cos, len(a.embedding) = len(b.embedding) as same_dims
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_pair_check(spark, d):
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"), (F.size("embedding") == F.size("other")).alias("same_dims"))


@query("""select vec_id, round(sqrt(list_dot_product(u, u)), 6) as norm, round(u[1], 6) as first from (select vec_id,
  list_transform(embedding::double[], lambda x: x * 3 / (3 * sqrt(list_dot_product(embedding::double[], embedding::double[])))) as u from embeddings)""")
def l2_normalize(spark, d):
    u = V.unit(F.transform("embedding", lambda x: x * 3))
    return table(spark, d, "embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(V.norm(F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("select label, i - 1 as dim, round(avg(v), 6) + 0 as mean from (select label, unnest(embedding::double[]) as v, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by all")
def mean_pool_by_label(spark, d):
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return cells.groupBy("label", F.col("dim").cast("long").alias("dim")).agg((F.round(F.avg(F.col("v").cast("double")), 6) + 0.0).alias("mean"))


# --- requests: by intent, in slots, verified --------------------------------------------------------------------


def corpus(spark, d):
    from ..plans.requests import Corpus

    return Corpus(chunks(spark, d), vectors(spark, d), item_vectors(spark, d), text_queries(spark, d))


_INTENTS = """
rq as (select query_id, ['quelle_suchen', 'erklaerung', 'skip', 'sonstiges', 'other'][query_id // 20 % 5 + 1] as intent, case when query_id // 20 % 3 = 1 then 'src' || (query_id // 20 % 4) end as scope from tq)"""
_TYPES = {"quelle_suchen": None, "erklaerung": "chunk_type in ('book', 'talk', 'chapter_summary', 'secondary_book', 'typology')", "sonstiges": "true"}
_FIRST = [*[dense_sql(f"i_{n}_d", 8, "iq", w) for n, w in _BRANCHES.items()], *[sparse_sql(f"i_{n}_s", 8, w) for n, w in _BRANCHES.items()],
          *[rrf_sql(f"i_{n}", f"i_{n}_d", f"i_{n}_s", 8) for n in _BRANCHES], rrf_sql("f_quelle_suchen", "i_quotes", "i_books", 12)]
for _name, _where in _TYPES.items():
    if _where:
        _FIRST += [dense_sql(f"d_{_name}", 15, "iq", _where), sparse_sql(f"s_{_name}", 15, _where), rrf_sql(f"f_{_name}", f"d_{_name}", f"s_{_name}", 10)]
_LEVEL = "case when count(chunk_id) = 0 then 'insufficient' when count(*) filter (score > 0.7) >= 3 then 'high' when count(chunk_id) >= 2 or count(*) filter (score > 0.5) > 0 then 'medium' else 'low' end"


@query(sql(_INTENTS, *_FIRST, dense_sql("d_all", 25, "iq"), sparse_sql("s_all", 25), rrf_sql("f_all", "d_all", "s_all", 15), end=f"""
, a as (select *, case when intent in ('quelle_suchen', 'erklaerung') then intent else 'sonstiges' end as kind from rq where intent <> 'skip'),
one as (select a.query_id, f.rank, f.chunk_id, f.score from a join ({" union all ".join(f"select *, '{n}' as kind from f_{n}" for n in _TYPES)}) f on f.query_id = a.query_id and f.kind = a.kind
  join chunks c using (chunk_id) where a.scope is null or c.source_id = a.scope),
l1 as (select a.query_id, {_LEVEL} as sufficiency from a left join one on one.query_id = a.query_id group by 1),
two as (select a.query_id, f.rank, f.chunk_id, f.score from a join f_all f on f.query_id = a.query_id join chunks c using (chunk_id)
  where a.query_id in (select query_id from l1 where sufficiency = 'insufficient') and (a.scope is null or c.source_id = a.scope)),
l2 as (select a.query_id, {_LEVEL} as sufficiency from a left join two on two.query_id = a.query_id where a.query_id in (select query_id from l1 where sufficiency = 'insufficient') group by 1),
l as (select query_id, 1 as attempt, sufficiency from l1 where sufficiency <> 'insufficient' union all select query_id, 2, sufficiency from l2)
select l.query_id, attempt, rank, chunk_id, round(score, 6) as score, sufficiency from l left join (from one union all from two) h on h.query_id = l.query_id"""))
def retrieval_by_intent(spark, d):
    """Intents choose the types of the first try; what is insufficient within its source is tried again, wider and untyped."""
    from ..plans.requests import by_intent

    i = F.expr("query_id div 20")
    intent = F.element_at(F.array(*[F.lit(x) for x in ("quelle_suchen", "erklaerung", "skip", "sonstiges", "other")]), (i % 5 + 1).cast("int"))
    asked = text_queries(spark, d).select("query_id", intent.alias("intent"), F.when(i % 3 == 1, F.concat(F.lit("src"), i % 4)).alias("source_id"))
    return by_intent(corpus(spark, d), asked, "Author A").select("query_id", "attempt", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"), "sufficiency")


def _slot_sql(name: str, hits: str, before: str | None, budget: int) -> str:
    start = f"coalesce((select max(n) from {before} b where b.query_id = t.query_id), 0)" if before else "0"
    return f"""
{name}_t as (select query_id, chunk_id, chunk_type, score, rank, {_STRIP} as body from {hits} where {_STRIP} <> ''),
{name}_n as (select *, row_number() over (partition by query_id order by rank) + {start} as n from {name}_t t),
{name}_l as (select *, '[' || n || '] (r: ' || printf('%.4f', round(score, 4)) || ', ' || chunk_type || ') ' || body as line from {name}_n),
{name}_o as (select query_id, '{name}' as slot, n, chunk_id, line from (select *, sum(length(line)) over (partition by query_id order by rank) as upto from {name}_l) where upto <= {budget}),
{name}_all as (from {name}_o{f" union all from {before}" if before else ""})"""


@query(sql(dense_sql("pd", 8, "iq", "chunk_type = 'book'"), sparse_sql("ps", 8, "chunk_type = 'book'"), rrf_sql("pf", "pd", "ps", 8),
           " ph as (select pf.*, c.chunk_type, c.text from pf join chunks c using (chunk_id) where rank <= 6)", _slot_sql("primary", "ph", None, 5000),
           dense_sql("sd", 6, "iq", "chunk_type = 'secondary_book'"), sparse_sql("ss", 6, "chunk_type = 'secondary_book'"), """
sh0 as (select query_id, chunk_id, score, 0 as list, rank from sd where rank <= 4), sh1 as (select query_id, chunk_id, score, 1 as list, rank from ss where (query_id, chunk_id) not in (select (query_id, chunk_id) from sh0)),
sh as (select u.*, c.chunk_type, c.text from (select query_id, chunk_id, score, row_number() over (partition by query_id order by list, rank) as rank from (from sh0 union all from sh1)) u join chunks c using (chunk_id) where rank <= 6)""",
           _slot_sql("secondary", "sh", "primary_all", 5000),
           sparse_sql("qs", 4, "chunk_type in ('quote', 'quote_explanation')"), """
qe as (select *, row_number() over (partition by query_id, parent_id order by rank) as m from qs where chunk_type = 'quote_explanation' and (query_id, parent_id) not in (select (query_id, chunk_id) from qs where chunk_type = 'quote')),
qh as (select query_id, chunk_id, chunk_type, score, rank, text from qs where chunk_type = 'quote' union all
  select query_id, p.chunk_id, 'quote', score, qe.rank, p.text from qe join chunks p on p.chunk_id = qe.parent_id where m = 1 and p.chunk_type = 'quote')""",
           _slot_sql("quotes", "qh", "secondary_all", 5000), end="select query_id, slot, n, chunk_id, sha256(line) as line_sha256 from quotes_all"))
def prompt_slots(spark, d):
    """Three slots of a prompt by different methods, numbered through."""
    from ..plans.requests import Spec
    from ..plans.requests import prompt_slots as plan

    specs = [Spec("primary", "hybrid", ("primary",), k=6, k_retrieve=8), Spec("secondary", "dense+sparse", ("secondary",), k=6), Spec("quotes", "sparse", ("quote", "quote_explanation"), k=4)]
    return plan(corpus(spark, d), specs, 5000).select("query_id", "slot", F.col("n").cast("long").alias("n"), "chunk_id", F.sha2("line", 256).alias("line_sha256"))


@query(sql(dense_sql("a", 4, where="chunk_type = 'book'"), dense_sql("b", 4, where="chunk_type in ('talk', 'talk_summary')"), end="""
select query_id, row_number() over (partition by query_id order by part, rank) as rank, part, chunk_id from (select query_id, 0 as part, rank, chunk_id from a union all select query_id, 1, rank, chunk_id from b)"""))
def quote_sources(spark, d):
    from ..plans.requests import Corpus
    from ..plans.requests import quote_sources as plan

    all_queries = Corpus(chunks(spark, d), vectors(spark, d), vector_queries(spark, d), text_queries(spark, d))
    return plan(all_queries).select("query_id", F.col("rank").cast("long").alias("rank"), "part", "chunk_id")


def _rerank_sql(name: str, hits: str, queries: str, k: int) -> str:
    return f"""
{name} as (select * exclude (rank), row_number() over (partition by query_id order by dt desc, rank) as rank from
  (select h.*, round(list_dot_product(e.embedding::double[], q.qv), 9) as dt from {hits} h join embeddings e on 'doc-' || e.vec_id = h.chunk_id join {queries} q on q.query_id = h.query_id)
  qualify row_number() over (partition by query_id order by dt desc, rank) <= {k})"""


_VERIFIED = "chunk_type = 'book' and author = 'Author A' and source_id in ('src0', 'src8')"


@query(sql(" dq as (select vec_id - 1 as query_id, embedding::double[] as qv from embeddings where (vec_id - 1) in (select query_id from tq))",
           dense_sql("b0", 4, "iq", _VERIFIED), _rerank_sql("b1", "b0", "iq", 3), dense_sql("w0", 12, "iq", _VERIFIED), _rerank_sql("w1", "w0", "iq", 3),
           dense_sql("m0", 4, "dq", _VERIFIED), _rerank_sql("m1", "m0", "dq", 3), end="""
, ok as (select query_id from b1 group by 1 having count(*) >= 3 and sum(length(text)) >= 400)
select query_id, 1 as pass, rank, chunk_id from b1 where query_id in (from ok) union all select query_id, 1, rank, chunk_id from w1 where query_id not in (from ok)
union all select query_id, 2, rank, chunk_id from m1"""))
def verification_two_passes(spark, d):
    """Reranked book hits, widened where they are thin, then those of a second query (the next vector) derived from the first."""
    from ..plans.requests import Corpus, two_passes

    first = corpus(spark, d)
    derived = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("query_id"), "embedding").join(text_queries(spark, d).select("query_id"), "query_id", "left_semi")
    where = filters.payload(book_types=["primary"], author="Author A") & filters.scoped(["src0", "src8"])
    both = two_passes(first, Corpus(first.chunks, first.vectors, derived, first.query_texts), where, 4, 3, 12)
    return both.select("query_id", "pass", F.col("rank").cast("long").alias("rank"), "chunk_id")


@query(sql(dense_sql("h", 10), end="select 'retrieval' as kind, 'dense' as name, count(*) as rows, count(*) filter (rank = 1)::double as queries, count(*) filter (round(score, 6) > 0.2)::double as close from h union all select 'ingestion', 'chunks', count(*), count(embedded_at)::double, count(*) filter (deprecated_at is not null)::double from chunks"))
def run_figures(spark, d):
    """Two runs leave their figures in a table: a retrieval and an ingestion."""
    sink = folder(spark, "figures")
    hits = listed(dense_retrieve(chunks(spark, d), vectors(spark, d), vector_queries(spark, d), 10))
    telemetry.recorded(hits, folder(spark, "hits"), sink, "retrieval", "dense", queries=F.count_if(F.col("rank") == 1), close=F.count_if(F.col("score") > 0.2))
    rows = chunks(spark, d).select("chunk_id", "embedded_at", "deprecated_at")
    telemetry.recorded(rows, folder(spark, "ingested"), sink, "ingestion", "chunks", queries=F.count("embedded_at"), close=F.count("deprecated_at"))
    return spark.read.schema(telemetry.SCHEMA).parquet(sink).select("kind", "name", "rows", F.col("figures")["queries"].alias("queries"), F.col("figures")["close"].alias("close"))


@query(sql(dense_sql("h", 10, "iq"), end="""select tq.query_id, qtext as question, case when string_agg(chunk_id, ' ' order by rank) is null then null else 'Answer ' || tq.query_id end as answer, coalesce(string_agg(chunk_id, ' ' order by rank), '') as refs
  from tq left join h on h.query_id = tq.query_id group by tq.query_id, qtext"""))
def evaluation_records(spark, d):
    """Questions, stub answers and references written as JSON records, and read again."""
    hits = dense_retrieve(chunks(spark, d), vectors(spark, d), item_vectors(spark, d), 10)
    questions, path = text_queries(spark, d).withColumnRenamed("text", "question"), folder(spark, "evaluation")
    answers = hits.select("query_id").distinct().withColumn("answer", F.concat(F.lit("Answer "), "query_id"))
    telemetry.evaluation(questions, answers, hits, path)
    read = spark.read.schema("query_id long, question string, answer string, references array<string>").json(path)
    return read.select("query_id", "question", "answer", F.array_join("references", " ").alias("refs"))


@query("""select vec_id // 8 as matrix_id, round(avg(embedding[1]::double), 6) as first, round(avg(embedding[64]::double), 6) as last, count(*) as rows from embeddings group by 1""")
def mean_pooled_matrices(spark, d):
    """Eight vectors to a matrix, pooled to the mean of its rows."""
    m = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 8").alias("matrix_id")).agg(F.collect_list("embedding").alias("m"))
    pooled = V.mean_pool(F.col("m"))
    return m.select("matrix_id", F.round(F.get(pooled, F.lit(0)), 6).alias("first"), F.round(F.get(pooled, F.lit(63)), 6).alias("last"), F.size("m").cast("long").alias("rows"))
