"""Ingest, merge and cleanup of chunks. The incoming batch is derived from the documents: some texts changed, some rows moved."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import point_id
from ..operators import filters, joins, merge, ranking
from ..registry import query
from ..sources.testdata import CHUNKS_SQL, chunks, table

FIELDS = ["source_id", "source_title", "segment_id", "segment_title", "source_index", "chunk_type", "author", "worldview", "parent_id", "language", "content_hash", "updated_at"]
_BATCH = """
incoming as (select * replace (case when doc_id % 10 = 1 then sha256(text || '!') else content_hash end as content_hash, case when doc_id % 10 = 2 then 'Author Z' else author end as author,
   case when doc_id % 10 = 3 then 'talk' else chunk_type end as chunk_type, case when doc_id % 10 = 4 then 'new-' || doc_id else chunk_id end as chunk_id) from chunks where doc_id % 10 < 6)"""
C = f"with {CHUNKS_SQL} "
B = f"with {CHUNKS_SQL}, {_BATCH} "
NOW = "timestamp '2025-01-01'"


def now():
    return F.expr("timestamp_ntz'2025-01-01 00:00:00'")


def stored(spark, d):
    return chunks(spark, d).select("doc_id", "rag_partition", "chunk_id", "text", *FIELDS, "embedded_at", "deprecated_at")


def incoming(spark, d):
    """A batch: changed hashes, authors and types, new ids, and rows as they were."""
    m = F.col("doc_id") % 10
    return stored(spark, d).where(m < 6).withColumn("content_hash", F.when(m == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("content_hash"))).withColumn(
        "author", F.when(m == 2, "Author Z").otherwise(F.col("author"))).withColumn("chunk_type", F.when(m == 3, "talk").otherwise(F.col("chunk_type"))).withColumn(
        "chunk_id", F.when(m == 4, F.concat(F.lit("new-"), "doc_id")).otherwise(F.col("chunk_id")))


@query(C + "select doc_id, chunk_id from chunks qualify row_number() over (partition by content_hash order by updated_at desc nulls last, source_id) = 1")
def chunk_dedupe_latest(spark, d):
    return ranking.first_per(chunks(spark, d), ["content_hash"], F.desc_nulls_last("updated_at"), F.asc_nulls_last("source_id")).select("doc_id", "chunk_id")


@query(C + ", b as (select content_hash as chunk_id, case when doc_id % 2 = 0 then updated_at end as updated_at, doc_id as pos from chunks) select chunk_id, pos from b qualify row_number() over (partition by chunk_id order by updated_at desc nulls last, pos) = 1")
def batch_dedupe_first(spark, d):
    b = chunks(spark, d).select(F.col("content_hash").alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, F.col("updated_at")).alias("updated_at"), F.col("doc_id").alias("pos"))
    return ranking.batch_first(b, ["chunk_id"]).select("chunk_id", "pos")


@query(C + ", h as (select content_hash as chunk_id, (doc_id * 7919) % 1000 / 1000.0::double as score, doc_id as rank from chunks) select chunk_id, score, rank from h qualify row_number() over (partition by chunk_id order by score desc, rank) = 1")
def chunk_dedupe_best_score(spark, d):
    h = chunks(spark, d).select(F.col("content_hash").alias("chunk_id"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("score"), F.col("doc_id").alias("rank"))
    return ranking.best_hit(h).select("chunk_id", "score", "rank")


@query(C + """, b as (select doc_id % 50 as chunk_id, case when doc_id % 100 < 50 then sha256(source_id) else content_hash end as content_hash from chunks)
  select count(*) as requested, count(distinct (chunk_id, content_hash)) as kept, count(*) - count(distinct (chunk_id, content_hash)) as duplicates from b""")
def exact_duplicate_counts(spark, d):
    i = F.col("doc_id")
    b = chunks(spark, d).select((i % 50).alias("chunk_id"), F.when(i % 100 < 50, F.sha2("source_id", 256)).otherwise(F.col("content_hash")).alias("content_hash"), i.alias("pos"))
    return ranking.exact_duplicates(b)[1]


@query(B + """, m as (select coalesce(s.rag_partition, i.rag_partition) as rag_partition, coalesce(s.chunk_id, i.chunk_id) as chunk_id, s.chunk_id is null as fresh, i.chunk_id is null as gone, s.content_hash is distinct from i.content_hash as rehashed,
   (s.content_hash is distinct from i.content_hash or s.author is distinct from i.author or s.chunk_type is distinct from i.chunk_type or s.deprecated_at is not null) as differs,
   i.content_hash as ih, s.content_hash as sh, s.embedded_at as se, s.deprecated_at as sd, s.updated_at as su
   from chunks s full join incoming i on s.rag_partition = i.rag_partition and s.chunk_id = i.chunk_id),
 a as (select *, case when fresh then 'inserted' when gone then 'kept' when differs then 'updated' else 'kept' end as action from m)
 select rag_partition, chunk_id, case when action = 'kept' then sh else ih end as content_hash, case when action = 'kept' then su else """ + NOW + """ end as updated_at,
   case when action = 'kept' or (action = 'updated' and not rehashed) then se end as embedded_at, case when action = 'kept' then sd end as deprecated_at, action from a""")
def chunk_conditional_upsert(spark, d):
    s, b = stored(spark, d).drop("doc_id", "text"), incoming(spark, d).drop("doc_id", "text", "embedded_at", "deprecated_at")
    return merge.upsert(s, b, now()).select("rag_partition", "chunk_id", "content_hash", "updated_at", "embedded_at", "deprecated_at", "action")


_CHANGE = """, k as (select i.*, case when s.chunk_id is null then 'new' when s.content_hash is distinct from i.content_hash then 'changed_embed'
   when s.chunk_type = i.chunk_type and s.author is not distinct from i.author and i.doc_id % 30 <> 5 and i.doc_id % 60 <> 15 then 'unchanged' else 'payload_only' end as change
   from incoming i left join chunks s on s.chunk_id = i.chunk_id) """


def _searchable(rows, batch=False):
    """The other search keys; in the batch some venues and paragraphs have changed, and worldviews, which are no search key."""
    moved = lambda n, m: F.col("doc_id") % n == m if batch else F.lit(False)
    return rows.withColumns({
        "book_title": F.col("source_title"), "source_type": F.lit("book"), "venue": F.when(moved(30, 5), "Berlin"), "lecture_date": F.lit("1904-01-01"), "vortragstitel": F.lit(None).cast("string"),
        "lecture_id": F.lit(None).cast("string"), "body_source_id": F.col("source_id"), "paragraph_id": F.concat(F.lit("p-"), "doc_id"),
        "paragraph": F.col("doc_id") % 17 + F.when(moved(60, 15), 1).otherwise(0), "worldview": F.when(moved(10, 0), "Realismus").otherwise(F.col("worldview"))})


def _changes(spark, d):
    return merge.classify(_searchable(incoming(spark, d), batch=True), _searchable(stored(spark, d)))


@query(B + _CHANGE + "select chunk_id, change from k")
def chunk_classify_changes(spark, d):
    return _changes(spark, d).select("chunk_id", "change")


@query(B + _CHANGE + "select count(*) as requested, " + ", ".join(f"count(*) filter (change = '{c}') as {c}" for c in ("new", "changed_embed", "payload_only", "unchanged")) + " from k")
def ingest_report(spark, d):
    return merge.ingest_report(_changes(spark, d))


@query(C + """select chunk_id, source_id from chunks c where deprecated_at is null and source_id in (select source_id from chunks where doc_id % 3 > 0)
  and (source_id, chunk_id) not in (select (source_id, chunk_id) from chunks where doc_id % 3 > 0)""")
def orphan_chunks(spark, d):
    s = stored(spark, d)
    return merge.orphans(s, s.where("doc_id % 3 > 0")).select("chunk_id", "source_id")


@query(C + f"select chunk_id, case when doc_id % 10 < 6 and deprecated_at is null then {NOW} else deprecated_at end as deprecated_at from chunks")
def explicit_deprecation(spark, d):
    s = stored(spark, d)
    return merge.deprecate(s, s.where("doc_id % 10 < 6"), now()).select("chunk_id", "deprecated_at")


@query(C + f"select chunk_id, case when doc_id % 4 = 0 then {NOW} else embedded_at end as embedded_at from chunks")
def mark_embedded(spark, d):
    s = stored(spark, d)
    return merge.mark_embedded(s, s.where("doc_id % 4 = 0"), now()).select("chunk_id", "embedded_at")


@query(C + """select chunk_id from chunks where (source_id, chunk_type) in (select (source_id, chunk_type) from chunks where deprecated_at is null and chunk_type in ('book', 'quote'))
  and deprecated_at is not null""")
def stale_vectors(spark, d):
    s = stored(spark, d)
    live = s.where(filters.active())
    return merge.stale_points(s, live, live.where(F.col("chunk_type").isin("book", "quote"))).select("chunk_id")


@query(C + "select chunk_id, case when doc_id % 10 < 3 then 'replaced' else 'stored' end as version from chunks")
def mirror_replace(spark, d):
    s = stored(spark, d).select("chunk_id", F.lit("stored").alias("version"), "doc_id")
    return merge.replace_keys(s, s.where("doc_id % 10 < 3").withColumn("version", F.lit("replaced")), ["chunk_id"]).drop("doc_id")


@query(C + "select chunk_id, case when doc_id % 10 = 2 then 'Author Z' else author end as author, content_hash from chunks")
def payload_update(spark, d):
    s = stored(spark, d)
    return merge.set_payload(s, s.where("doc_id % 10 = 2").select("chunk_id", F.lit("Author Z").alias("author")), ["author"]).select("chunk_id", "author", "content_hash")


@query(C + "select chunk_id from chunks where not (chunk_id like 'doc-1%' and rag_partition = 'main')")
def delete_by_prefix(spark, d):
    s = stored(spark, d)
    gone = s.where(filters.id_prefix("chunk_id", "doc-1%") & (F.col("rag_partition") == "main"))
    return s.join(gone.select("rag_partition", "chunk_id"), ["rag_partition", "chunk_id"], "left_anti").select("chunk_id")


@query(C + "select chunk_id, case when chunk_type = 'book' and doc_id % 2 = 0 then 'talk' else chunk_type end as chunk_type from chunks")
def embed_type_override(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "lecture").otherwise("article")
    return chunks(spark, d).select("chunk_id", merge.embed_type(F.col("chunk_type"), kind, F.lit("talk")).alias("chunk_type"))


@query(C + "select doc_id, case when doc_id % 3 = 0 then 'book' when doc_id % 3 = 1 then language else 'book' end as source_type from chunks")
def source_type_resolution(spark, d):
    own = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "language")).when(F.col("doc_id") % 3 == 2, "  ")
    return chunks(spark, d).select("doc_id", merge.resolve_source_type(own, F.lit("book ")).alias("source_type"))


@query(C + ", h as (select 'doc-' || vec_id as chunk_id from embeddings where vec_id % 20 = 0) select c.chunk_id, text from chunks c where chunk_id in (from h)")
def point_lookup(spark, d):
    ids = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.concat(F.lit("doc-"), "vec_id").alias("chunk_id"))
    return chunks(spark, d).join(ids, "chunk_id", "left_semi").select("chunk_id", "text")


@query(C + "select chunk_id from chunks where chunk_id > 'doc-3' and source_id = 'src3' order by chunk_id limit 25")
def point_page(spark, d):
    """The page after a cursor: keyset, not offset, so a page costs the same wherever it lies."""
    return chunks(spark, d).where((F.col("chunk_id") > "doc-3") & filters.source("src3")).select("chunk_id").orderBy("chunk_id").limit(25)


@query(C + ", w as (select unnest(['doc-7', 'doc-3', 'doc-150', 'doc-7x', 'doc-11']) as chunk_id, unnest(range(0, 5)) as pos) select chunk_id, pos from w join chunks using (chunk_id)")
def ordered_lookup(spark, d):
    wanted = spark.createDataFrame([(["doc-7", "doc-3", "doc-150", "doc-7x", "doc-11"],)], "ids array<string>").select(F.posexplode("ids").alias("pos", "chunk_id"))
    return chunks(spark, d).join(F.broadcast(wanted), "chunk_id").select("chunk_id", F.col("pos").cast("long").alias("pos")).orderBy("pos")


# --- explanations, paragraphs, terms ------------------------------------------------------------------------

_HITS = ", h as (select 0 as query_id, chunk_id, chunk_type, parent_id, doc_id as rank, (doc_id % 100)::double as score from chunks where chunk_type in ('quote', 'quote_explanation', 'book'))"


def _hits(spark, d):
    return chunks(spark, d).where("chunk_type in ('quote', 'quote_explanation', 'book')").select(
        F.lit(0).alias("query_id"), "chunk_id", "chunk_type", "parent_id", F.col("doc_id").alias("rank"), (F.col("doc_id") % 100).cast("double").alias("score"))


@query(C + _HITS + """, s as (select case when h.chunk_type = 'quote_explanation' then h.parent_id else h.chunk_id end as chunk_id, h.rank, h.score from h left join chunks p on p.chunk_id = h.parent_id
  where h.chunk_type <> 'quote_explanation' or p.chunk_type = 'quote') select chunk_id, rank, score from s qualify row_number() over (partition by chunk_id order by score desc, rank) = 1""")
def quote_parent_swap(spark, d):
    return ranking.best_hit(joins.swap_or_drop(_hits(spark, d), chunks(spark, d))).select("chunk_id", "rank", "score")


@query(C + """, h as (select doc_id // 40 as query_id, chunk_id, case when doc_id % 9 > 6 then 'quote_explanation' else chunk_type end as chunk_type, case when doc_id % 9 > 6 then 'doc-' || (doc_id - doc_id % 9 + 6) end as parent_id, doc_id as rank
    from chunks where doc_id % 9 in (0, 7, 8) or (doc_id % 9 = 6 and doc_id % 5 = 0)),
  e as (select *, row_number() over (partition by query_id, parent_id order by rank) as n from h where chunk_type = 'quote_explanation' and (query_id, parent_id) not in (select (query_id, chunk_id) from h where chunk_type <> 'quote_explanation'))
  select query_id, chunk_id, rank from h where chunk_type <> 'quote_explanation' union all select query_id, p.chunk_id, e.rank from e join chunks p on p.chunk_id = e.parent_id where n = 1 and p.chunk_type = 'quote'""")
def quote_parent_swap_once(spark, d):
    """Two explanations of each quote: the second goes, and both do where the quote is a hit of the query itself."""
    m = F.col("doc_id") % 9
    explains = m > 6
    hits = chunks(spark, d).where(m.isin(0, 7, 8) | ((m == 6) & (F.col("doc_id") % 5 == 0))).select(
        F.expr("doc_id div 40").alias("query_id"), "chunk_id", F.when(explains, "quote_explanation").otherwise(F.col("chunk_type")).alias("chunk_type"),
        F.when(explains, F.concat(F.lit("doc-"), F.col("doc_id") - m + 6)).alias("parent_id"), F.col("doc_id").alias("rank"))
    return joins.swap_once(hits, chunks(spark, d)).select("query_id", "chunk_id", "rank")


@query(C + _HITS + "select coalesce(case when h.chunk_type = 'quote_explanation' then p.chunk_id end, h.chunk_id) as chunk_id, h.rank from h left join chunks p on p.chunk_id = h.parent_id")
def quote_parent_swap_keep(spark, d):
    return joins.swap_or_keep(_hits(spark, d), chunks(spark, d)).select("chunk_id", "rank")


@query(C + "select c.chunk_id as chunk_id, p.chunk_id as parent_id from chunks c join chunks p on p.chunk_id = c.parent_id where c.deprecated_at is null and p.deprecated_at is null and p.chunk_type = 'quote'")
def explanation_parents(spark, d):
    c = chunks(spark, d).where(filters.active())
    p = c.where("chunk_type = 'quote'").select(F.col("chunk_id").alias("pid"))
    return c.select("chunk_id", "parent_id").join(p, F.col("parent_id") == F.col("pid")).select("chunk_id", "parent_id")


@query(C + """, p as (select 'p-' || doc_id as paragraph_id, doc_id % 17 as paragraph_number, case when doc_id % 11 = 0 then timestamp '2024-06-01' end as deleted_at, doc_id from chunks),
  l as (select 'doc-' || (doc_id - doc_id % 5) as chunk_id, 'p-' || doc_id as paragraph_id from chunks)
  select chunk_id, paragraph_id, paragraph_number from l join p using (paragraph_id) where deleted_at is null qualify row_number() over (partition by chunk_id order by paragraph_number, paragraph_id) = 1""")
def paragraph_lookup(spark, d):
    c = chunks(spark, d).select("doc_id")
    paragraphs = c.select(F.concat(F.lit("p-"), "doc_id").alias("paragraph_id"), (F.col("doc_id") % 17).alias("paragraph_number"), F.when(F.col("doc_id") % 11 == 0, now()).alias("deleted_at"))
    links = c.select(F.concat(F.lit("doc-"), F.col("doc_id") - F.col("doc_id") % 5).alias("chunk_id"), F.concat(F.lit("p-"), "doc_id").alias("paragraph_id"))
    return joins.lowest_paragraph(links, paragraphs)


@query(C + """, a as (select segment_id, 10 as max_index from chunks where source_index = 10 and deprecated_at is null group by 1),
  r as (select c.segment_id, source_index, chunk_id, source_index - max_index as off, row_number() over (partition by c.segment_id order by source_index) as n from chunks c join a using (segment_id) where deprecated_at is null and source_index > 10)
  select segment_id, source_index, chunk_id from r where off = n""")
def consecutive_chain(spark, d):
    c = chunks(spark, d).where(filters.active())
    anchors = c.where("source_index = 10").select("segment_id", F.lit(10).alias("max_index"))
    return ranking.continuation(c, anchors).select("segment_id", "source_index", "chunk_id")


@query(C + r""", t as (select chunk_id, segment_id, lower(regexp_extract(text, '([\p{L}]{6,})', 1)) as term from chunks where chunk_type = 'begriff'), q as (select doc_id as query_id, text as prompt from documents where doc_id % 20 = 0)
  select query_id, segment_id, chunk_id, term from (select *, row_number() over (partition by query_id order by length(term) desc, term, chunk_id) as n from
   (select *, row_number() over (partition by query_id, segment_id order by length(term) desc, term, chunk_id) as m from q join t on term <> '' and contains(lower(prompt), term)) where m = 1) where n <= 5""")
def term_containment(spark, d):
    terms = chunks(spark, d).where("chunk_type = 'begriff'").select("chunk_id", "segment_id", F.lower(F.regexp_extract("text", r"([\p{L}]{6,})", 1)).alias("term")).where("term != ''")
    prompts = table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("prompt"))
    return ranking.one_per_segment(joins.term_hits(prompts, joins.capped_terms(terms, 5)), 5, "query_id").select("query_id", "segment_id", "chunk_id", "term")


@query(C + r""", t as (select lower(regexp_extract(text, '([\p{L}]+)', 1)) as lemma, chunk_id from chunks where chunk_type = 'begriff'),
  w as (select query_id, unnest(range(0, len(ws))) as pos, unnest(ws) as w from (select item_id as query_id, regexp_extract_all(lower(text), '[\p{L}]+') as ws from benchmark where item_id % 20 = 0)),
  f as (select query_id, pos, 0 as form, w as lemma from w where length(w) >= 3 union all select query_id, pos, 1, left(w, length(w) - 2) from w where length(w) > 3 and ends_with(w, 'en')),
  x as (select * from f join t using (lemma) qualify row_number() over (partition by query_id, pos order by form, chunk_id) = 1),
  y as (select * from x qualify row_number() over (partition by query_id, chunk_id order by pos) = 1)
  select query_id, pos, lemma, chunk_id from (select *, row_number() over (partition by query_id order by pos) as n from y) where n <= 10""")
def lemma_match(spark, d):
    lemmas = chunks(spark, d).where("chunk_type = 'begriff'").select(F.lower(F.regexp_extract("text", r"([\p{L}]+)", 1)).alias("lemma"), "chunk_id")
    prompts = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("prompt"))
    return joins.lemma_matches(prompts, lemmas).select("query_id", F.col("pos").cast("long").alias("pos"), "lemma", "chunk_id")


@query(C + r""", p as (select 'p-' || doc_id as paragraph_id, case when doc_id % 3 = 0 then chunk_id else 'x' || doc_id end as chunk_id, case when doc_id % 3 = 1 then content_hash else 'x' || doc_id end as content_hash, segment_id,
   trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '\[[^\]]*\]', '', 'g')), '\s+', ' ', 'g')) as norm from chunks),
  q as (select chunk_id as quote_id, chunk_id, content_hash, segment_id, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '\[[^\]]*\]', '', 'g')), '\s+', ' ', 'g')) as norm from chunks where chunk_type = 'quote'),
  a as (select chunk_id, min(paragraph_id) as a from p group by 1 having count(*) = 1), b as (select content_hash, min(paragraph_id) as b from p group by 1 having count(*) = 1),
  c as (select segment_id, norm, min(paragraph_id) as c from p group by 1, 2 having count(*) = 1),
  e as (select quote_id, min(paragraph_id) as d from q join p using (segment_id) where q.norm <> '' and p.norm <> '' and (contains(p.norm, q.norm) or contains(q.norm, p.norm))
    and (segment_id, q.norm) not in (select (segment_id, norm) from p) group by 1 having count(*) = 1)
  select quote_id, coalesce(a, b, c, d) as paragraph_id, case when a is not null then 'chunk_id' when b is not null then 'content_hash' when c is not null then 'text' when d is not null then 'part' end as how
  from q left join a using (chunk_id) left join b using (content_hash) left join c using (segment_id, norm) left join e using (quote_id)""")
def quote_match_cascade(spark, d):
    c = chunks(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    x = F.concat(F.lit("x"), "doc_id")
    paragraphs = c.select(F.concat(F.lit("p-"), "doc_id").alias("paragraph_id"), F.when(F.col("doc_id") % 3 == 0, F.col("chunk_id")).otherwise(x).alias("chunk_id"),
                          F.when(F.col("doc_id") % 3 == 1, F.col("content_hash")).otherwise(x).alias("content_hash"), "segment_id", "text")
    return joins.match_quotes(c.where("chunk_type = 'quote'").select(F.col("chunk_id").alias("quote_id"), "chunk_id", "content_hash", "segment_id", "text"), paragraphs)


@query(C + ", f as (select case when not coalesce(chunk_type in ('book', 'quote', 'talk'), false) then 'type' when not coalesce(lower(author) = 'author a', false) then 'author' when not coalesce(source_id in ('src1', 'src10', 'src11', 'src0', 'src4', 'src8'), false) then 'source' when not starts_with(source_title, 'Volume 1') then 'title' else 'kept' end as stage from chunks) select stage, count(*) as n from f group by 1")
def filter_drop_diagnostics(spark, d):
    stage = filters.first_failure(["book", "quote", "talk"], "Author_A", ["src1", "src10", "src11", "src0", "src4", "src8"], "x#Volume_1#3")
    return chunks(spark, d).select(stage.alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query(C + """, h as (select chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) as h from chunks)
  select chunk_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) as point_id from h""")
def uuid5_point_ids(spark, d):
    return chunks(spark, d).select("chunk_id", point_id(F.col("chunk_id")).alias("point_id"))


@query(C + """, m as (select chunk_id, source_id, chunk_type from chunks where doc_id % 5 <> 0), k as (
  select 'filter' as request, (select count(*) from m where chunk_type = 'talk') as matched, (select count(*) from m where chunk_type <> 'talk') as mirror, (select count(*) from chunks where not (chunk_type = 'talk' and doc_id % 5 <> 0)) as points
  union all select 'prefix', (select count(*) from m where source_id like 'src1%'), (select count(*) from m where source_id not like 'src1%'), (select count(*) from chunks where not (source_id like 'src1%' and doc_id % 5 <> 0))
  union all select 'dry', (select count(*) from m), (select count(*) from m), (select count(*) from chunks)
  union all select 'fallback', (select count(*) from chunks where chunk_type = 'quote'), 0, (select count(*) from chunks where chunk_type <> 'quote')
  union all select 'limit', null, (select count(*) from m), (select count(*) from chunks))
  select request, matched, case when request = 'dry' then 0 else matched end as deleted, mirror, points from k""")
def guarded_delete(spark, d):
    """Deletes by filter and by prefix, a dry run, one that only the points know of, and one over its limit, which changes nothing."""
    points = stored(spark, d)
    mirror = points.where("doc_id % 5 <> 0")
    requests = {
        "filter": dict(where=F.col("chunk_type") == "talk"), "prefix": dict(prefix="src1"), "dry": dict(everything=True, dry_run=True),
        "fallback": dict(where=F.col("chunk_type") == "quote", mirror=mirror.where("chunk_type <> 'quote'").limit(0)), "limit": dict(everything=True, limit=3)}
    out = None
    for name, how in requests.items():
        own = how.pop("mirror", mirror)
        try:
            done = merge.delete_guarded(own, points, **how)
        except ValueError:
            done = merge.GuardedDelete(own, points, None, None)
        n = lambda df, c: df.agg(F.count("*").alias(c))
        row = n(done.mirror, "mirror").crossJoin(n(done.points, "points")).select(  # one row each
            F.lit(name).alias("request"), F.lit(done.matched).cast("long").alias("matched"), F.lit(done.deleted).cast("long").alias("deleted"), "mirror", "points")
        out = row if out is None else out.unionByName(row)
    return out
