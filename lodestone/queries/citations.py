"""What is shown of hits, with references and paragraphs, over the documents as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citations as Z
from ..operators import joins, merge, ranking, talks
from ..registry import query
from ..sources.testdata import CHUNKS_SQL, chunks, table

#: Chunks with the fields that projections choose between; some are missing, blank, equal or of a wrong type.
_META = """meta as (select * replace (case when doc_id % 5 = 0 then ' Philo von Freisinn ' else author end as author, case when doc_id % 7 = 0 then source_title || ' ' else segment_title end as segment_title,
    case when doc_id % 3 > 0 then source_index end as source_index, case when doc_id % 9 in (2, 7) then 'doc-' || (doc_id - 1) when doc_id % 9 = 5 then '  ' end as parent_id),
  case doc_id % 6 when 0 then 'Band ' || doc_id % 4 when 1 then '' end as book_title, (doc_id % 50)::int as segment_index,
  case doc_id % 4 when 0 then (doc_id % 17)::varchar when 1 then 'x' end as paragraph, case when doc_id % 3 = 0 then ' p-' || doc_id || ' ' when doc_id % 3 = 1 then '' end as paragraph_id,
  case when doc_id % 2 = 0 then doc_id % 10 end as span_start, case when doc_id % 3 = 0 then doc_id % 10 + 5 end as span_end, case when doc_id % 4 > 0 then doc_id % 4 = 1 end as quote_verified from chunks)"""
M = f"with {CHUNKS_SQL}, {_META} "
C = f"with {CHUNKS_SQL} "


def meta(spark, d):
    i = F.col("doc_id")
    c = chunks(spark, d)
    return c.withColumns({
        "author": F.when(i % 5 == 0, " Philo von Freisinn ").otherwise(F.col("author")), "segment_title": F.when(i % 7 == 0, F.concat("source_title", F.lit(" "))).otherwise(F.col("segment_title")),
        "source_index": F.when(i % 3 > 0, F.col("source_index")), "parent_id": F.when((i % 9).isin(2, 7), F.concat(F.lit("doc-"), i - 1)).when(i % 9 == 5, "  "),
        "book_title": F.when(i % 6 == 0, F.concat(F.lit("Band "), i % 4)).when(i % 6 == 1, ""), "segment_index": (i % 50).cast("int"),
        "paragraph": F.when(i % 4 == 0, (i % 17).cast("string")).when(i % 4 == 1, "x"), "paragraph_id": F.when(i % 3 == 0, F.concat(F.lit(" p-"), i, F.lit(" "))).when(i % 3 == 1, ""),
        "quote_span": F.struct(F.when(i % 2 == 0, i % 10).alias("start"), F.when(i % 3 == 0, i % 10 + 5).alias("end")), "quote_verified": F.when(i % 4 > 0, i % 4 == 1)})


_BOOK = """coalesce(nullif(book_title, ''), case when trim(source_title) <> '' and trim(segment_title) <> '' and trim(source_title) <> trim(segment_title) then trim(source_title) end)"""


@query(M + f"""select chunk_id, source_id, segment_id, coalesce({_BOOK}, source_title) as title, {_BOOK} as book_title, segment_title,
   case when length(line) <= 240 then line else regexp_replace(left(line, 239), '\\s+$', '') || '…' end as snippet, chunk_type,
   case when lower(trim(author)) = 'philo von freisinn' then null else author end as author, case when chunk_type = 'chapter_summary' then nullif(trim(parent_id), '') end as parent_id,
   case when chunk_type = 'chapter_summary' then coalesce(source_index, segment_index) end as source_index, case when chunk_type like 'quote%' then text end as quote_text,
   case when chunk_type like 'quote%' then author end as quote_author from (select *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') as line from meta)""")
def flat_results(spark, d):
    return Z.flat_results(meta(spark, d))


@query(M + """select chunk_id, coalesce(source_id, '') as source_id, coalesce(source_title, '') as source_title, coalesce(segment_title, '') as segment_title, '' as lecture_date, coalesce(chunk_type, '') as chunk_type,
  '' as source_type, coalesce(author, '') as author, coalesce(book_title, '') as book_title, '' as venue, '' as vortragstitel, coalesce(paragraph_id, '') as paragraph_id, coalesce(parent_id, '') as parent_id, segment_index from meta""")
def citation_projection(spark, d):
    return Z.citation_fields(meta(spark, d))


@query(M + "select chunk_id, source_id, source_title, segment_title, chunk_type, coalesce(author, '') as author from meta")
def provenance_projection(spark, d):
    return Z.provenance(meta(spark, d))


@query(M + """select chunk_id, try_cast(paragraph as int) as paragraph_number, nullif(trim(paragraph_id), '') as paragraph_id, case when span_end is not null and span_start is not null then span_start end as span_start,
  case when span_end is not null and span_start is not null then span_end end as span_end, quote_verified from meta where chunk_type like 'quote%'""")
def quote_navigation(spark, d):
    return Z.quote_navigation(meta(spark, d).where("chunk_type like 'quote%'")).select(
        "chunk_id", "paragraph_number", "paragraph_id", F.col("quote_span.start").alias("span_start"), F.col("quote_span.end").alias("span_end"), "quote_verified")


@query(M + "select distinct source_id, case when coalesce(author, '') <> '' and book_title <> '' then author || ': ' || book_title when book_title <> '' then book_title else coalesce(author, '') end as name from meta")
def source_display_names(spark, d):
    return meta(spark, d).select("source_id", Z.display_name(F.col("author"), F.col("book_title")).alias("name")).distinct()


PARAGRAPHS_SQL = """p as (select 'p-' || doc_id as paragraph_id, (doc_id % 17)::int as paragraph_number, 'book-' || doc_id % 3 as source_id, case when doc_id % 11 = 0 then timestamp '2024-06-01' end as deleted_at from chunks),
  l as (select 'doc-' || (doc_id - doc_id % 5) as chunk_id, 'p-' || doc_id as paragraph_id from chunks where doc_id % 3 > 0)"""


def paragraphs(spark, d):
    c, i = chunks(spark, d), F.col("doc_id")
    p = c.select(F.concat(F.lit("p-"), i).alias("paragraph_id"), (i % 17).cast("int").alias("paragraph_number"), F.concat(F.lit("book-"), i % 3).alias("source_id"),
                 F.when(i % 11 == 0, F.expr("timestamp_ntz'2024-06-01 00:00:00'")).alias("deleted_at"))
    return p, c.where("doc_id % 3 > 0").select(F.concat(F.lit("doc-"), i - i % 5).alias("chunk_id"), F.concat(F.lit("p-"), i).alias("paragraph_id"))


@query(M + ", " + PARAGRAPHS_SQL + """, low as (select chunk_id, paragraph_id from l join p using (paragraph_id) where deleted_at is null qualify row_number() over (partition by chunk_id order by paragraph_number, paragraph_id) = 1),
  h as (select m.chunk_id, chunk_type, m.source_id, coalesce(nullif(trim(m.paragraph_id), ''), low.paragraph_id) as paragraph_id, chunk_type in ('book', 'secondary_book', 'talk', 'quote', 'quote_explanation') as opens from meta m left join low using (chunk_id))
  select chunk_id, chunk_type, case when opens then coalesce(p.source_id, h.source_id) else h.source_id end as source_id, h.paragraph_id, opens and h.paragraph_id is null as navigation_error
  from h left join p on p.paragraph_id = h.paragraph_id and p.deleted_at is null""")
def search_navigation(spark, d):
    p, links = paragraphs(spark, d)
    hits = meta(spark, d).select("chunk_id", "chunk_type", "source_id", "paragraph_id")
    return Z.navigable(hits, links, p).select("chunk_id", "chunk_type", "source_id", "paragraph_id", "navigation_error")


@query(C + """, t as (select * replace (case when doc_id % 4 = 1 then (doc_id % 9) || '| ' || text when doc_id % 4 = 2 then 'x' || chr(10) || chr(10) || (doc_id % 9) || '|' || text else text end as text) from chunks),
  q as (select doc_id as query_id, source_id, segment_id, case when doc_id % 2 = 0 then (doc_id // 20 % 9)::int end as paragraph from chunks where doc_id % 20 = 0),
  r as (select query_id, chunk_id, source_index, paragraph is null or regexp_matches(text, '(^|\\n\\n)' || paragraph || '\\|') as holds from q join t using (source_id, segment_id) where rag_partition = 'main' or chunk_type in ('book', 'secondary_book'))
  select query_id, chunk_id, source_index, not found as fallback from (select *, max(holds) over (partition by query_id) as found from r) where holds or not found""")
def paragraph_context(spark, d):
    i = F.col("doc_id")
    c = chunks(spark, d)
    marked = c.withColumn("text", F.when(i % 4 == 1, F.concat(i % 9, F.lit("| "), "text")).when(i % 4 == 2, F.concat(F.lit("x\n\n"), i % 9, F.lit("|"), "text")).otherwise(F.col("text")))
    wanted = c.where("doc_id % 20 = 0").select(i.alias("query_id"), "source_id", "segment_id", F.when(i % 2 == 0, F.expr("doc_id div 20 % 9").cast("int")).alias("paragraph"))
    return Z.paragraph_context(wanted, marked, "main")


@query(C + """, v as (select chunk_id, rag_partition, updated_at, deprecated_at from chunks union all select chunk_id, 'other', updated_at + interval 1 day, deprecated_at from chunks where doc_id % 2 = 0),
  w as (select 'doc-' || doc_id as wanted_id from chunks where doc_id % 20 = 4 union all select 'main:doc-' || doc_id from chunks where doc_id % 20 = 5)
  select wanted_id, v.chunk_id, rag_partition from w join v on v.chunk_id = split_part(wanted_id, ':', -1) where deprecated_at is null qualify row_number() over (partition by wanted_id order by updated_at desc, rag_partition) = 1""")
def latest_chunk(spark, d):
    c = chunks(spark, d)
    later = c.where("doc_id % 2 = 0").withColumn("rag_partition", F.lit("other")).withColumn("updated_at", F.expr("updated_at + interval 1 day"))
    fields = ["chunk_id", "rag_partition", "updated_at", "deprecated_at"]
    wanted = c.where("doc_id % 20 = 4").select(F.concat(F.lit("doc-"), "doc_id").alias("wanted_id")).union(c.where("doc_id % 20 = 5").select(F.concat(F.lit("main:doc-"), "doc_id")))
    return Z.latest_chunk(wanted, c.select(*fields).union(later.select(*fields)))


@query(M + """, ev as (select doc_id // 10 as query_id, chunk_id, case when doc_id % 4 = 0 then 'about ' || doc_id when doc_id % 4 = 2 then '' end as description, case when doc_id % 3 = 0 then doc_id % 100 / 100.0::double end as relevance from chunks where doc_id % 5 = 0),
  ci as (select doc_id // 10 as query_id, chunk_id from chunks where doc_id % 4 = 0), sc as (select doc_id // 10 as query_id, chunk_id, doc_id % 10 / 10.0::double as score from chunks where doc_id % 2 = 0),
  k as (select query_id, chunk_id from ev union select query_id, chunk_id from ci)
  select query_id, k.chunk_id, coalesce(nullif(description, ''), nullif(m.segment_title, ''), nullif(m.source_title, ''), '') as description, coalesce(relevance, score, 0.5) as relevance,
    coalesce(nullif(s.source_title, ''), m.source_title) as source_title, coalesce(nullif(s.segment_title, ''), m.segment_title) as segment_title, coalesce(s.author, m.author, '') as author,
    left(coalesce(s.text, ''), 500) as text, ci.chunk_id is not null as cited
  from k left join ev using (query_id, chunk_id) left join ci using (query_id, chunk_id) left join sc using (query_id, chunk_id) join meta m on m.chunk_id = k.chunk_id
  left join (select * from chunks where doc_id % 20 > 0) s on s.chunk_id = k.chunk_id""")
def reference_enrichment(spark, d):
    c, i = chunks(spark, d), F.col("doc_id")
    q = F.expr("doc_id div 10").alias("query_id")
    evaluated = c.where("doc_id % 5 = 0").select(q, "chunk_id", F.when(i % 4 == 0, F.concat(F.lit("about "), i)).when(i % 4 == 2, "").alias("description"), F.when(i % 3 == 0, i % 100 / 100.0).alias("relevance"))
    return Z.enrich_references(evaluated, c.where("doc_id % 4 = 0").select(q, "chunk_id"), c.where("doc_id % 20 > 0"), meta(spark, d), c.where("doc_id % 2 = 0").select(q, "chunk_id", (i % 10 / 10.0).alias("score")))


@query(C + """, a as (select doc_id as query_id, 'See [1] and [' || (doc_id % 7 + 1) || '], not [99] or [x]. ' || left(coalesce(text, ''), 80) as answer from chunks where doc_id % 20 = 0),
  n as (select query_id, unnest(regexp_extract_all(answer, '\\[(\\d{1,6})\\]', 1))::int as n from a), e as (select doc_id // 20 * 20 as query_id, (doc_id % 20)::int as n, chunk_id, chunk_type from chunks),
  r as (select chunk_id as talk_id, 'doc-' || (doc_id + 1) as chunk_id from chunks where chunk_type = 'talk' union all select chunk_id, 'doc-' || (doc_id + 2) from chunks where chunk_type = 'talk' and doc_id % 2 = 0)
  select distinct query_id, case when chunk_type = 'talk' then r.chunk_id else e.chunk_id end as chunk_id from n join e using (query_id, n) left join r on chunk_type = 'talk' and r.talk_id = e.chunk_id""")
def cited_chunks(spark, d):
    c, i = chunks(spark, d), F.col("doc_id")
    answers = c.where("doc_id % 20 = 0").select(i.alias("query_id"), F.concat(F.lit("See [1] and ["), i % 7 + 1, F.lit("], not [99] or [x]. "), F.left(F.coalesce("text", F.lit("")), F.lit(80))).alias("answer"))
    entries = c.select(F.expr("doc_id div 20 * 20").alias("query_id"), (i % 20).cast("int").alias("n"), "chunk_id", "chunk_type")
    talk = c.where("chunk_type = 'talk'")
    refs = talk.select(F.col("chunk_id").alias("talk_id"), F.concat(F.lit("doc-"), i + 1).alias("chunk_id")).union(talk.where("doc_id % 2 = 0").select("chunk_id", F.concat(F.lit("doc-"), i + 2)))
    return Z.cited_chunks(answers, entries, refs)


@query(C + """, j as (select segment_title, case doc_id % 4 when 0 then '["A' || doc_id % 3 || '", "b", ""]' when 1 then '"A9"' when 2 then '{"a": 1}' end as aliases_json from chunks)
  select distinct lower(segment_title) as segment, lower(alias) as alias from (select segment_title, unnest(from_json(aliases_json, '["VARCHAR"]')) as alias from j where json_type(aliases_json) = 'ARRAY') where alias <> ''""")
def alias_unnest(spark, d):
    i = F.col("doc_id")
    json = F.when(i % 4 == 0, F.concat(F.lit('["A'), i % 3, F.lit('", "b", ""]'))).when(i % 4 == 1, '"A9"').when(i % 4 == 2, '{"a": 1}')
    return Z.aliases_of(chunks(spark, d).select("segment_title", json.alias("aliases_json")))


@query(C + """select chunk_id, case when doc_id % 3 = 0 then (doc_id % 17)::int when doc_id % 10 < 2 then (doc_id % 10 + 100)::int end as paragraph from chunks""")
def paragraph_backfill(spark, d):
    """Updates come as two parallel arrays, one pair a decade of ids."""
    c, i = chunks(spark, d), F.col("doc_id")
    tens = c.groupBy(F.expr("doc_id div 10").alias("ten")).agg(F.count("*").alias("n"))
    updates = tens.select(F.expr("array(concat('doc-', ten * 10), concat('doc-', ten * 10 + 1))").alias("ids"), F.expr("array(100, 101)").alias("paragraphs"))
    return Z.fill_paragraphs(c.select("chunk_id", F.when(i % 3 == 0, (i % 17).cast("int")).alias("paragraph")), F.col("ids"), F.col("paragraphs"), updates)


@query("""with f as (select 'f' || doc_id // 3 || ['.txt', '.quantify', '.csv'][doc_id % 3 + 1] as name, ['txt', 'quantify', 'csv'][doc_id % 3 + 1] as kind, lang || doc_id as stats from documents where doc_id % 7 > 0)
  select t.name, q.stats as word_stats, c.stats as csv_stats from f t left join f q on q.kind = 'quantify' and split_part(q.name, '.', 1) = split_part(t.name, '.', 1)
  left join f c on c.kind = 'csv' and split_part(c.name, '.', 1) = split_part(t.name, '.', 1) where t.kind = 'txt'""")
def related_files(spark, d):
    i = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("txt"), F.lit("quantify"), F.lit("csv")), (i % 3 + 1).cast("int"))
    return Z.related_files(table(spark, d, "documents").where("doc_id % 7 > 0").select(F.concat(F.lit("f"), F.expr("doc_id div 3"), F.lit("."), kind).alias("name"), kind.alias("kind"), F.concat("lang", i).alias("stats")))


# --- small maps, sets and texts ------------------------------------------------------------------------------


@query("select user_id, event_type as key, arg_max(value, event_id) as value from events group by all")
def map_last_write(spark, d):
    """Maps of one user merged so that the last writer of a key wins."""
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("value"))


@query("""with m as (select doc_id, regexp_extract_all(text, '[\\p{L}]+') as ws from documents),
  x as (select doc_id, ws[1:6] as members, list_transform(ws[3:8], lambda x: lower(trim(x))) as bad from m)
  select doc_id, array_to_string(list_filter(members, lambda x: not list_contains(bad, lower(x))), ' ') as members from x""")
def supported_members(spark, d):
    """The first six words without those that are among the third to eighth, letters compared without case."""
    ws = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))
    rows = table(spark, d, "documents").select("doc_id", ws.alias("ws")).select("doc_id", F.slice("ws", 1, 6).alias("members"), F.transform(F.slice("ws", 3, 6), lambda x: F.lower(F.trim(x))).alias("bad"))
    return rows.select("doc_id", F.array_join(F.filter("members", lambda x: ~F.array_contains("bad", F.lower(x))), " ").alias("members"))


@query("select doc_id, nfc_normalize(text || 'e' || chr(769) || 'u' || chr(776)) as text from documents")
def nfc_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.nfc(F.concat("text", F.lit("éü"))).alias("text"))


_REPORT = "'a) fine' || chr(10) || case doc_id % 3 when 0 then 'B)  ' || left(text, 60) || chr(10) || ' c) rest' when 1 then 'x b) ' || left(text, 60) || chr(10) || 'Bewertung: 3/10' else 'b) ' || left(text, 60) end"


@query(f"""with r as (select doc_id, {_REPORT} as t from documents), s as (select doc_id, t, regexp_extract(t, '(?is)\\bb\\)\\s*(.*?)(?:\\n\\s*c\\)\\s*|\\n\\s*bewertung\\s*:)', 1) as a from r)
  select doc_id, regexp_replace(case when a <> '' then a else regexp_extract(t, '(?is)\\bb\\)\\s*(.*)$', 1) end, '^\\s+|\\s+$', '', 'g') as claims from s""")
def unsupported_claims(spark, d):
    i, t = F.col("doc_id"), F.left("text", F.lit(60))
    report = F.concat(F.lit("a) fine\n"), F.when(i % 3 == 0, F.concat(F.lit("B)  "), t, F.lit("\n c) rest"))).when(i % 3 == 1, F.concat(F.lit("x b) "), t, F.lit("\nBewertung: 3/10"))).otherwise(F.concat(F.lit("b) "), t)))
    return table(spark, d, "documents").select("doc_id", X.section_b(report).alias("claims"))


@query("""select doc_id, 2 * len(regexp_extract_all(text, '\\S+'))::int as tokens from documents""")
def rough_prompt_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", (2 * F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))).alias("tokens"))


@query("""select event_id, case when event_id % 3 < 2 then date_trunc('second', ts) end as at from events""")
def iso_times(spark, d):
    i = F.col("event_id")
    iso = F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("no time")
    return table(spark, d, "events").select("event_id", X.iso_time(iso).alias("at"))


_APP = {"text": "['book', 'secondary_book', 'talk']", "concept": "['begriff', 'typology']", "quote": "['quote', 'quote_explanation']", "chapter_summary": "['chapter_summary']", "book": "['book']", "talk": "['talk']", "odd": "['odd']"}


@query(f"""with n as (select doc_id, unnest([doc_id % 7, doc_id % 5 + 7, doc_id % 3]) as k, unnest([1, 2, 3]) as pos from documents), w as (select doc_id, pos, (['text', 'concept', 'book', 'odd', 'quote', 'talk', 'chapter_summary'])[k % 7 + 1] as name from n where k <> 8),
  e as (select doc_id, pos, generate_subscripts(types, 1) as i, unnest(types) as type from (select doc_id, pos, case name {" ".join(f"when '{k}' then {v}" for k, v in _APP.items())} end as types from w)),
  f as (select doc_id, type, min(pos * 100 + i) as place from e group by all) select doc_id, string_agg(type, ',' order by place) as types from f group by 1""")
def type_aliases(spark, d):
    """App types become chunk types: aliases expand, other names stay, the first place of each counts, blanks go. Each document asks for others."""
    names = F.array(*[F.lit(t) for t in ("Text", " concept", "book", "ODD", "quote ", "talk", "chapter_summary")])
    i = F.col("doc_id")
    asked = F.transform(F.array(i % 7, i % 5 + 7, i % 3), lambda k: F.when(k == 8, F.lit("  ")).otherwise(F.element_at(names, (k % 7 + 1).cast("int"))))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.chunk_types(asked), ",").alias("types"))


@query("""with u as (select user_id, event_id, case event_id % 3 when 0 then upper(event_type) when 1 then event_type else upper(left(event_type, 1)) || substr(event_type, 2) end as name from events)
  select user_id, name, event_id from u qualify row_number() over (partition by user_id, lower(name) order by event_id) = 1""")
def first_spelling(spark, d):
    """Ordered distinct: of names that differ in case alone, the one that a user has spelt first."""
    t, i = F.col("event_type"), F.col("event_id")
    name = F.when(i % 3 == 0, F.upper(t)).when(i % 3 == 1, t).otherwise(F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 99)))
    return ranking.ordered_distinct(table(spark, d, "events").select("user_id", "event_id", name.alias("name")), "name", "event_id", "user_id").select("user_id", "name", "event_id")


# --- users, invitations, recodes, vectors ---------------------------------------------------------------------


@query("""with s as (select c_custkey as github_id, c_name as name, case when c_custkey % 7 = 0 then 'admin' else 'user' end as role from customer where c_custkey % 5 > 0),
  b as (select c_custkey as github_id, upper(c_name) as name from customer where c_custkey % 3 = 0)
  select coalesce(s.github_id, b.github_id) as github_id, coalesce(b.name, s.name) as name, coalesce(s.role, 'user') as role from s full join b using (github_id)""")
def user_upsert(spark, d):
    c, i = table(spark, d, "customer"), F.col("c_custkey")
    stored = c.where("c_custkey % 5 > 0").select(i.alias("github_id"), F.col("c_name").alias("name"), F.when(i % 7 == 0, "admin").otherwise("user").alias("role"))
    return talks.upsert_users(stored, c.where("c_custkey % 3 = 0").select(i.alias("github_id"), F.upper("c_name").alias("name")))


_INV = """inv as (select conv_id as id, 'u' || conv_id % 5 as inviter, 'e' || conv_id % 400 || '@x' as email, 'c' || conv_id as code, case when conv_id % 4 = 0 then 'redeemed' else 'pending' end as status,
   timestamp '2024-01-01' + to_hours(conv_id::int % 60) as created_at from (select distinct conv_id from conversations) where conv_id % 3 = 0)"""


def _invitations(spark, d):
    i = F.col("conv_id")
    return table(spark, d, "conversations").select("conv_id").distinct().where(i % 3 == 0).select(
        i.alias("id"), F.concat(F.lit("u"), i % 5).alias("inviter"), F.concat(F.lit("e"), i % 400, F.lit("@x")).alias("email"), F.concat(F.lit("c"), i).alias("code"),
        F.when(i % 4 == 0, "redeemed").otherwise("pending").alias("status"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 60 as int), 0, 0)").alias("created_at"))


@query(f"""with recursive {_INV}, n as (select row_number() over (order by event_id) as step, 'u' || user_id % 7 as inviter, 'e' || (event_id // 25 * 7) % 300 || '@x' as email, 'n' || event_id as code from events where event_id % 25 = 0),
  live as (select 0 as step, (select list({{'inviter': inviter, 'email': email, 'code': code, 'status': status, 'created_at': created_at}}) from inv) as held
   union all select n.step, case when len(list_filter(held, lambda r: r.email = n.email and r.status = 'pending')) > 0
      or len(list_filter(held, lambda r: r.inviter = n.inviter and r.created_at >= timestamp '2024-01-02 12:00:00' - interval 24 hour and r.created_at <= timestamp '2024-01-02 12:00:00')) < 20
     then list_append(list_filter(held, lambda r: not (r.email = n.email and r.status = 'pending')), {{'inviter': n.inviter, 'email': n.email, 'code': n.code, 'status': 'pending', 'created_at': timestamp '2024-01-02 12:00:00'}})
     else held end from live join n on n.step = live.step + 1)
  select r.inviter, r.email, r.code, r.status, r.created_at, r.created_at + interval 48 hour as expires_at from (select unnest(held) as r from live where step = (select count(*) from n))""")
def invitation_create(spark, d):
    """Events invite in turn: some addresses again and again, some inviters more often than they may."""
    new = table(spark, d, "events").where("event_id % 25 = 0").select(
        F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("inviter"), F.concat(F.lit(" E"), F.expr("event_id div 25 * 7 % 300"), F.lit("@X ")).alias("email"), F.concat(F.lit("n"), "event_id").alias("code"))
    after = talks.create_invitations(_invitations(spark, d), new, F.expr("timestamp_ntz'2024-01-02 12:00:00'"))[0]
    return after.select("inviter", "email", "code", "status", "created_at", F.expr("created_at + interval 48 hours").alias("expires_at"))


@query(f"""with {_INV}, t as (select event_id as pos, 'e' || (user_id * 3) % 400 || '@x' as email, 'c' || (user_id * 3 + case when event_id % 4 = 0 then 1000000 else 0 end) as code from events),
  k as (select email, code, bool_or(status = 'pending' and created_at + interval 48 hour > timestamp '2024-01-04') as open, bool_or(created_at + interval 48 hour <= timestamp '2024-01-04') as old from inv group by all)
  select pos, t.email, t.code, case when open and row_number() over (partition by t.email, t.code order by pos) = 1 then 'redeemed' when old then 'expired' else 'invalid' end as outcome
  from t left join k on k.email = t.email and k.code = t.code""")
def invitation_redeem(spark, d):
    """Codes are tried again and again; a fourth of the tries has a wrong one."""
    u = F.col("user_id") * 3
    tries = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("E"), u % 400, F.lit("@X ")).alias("email"), F.concat(F.lit("c"), u + F.when(F.col("event_id") % 4 == 0, 1000000).otherwise(0)).alias("code"))
    return talks.redeem_invitations(_invitations(spark, d), tries, F.expr("timestamp_ntz'2024-01-04 00:00:00'"))


@query("select doc_id, case doc_id % 4 when 0 then 'draft' when 1 then 'personal' else 'published' end as status from documents")
def status_recode(spark, d):
    old = F.element_at(F.array(*[F.lit(s) for s in ("unknown", "private", "published", "published")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", talks.recode(old, {"unknown": "draft", "private": "personal"}).alias("status"))


@query("select vec_id, case when vec_id % 4 = 0 then 2 else 1 end as names, round(case when vec_id % 4 = 0 then -embedding[1] else embedding[1] end::double, 6) as first from embeddings")
def named_vector_update(spark, d):
    """The vector of one name is replaced, others and the payload stay."""
    e = table(spark, d, "embeddings")
    stored = e.select("vec_id", F.create_map(F.when(F.col("vec_id") % 8 == 4, "dense").when(F.col("vec_id") % 4 == 0, "sparse").otherwise("dense"), "embedding").alias("vectors"))
    new = e.where("vec_id % 4 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("vector"))
    out = merge.set_vector(stored, new, "vec_id", "main")
    value = F.coalesce(F.col("vectors")["main"], F.col("vectors")["dense"])
    return out.select("vec_id", F.size("vectors").alias("names"), F.round(F.get(value, F.lit(0)).cast("double"), 6).alias("first"))


@query("""with c as (select round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cos, len(a.embedding) = len(b.embedding) as same from embeddings a
  join (select vec_id, list_transform(embedding, lambda x: x * 2) as embedding from embeddings) b using (vec_id))
  select min(cos) as min_cos, count(*) filter (cos < 0.98) as below, bool_and(same) and min(cos) >= 0.98 as compatible from c""")
def embedding_compatibility(spark, d):
    from ..functions import vectors as V

    e = table(spark, d, "embeddings").select("embedding", F.transform("embedding", lambda x: x * 2).alias("other"))
    pairs = e.select(F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"), (F.size("embedding") == F.size("other")).alias("same"))
    return pairs.agg(F.min("cos").alias("min_cos"), F.count_if(F.col("cos") < 0.98).alias("below"), (F.bool_and("same") & (F.min("cos") >= 0.98)).alias("compatible"))


@query(C + """select chunk_id from chunks where regexp_matches(coalesce(source_title, ''), '(?i)volume 1') or regexp_matches(segment_title, '(?i)volume 1')""")
def title_contains(spark, d):
    from ..operators.filters import title_like

    return chunks(spark, d).where(title_like("VOLUME 1", "source_title", "segment_title")).select("chunk_id")


@query("select event_id from events where props ->> '$.k' = '7'")
def json_key_filter(spark, d):
    from ..operators.filters import key_values

    return table(spark, d, "events").where(key_values({" k ": 7, " ": "x"}, "props")).select("event_id")
