"""Further reports: dashboards, ingest counters, statistics of the document pipeline, coverage, listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters, merge, ranking
from ..operators import quality as Q
from ..registry import query
from ..sources.testdata import CHUNKS_SQL, USAGE_SQL, chunks, table, usage, vectors

C, U = f"with {CHUNKS_SQL} ", f"with {USAGE_SQL} "


@query(C + """, t as (select conv_id as talk_id, ['draft', 'published', 'personal', 'bug'][conv_id % 4 + 1] as status from (select distinct conv_id from conversations))
  select 'chunks' as what, 'all' as name, count(*) as n from chunks union all select 'chunks', 'embedded', count(embedded_at) from chunks union all select 'chunks', 'deprecated', count(deprecated_at) from chunks
  union all select 'partition', rag_partition, count(*) from chunks group by 2 union all select 'status', status, count(*) from t group by 2 union all select 'turns', 'all', count(*) from conversations""")
def dashboard_parts(spark, d):
    """Totals, chunks of each partition and talks of each status as rows of one table."""
    c = chunks(spark, d)
    totals = c.agg(F.count("*").alias("all"), F.count("embedded_at").alias("embedded"), F.count("deprecated_at").alias("deprecated"))
    totals = totals.select(F.lit("chunks").alias("what"), F.explode(F.create_map(*[x for k in ("all", "embedded", "deprecated") for x in (F.lit(k), F.col(k))])).alias("name", "n"))
    turns = table(spark, d, "conversations")
    status = F.element_at(F.array(*[F.lit(s) for s in ("draft", "published", "personal", "bug")]), (F.col("conv_id") % 4 + 1).cast("int"))
    one = lambda what, df, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return totals.union(one("partition", c, F.col("rag_partition"))).union(one("status", turns.select("conv_id").distinct(), status)).union(
        turns.agg(F.count("*").alias("n")).select(F.lit("turns").alias("what"), F.lit("all").alias("name"), "n"))


@query(C + "select source_id, source_title, count(*) as n from chunks where chunk_type = 'book' and deprecated_at is null group by all order by n desc, source_id limit 100")
def books_list(spark, d):
    b = chunks(spark, d).where((F.col("chunk_type") == "book") & filters.active())
    return b.groupBy("source_id", "source_title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").limit(100)


@query(C + """select count(*) as n, round(coalesce(sum(strlen(coalesce(text, ''))), 0) / 1024.0::double, 2) as kb from
  (select text from chunks where (rag_partition = 'main' or rag_partition = '__shared__') and embedded_at is null and deprecated_at is null order by updated_at, chunk_id limit 150)""")
def embed_stats_of_batch(spark, d):
    """Size of the next batch to embed: the oldest rows first, at most 150 of them."""
    batch = chunks(spark, d).where(filters.embed_scope("main", only_unembedded=True)).orderBy("updated_at", "chunk_id").limit(150)
    return batch.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.lit(0)) / 1024.0, 2).alias("kb"))


@query("select event_id, try_cast(props ->> '$.k' as int) as k, props ->> '$.k' is not null as has_k, props ->> '$.none' is not null as has_none from events")
def json_fields(spark, d):
    value = lambda name: F.get_json_object("props", f"$.{name}")
    return table(spark, d, "events").select("event_id", value("k").try_cast("int").alias("k"), value("k").isNotNull().alias("has_k"), value("none").isNotNull().alias("has_none"))


@query(C + """, b as (select chunk_id, content_hash, chunk_type, author, source_id, doc_id from chunks where doc_id % 10 < 6 union all select chunk_id, content_hash, chunk_type, author, source_id, doc_id from chunks where doc_id % 30 = 0),
  i as (select distinct * replace (case when doc_id % 10 = 1 then 'x' || content_hash else content_hash end as content_hash, case when doc_id % 10 = 2 then 'Author Z' else author end as author,
    case when doc_id % 10 = 4 then 'new-' || doc_id else chunk_id end as chunk_id) from b),
  k as (select case when s.chunk_id is null then 'new' when s.content_hash <> i.content_hash then 'changed' when s.author is distinct from i.author then 'changed' else 'unchanged' end as change from i left join chunks s on s.chunk_id = i.chunk_id)
  select (select count(*) from b) as requested, (select count(*) from b) - count(*) as duplicates, count(*) filter (change <> 'unchanged') as ingested, count(*) filter (change = 'unchanged') as unchanged,
    count(*) filter (change = 'changed') as changed, count(*) filter (change = 'new') as new, (select count(*) from chunks where (source_id, chunk_type) in (select (source_id, chunk_type) from b) and chunk_id not in (select chunk_id from i)) as stale from k""")
def ingest_counters(spark, d):
    """What one batch did: rows asked for, repeated, new, changed and unchanged ones, and stored rows of its scope that it left out."""
    fields = ["chunk_id", "content_hash", "chunk_type", "author", "source_id"]
    stored = chunks(spark, d)
    i, m = F.col("doc_id"), F.col("doc_id") % 10
    raw = stored.where(m < 6).unionByName(stored.where("doc_id % 30 = 0"))
    batch = raw.withColumn("content_hash", F.when(m == 1, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash"))).withColumn(
        "author", F.when(m == 2, "Author Z").otherwise(F.col("author"))).withColumn("chunk_id", F.when(m == 4, F.concat(F.lit("new-"), i)).otherwise(F.col("chunk_id"))).select(*fields)
    return merge.ingest_counters(batch, stored.select(*fields))


@query("""select lang, count(*) as processed, round(avg(quality), 6) as success_rate, round(avg(1 - toxic), 6) as validation_rate, count(*) filter (quality = 1 and toxic = 0) as grade_a, count(*) filter (quality = 1 and toxic = 1) as grade_c,
  count(*) filter (quality = 0) as grade_f from documents join labels using (doc_id) group by 1""")
def metadata_test_summary(spark, d):
    """Success and validation rates and the distribution of grades in each category."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    level = F.when(F.col("quality") == 0, "f").when(F.col("toxic") == 0, "a").otherwise("c")
    return rows.withColumn("grade", level).groupBy("lang").agg(
        F.count("*").alias("processed"), F.round(F.avg("quality"), 6).alias("success_rate"), F.round(F.avg(1 - F.col("toxic")), 6).alias("validation_rate"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in "acf"])


@query("""select source, doc_id, round(avg(quality) over w, 6) as success_rate, round(avg(n_chars) over w, 3) as average_chars from documents join labels using (doc_id) window w as (partition by source order by doc_id rows unbounded preceding)""")
def running_statistics(spark, d):
    """Rates and averages after each document of a source, as a pipeline keeps them while it runs."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    r = ranking.running(rows, "source", "doc_id", ["quality", "n_chars"])
    return r.select("source", "doc_id", F.round(F.col("upto_quality") / F.col("n"), 6).alias("success_rate"), F.round(F.col("upto_n_chars") / F.col("n"), 3).alias("average_chars"))


@query("""with s as (select label, vec_id, row_number() over (partition by label order by vec_id) <= 20 as taken, vec_id % 13 > 0 as filled from embeddings), g as (select label, count(*) as points, count(*) filter (taken) as sample, count(*) filter (taken and filled) as with_sparse from s group by 1)
  select label, points, sample, with_sparse, case when sample > with_sparse then 'sparse_incomplete:' || with_sparse || '/' || sample else '' end as issues, sample = with_sparse as ok from g""")
def sparse_coverage(spark, d):
    """A sample of each collection's points (the first 20), how many have a sparse vector, and what is amiss."""
    v = vectors(spark, d).withColumn("sparse", F.when(F.col("vec_id") % 13 > 0, F.lit("x")))
    first = v.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("place <= 20")  # cut to 20 in every task
    sample = first.groupBy("label").agg(F.count("*").alias("sample"), F.count("sparse").alias("with_sparse"))
    g = v.groupBy("label").agg(F.count("*").alias("points")).join(sample, "label")
    short = F.col("with_sparse") < F.col("sample")
    issues = F.array_compact(F.array(F.when(F.col("points") == 0, "collection_is_empty"), F.when(short, F.concat(F.lit("sparse_incomplete:"), "with_sparse", F.lit("/"), "sample"))))
    return g.select("label", "points", "sample", "with_sparse", F.array_join(issues, "|").alias("issues"), (~short & (F.col("points") > 0)).alias("ok"))


@query(C + "select chunk_id from chunks where doc_id % 13 = 0 and regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> ''")
def sparse_missing(spark, d):
    """Rows that a sparse vector is still to be made for."""
    rows = chunks(spark, d).withColumn("sparse", F.when(F.col("doc_id") % 13 > 0, F.lit("x")))
    return rows.where(F.col("sparse").isNull() & (X.strip(F.coalesce("text", F.lit(""))) != "")).select("chunk_id")


@query(C + "select rag_partition, chunk_id, row_number() over (partition by rag_partition order by chunk_id) as n from chunks")
def partition_stream(spark, d):
    """Each partition's chunks in the order of their ids."""
    return ranking.running(chunks(spark, d).select("rag_partition", "chunk_id"), "rag_partition", "chunk_id", []).select("rag_partition", "chunk_id", "n")


@query(C + """, t as (select doc_id as query_id, regexp_replace(coalesce(text, ''), '([.!?])', '\\\\1 [' || (length(text) % 9) || ']', 'g') || ' [' || (doc_id % 5) || ']' as answer from documents),
  n as (select distinct query_id, unnest(regexp_extract_all(answer, '\\[(\\d{1,6})\\]', 1))::int as n from t), a as (select doc_id as query_id, unnest(range(1, (doc_id % 7)::int + 1))::int as n from documents)
  select query_id, n from n join a using (query_id, n)""".replace("\\\\\\\\", "\\\\"))
def cited_and_available(spark, d):
    """Numbers that an answer cites behind its sentences and that its context has."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents")
    answer = F.concat(F.regexp_replace(text, F.lit(r"([.!?])"), F.concat(F.lit("$1 ["), F.length(text) % 9, F.lit("]"))), F.lit(" ["), i % 5, F.lit("]"))
    cited = docs.select(i.alias("query_id"), F.explode(X.citation_numbers(answer)).alias("n"))
    there = docs.where("doc_id % 7 > 0").select(i.alias("query_id"), F.explode(F.sequence(F.lit(1), (i % 7).cast("int"))).alias("n"))
    return cited.join(there, ["query_id", "n"], "left_semi").distinct()


@query(r"""with t as (select doc_id, case doc_id % 4 when 0 then ' Ich stimme zu, ' when 1 then '„ich stimme ZU' when 2 then 'ja ' else '' end || coalesce(text, '') as text from documents)
  select doc_id, regexp_matches(text, '(?i)^[\s„“"»«'']*(ich stimme zu)') as agrees, try_cast(case when doc_id % 3 = 0 then '0' when doc_id % 3 = 1 then (doc_id % 50 + 1)::varchar else 'x' end as int) as raw,
    lower(trim(regexp_replace(replace('A_' || doc_id || '  B_', '_', ' '), '\s+', ' ', 'g'))) as person from t""")
def small_readings(spark, d):
    """Agreement at a text's start, numbers of paragraphs (as written, before 0 is refused) and names compared without case."""
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, " Ich stimme zu, ").when(i % 4 == 1, "„ich stimme ZU").when(i % 4 == 2, "ja ").otherwise("")
    n = F.when(i % 3 == 0, "0").when(i % 3 == 1, (i % 50 + 1).cast("string")).otherwise("x")
    raw = F.coalesce(X.paragraph_number(n), F.when(n == "0", 0))
    return table(spark, d, "documents").select("doc_id", X.agrees(F.concat(head, F.coalesce("text", F.lit("")))).alias("agrees"), raw.alias("raw"), X.person_name(F.concat(F.lit("A_"), i, F.lit("  B_"))).alias("person"))


@query(r"""with t as (select doc_id, string_split(coalesce(text, ''), ' ') as w from documents), r as (select doc_id, ' ' || coalesce(w[1], '') || '_' || coalesce(w[2], '') || '  ' as author, (1000 + len(w))::varchar || case when len(w) % 3 = 0 then 'a' else ' ' end as year,
    case when len(w) % 4 = 0 then '' when len(w) % 4 = 1 then 'S. ' else ' ' end || case when len(w) % 4 > 0 then len(w)::varchar else '' end as page from t),
  s as (select doc_id, nullif(trim(author), '') as author, nullif(trim(year), '') as year, nullif(trim(page), '') as page from r)
  select doc_id, nullif(trim(regexp_replace(replace(author, '_', ' '), '\s+', ' ', 'g')), '') as author, case when regexp_matches(year, '^\d{4}$') then year end as year, case when regexp_matches(page, '^\d+$') then page end as page_number,
    coalesce((not regexp_matches(year, '^\d{4}$'))::int, 0) + coalesce((not regexp_matches(page, '^\d+$'))::int, 0) as rejected from s""")
def metadata_clean(spark, d):
    """Fields made of a text's words and their number: blank ones go, names lose their artifacts, years and pages of another form are refused."""
    w = F.split(F.coalesce("text", F.lit("")), " ", -1)
    n, word = F.size(w), lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    raw = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit(" "), word(0), F.lit("_"), word(1), F.lit("  ")).alias("author"), F.concat((1000 + n).cast("string"), F.when(n % 3 == 0, "a").otherwise(" ")).alias("year"),
        F.concat(F.when(n % 4 == 0, "").when(n % 4 == 1, "S. ").otherwise(" "), F.when(n % 4 > 0, n.cast("string")).otherwise("")).alias("page_number"))
    cleaned = Q.clean_metadata(raw)
    return cleaned.select("doc_id", F.nullif("author", F.lit("")).alias("author"), "year", "page_number", "rejected")


@query(U + "select account_id, coalesce(sum(prompt_tokens), 0)::bigint as prompt_tokens, count(*) filter (completion_tokens is null) as without_completion from usage group by 1")
def usage_by_account(spark, d):
    return usage(spark, d).groupBy("account_id").agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.count_if(F.col("completion_tokens").isNull()).alias("without_completion"))
