"""Counts, listings and reports over chunks and usage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, ranking
from ..registry import query
from ..schemas import CHUNK_TYPES, DEFAULT_MODEL, EUR_PER_USD, PRICES
from ..sources.testdata import CHUNKS_SQL, USAGE_SQL, chunks, pricing, table, turns, usage

C, U = f"with {CHUNKS_SQL} ", f"with {USAGE_SQL} "


@query(C + "select rag_partition as collection, count(*) as n from chunks group by all")
def chunk_counts_by_collection(spark, d):
    return chunks(spark, d).groupBy(F.col("rag_partition").alias("collection")).agg(F.count("*").alias("n"))


@query(C + "select count(*) as total, count(embedded_at) as embedded, count(deprecated_at) as deprecated, count(*) filter (rag_partition = '__shared__') as shared from chunks")
def dashboard_totals(spark, d):
    return chunks(spark, d).agg(F.count("*").alias("total"), F.count("embedded_at").alias("embedded"), F.count("deprecated_at").alias("deprecated"),
                                F.count_if(F.col("rag_partition") == "__shared__").alias("shared"))


@query(U + """select coalesce(model, 'unknown') as model, count(*) as calls, coalesce(sum(prompt_tokens), 0)::bigint as prompt_tokens,
  coalesce(sum(completion_tokens), 0)::bigint as completion_tokens from usage group by usage.model""")
def usage_by_model(spark, d):
    return usage(spark, d).groupBy("model").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens")).withColumn("model", F.coalesce("model", F.lit("unknown")))


@query(U + """select strftime(created_at, '%Y-%m-%d') as day, count(*) as calls, sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))::bigint as tokens
  from usage group by 1 order by 1 desc limit 30""")
def usage_daily(spark, d):
    total = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return usage(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("calls"), F.sum(total).alias("tokens")).orderBy(F.desc("day")).limit(30)


@query(U + """select model, count(*) as calls, sum(cost)::bigint / 1e6 as cost_usd from (select u.model,
  floor((coalesce(prompt_tokens, 0) / 1000000.0::double * coalesce(p.prompt_per_1m_usd, 0)::double
      + coalesce(completion_tokens, 0) / 1000000.0::double * coalesce(p.completion_per_1m_usd, 0)::double) * 1e6 + 0.5)::bigint as cost
  from usage u left join pricing p on p.model = u.model) group by model""")
def usage_costs(spark, d):
    """The price list is a small dimension: its broadcast is bounded by the number of models. Costs add up in whole micro-dollars."""
    cost = (F.coalesce("prompt_tokens", F.lit(0)) / 1e6 * F.coalesce("prompt_per_1m_usd", F.lit(0.0))
            + F.coalesce("completion_tokens", F.lit(0)) / 1e6 * F.coalesce("completion_per_1m_usd", F.lit(0.0)))
    return usage(spark, d).join(F.broadcast(pricing(spark)), "model", "left").withColumn("cost", _micro(cost)).groupBy("model").agg(
        F.count("*").alias("calls"), (F.sum("cost") / 1e6).alias("cost_usd"))


def _micro(c):
    return F.floor(c * 1e6 + 0.5)


@query(U + """select account_id, sum(floor((p / 1e6 * a + c / 1e6 * b) * 1e6 + 0.5)::bigint)::bigint / 1e6 as usd,
  sum(floor((p / 1e6 * a + c / 1e6 * b) * 0.92 * 1e6 + 0.5)::bigint)::bigint / 1e6 as eur
  from (select account_id, coalesce(prompt_tokens, 0)::double as p, coalesce(completion_tokens, 0)::double as c, coalesce(prompt_per_1m_usd, 0.14)::double as a,
    coalesce(completion_per_1m_usd, 0.28)::double as b from usage left join pricing using (model)) group by 1""")
def account_costs_default_price(spark, d):
    """Models without a price are charged as the default model; a call without tokens costs nothing."""
    a, b = (F.coalesce(c, F.lit(p)) for c, p in zip(("prompt_per_1m_usd", "completion_per_1m_usd"), PRICES[DEFAULT_MODEL]))
    usd = F.coalesce("prompt_tokens", F.lit(0)) / 1e6 * a + F.coalesce("completion_tokens", F.lit(0)) / 1e6 * b
    return usage(spark, d).join(F.broadcast(pricing(spark)), "model", "left").groupBy("account_id").agg((F.sum(_micro(usd)) / 1e6).alias("usd"), (F.sum(_micro(usd * EUR_PER_USD)) / 1e6).alias("eur"))


@query(U + """select count(*) as calls, coalesce(sum(prompt_tokens), 0)::bigint as tokens, count(distinct account_id) as accounts,
  round(coalesce(sum(prompt_tokens)::double / nullif(count(distinct account_id), 0), 0.0), 6) as tokens_per_account from usage""")
def usage_averages(spark, d):
    per = usage(spark, d).groupBy("account_id").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("t"))
    return per.agg(F.sum("calls").alias("calls"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count("account_id").alias("accounts")).withColumn(
        "tokens_per_account", F.round(F.coalesce(F.try_divide(F.col("tokens").cast("double"), "accounts"), F.lit(0.0)), 6))


@query(C + """select chunk_type, author, source_title, source_id, min(updated_at) as first_at, count(*) as n from chunks
  where (rag_partition = 'main' or (rag_partition = '__shared__' and chunk_type in ('book', 'secondary_book'))) and deprecated_at is null
  group by all having count(*) >= 2 order by n desc, source_title, chunk_type, author nulls last limit 100""")
def book_titles_counts(spark, d):
    return (chunks(spark, d).where(filters.shared_scope("main") & filters.active()).groupBy("chunk_type", "author", "source_title", "source_id")
            .agg(F.min("updated_at").alias("first_at"), F.count("*").alias("n")).where("n >= 2")
            .orderBy(F.desc("n"), "source_title", "chunk_type", F.asc_nulls_last("author")).limit(100))


@query(C + "select segment_id, segment_title, count(*) as n, min(source_index) as first_index from chunks where deprecated_at is null group by all")
def chapter_listing(spark, d):
    return chunks(spark, d).where(filters.active()).groupBy("segment_id", "segment_title").agg(
        F.count("*").alias("n"), F.min("source_index").alias("first_index")).orderBy(F.asc_nulls_last("first_index"), "segment_id")


@query(C + f""", s as (select chunk_type, count(*) as n, round(sum(strlen(coalesce(text, ''))) / 1048576.0::double, 2) as mb, min(updated_at) as oldest, max(updated_at) as newest from chunks where doc_id % 9 <> 5 group by 1)
  select coalesce(t.chunk_type, s.chunk_type) as chunk_type, coalesce(n, 0) as n, coalesce(mb, 0.0) as mb, oldest, newest from (select unnest([{", ".join(f"'{t}'" for t in CHUNK_TYPES)}]) as chunk_type) t full join s on s.chunk_type = t.chunk_type""")
def chunk_type_monitoring(spark, d):
    """Every known type has a row, also `talk_summary`, of which this scope holds none; unknown ones are appended."""
    mb = F.round(F.sum(F.octet_length(F.coalesce("text", F.lit("")))) / 1048576.0, 2)
    stats = chunks(spark, d).where("chunk_type != 'talk_summary'").groupBy("chunk_type").agg(
        F.count("*").alias("n"), mb.alias("mb"), F.min("updated_at").alias("oldest"), F.max("updated_at").alias("newest"))
    known = spark.createDataFrame([(t,) for t in CHUNK_TYPES], "chunk_type string")
    return known.join(stats, "chunk_type", "full").select("chunk_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mb", F.lit(0.0)).alias("mb"), "oldest", "newest")


@query(C + """select count(*) as n, round(coalesce(sum(strlen(coalesce(text, ''))), 0) / 1024.0::double, 2) as kb from chunks
  where (rag_partition = 'main' or rag_partition = '__shared__') and embedded_at is null and deprecated_at is null""")
def embed_scope_stats(spark, d):
    return chunks(spark, d).where(filters.embed_scope("main", only_unembedded=True)).agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.lit(0)) / 1024.0, 2).alias("kb"))


@query(C + """select chunk_id, updated_at from chunks where (rag_partition = 'main' or (rag_partition = '__shared__' and source_id in ('src1', 'src2')))
  and chunk_type in ('book', 'quote') and embedded_at is null and deprecated_at is null order by updated_at, chunk_id limit 200""")
def embed_batch_order(spark, d):
    scope = filters.embed_scope("main", shared_sources=["src1", "src2"], types=["book", "quote"], only_unembedded=True)
    return chunks(spark, d).where(scope).select("chunk_id", "updated_at").orderBy("updated_at", "chunk_id").limit(200)


@query(C + "select rag_partition as collection, chunk_type, count(*) as n, min(updated_at) as oldest, max(updated_at) as newest from chunks group by all")
def collection_info(spark, d):
    return chunks(spark, d).groupBy(F.col("rag_partition").alias("collection"), "chunk_type").agg(
        F.count("*").alias("n"), F.min("updated_at").alias("oldest"), F.max("updated_at").alias("newest"))


@query(C + "select source_id, chunk_type, max(coalesce(source_title, '')) as title, max(author) as author from chunks group by 1, 2")
def books_for_deletion(spark, d):
    return chunks(spark, d).groupBy("source_id", "chunk_type").agg(F.max(F.coalesce("source_title", F.lit(""))).alias("title"), F.max("author").alias("author"))


@query(C + "select segment_id, count(*) as paragraphs from chunks where deprecated_at is null group by 1")
def segment_paragraph_counts(spark, d):
    return chunks(spark, d).where(filters.active()).groupBy("segment_id").agg(F.count("*").alias("paragraphs"))


@query(C + """select distinct source_id, chunk_type from (select source_id, chunk_type from chunks where deprecated_at is null
  union select source_id, chunk_type from chunks where embedded_at is not null)""")
def cleanup_scope_keys(spark, d):
    c = chunks(spark, d)
    stored, mirror = c.where(filters.active()), c.where("embedded_at is not null")
    return stored.select("source_id", "chunk_type").union(mirror.select("source_id", "chunk_type")).distinct()


@query("select user_id, count(*) as n, count(*) >= 20 as limited from events where ts > timestamp '2024-01-02' - interval 24 hours and ts <= timestamp '2024-01-02' group by 1")
def rate_limit_24h(spark, d):
    at = F.expr("timestamp_ntz'2024-01-02 00:00:00'")
    return table(spark, d, "events").where((F.col("ts") > at - F.expr("interval 24 hours")) & (F.col("ts") <= at)).groupBy("user_id").agg(
        F.count("*").alias("n")).withColumn("limited", F.col("n") >= 20)


@query(C + """, t as (select coalesce(source_title, source_id) as title, length(coalesce(text, '')) // 4 as tokens, length(coalesce(text, '')) as chars from chunks)
  select title, count(*) as n, max(tokens)::bigint as max_tokens, count(*) filter (tokens > 512) as over_limit, count(*) filter (tokens > 400) as warned,
    round(100.0::double * count(*) filter (tokens > 512) / count(*), 2) as over_pct,
    case when count(*) filter (tokens > 512) = 0 then 1400 else floor(450 * (sum(case when tokens > 0 then floor(chars::double / tokens * 10000)::bigint end)::double / 10000 / count(*) filter (tokens > 0)))::bigint end as safe_chars from t group by 1""")
def token_audit_by_source(spark, d):
    from .. import schemas as S

    tokens = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    t = chunks(spark, d).select(F.coalesce("source_title", "source_id").alias("title"), tokens.alias("tokens"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    # The mean of ratios is summed in whole ten-thousandths, so that it does not depend on the order of rows.
    ratio = F.when(F.col("tokens") > 0, F.floor(F.col("chars").cast("double") / F.col("tokens") * 10000))
    over = F.count_if(F.col("tokens") > S.TOKEN_LIMIT)
    return t.groupBy("title").agg(
        F.count("*").alias("n"), F.max("tokens").alias("max_tokens"), over.alias("over_limit"), F.count_if(F.col("tokens") > S.TOKEN_WARN).alias("warned"),
        F.round(100.0 * over / F.count("*"), 2).alias("over_pct"),
        F.when(over == 0, F.lit(1400).cast("long")).otherwise(
            F.floor(S.TOKEN_SAFE * (F.sum(ratio).cast("double") / 10000 / F.count_if(F.col("tokens") > 0)))).alias("safe_chars"))


@query(C + ", g as (select source_id, chunk_type, count(*) as n from chunks group by all), w as (select source_id, " + ", ".join(
    f"coalesce(sum(n) filter (chunk_type = '{t}'), 0)::bigint as {t}" for t in CHUNK_TYPES) + " from g group by 1) select * from w union all select '(all)', " + ", ".join(
    f"sum({t})::bigint" for t in CHUNK_TYPES) + " from w")
def completeness_pivot(spark, d):
    """Chunk types by source, with a row of totals. Counted first, so the pivot sees one row a cell."""
    cells = chunks(spark, d).groupBy("source_id", "chunk_type").agg(F.count("*").alias("n"))
    wide = cells.groupBy("source_id").pivot("chunk_type", CHUNK_TYPES).agg(F.sum("n")).na.fill(0)
    return wide.unionByName(wide.agg(*[F.sum(t).alias(t) for t in CHUNK_TYPES]).withColumn("source_id", F.lit("(all)")))


@query(C + f"""select s.source_id, t.chunk_type as missing from (select distinct source_id from chunks) s cross join
  (select unnest([{", ".join(f"'{t}'" for t in CHUNK_TYPES)}]) as chunk_type) t
  where not exists (select 1 from chunks c where c.source_id = s.source_id and c.chunk_type = t.chunk_type and c.deprecated_at is null and c.author = 'Author A')""")
def missing_types(spark, d):
    """Expected types that a source lacks among one author's active chunks."""
    c = chunks(spark, d)
    expected = c.select("source_id").distinct().select("source_id", F.explode(F.array(*[F.lit(t) for t in CHUNK_TYPES])).alias("missing"))
    have = c.where(filters.active() & (F.col("author") == "Author A")).select("source_id", F.col("chunk_type").alias("missing")).distinct()
    return expected.join(have, ["source_id", "missing"], "left_anti")


@query(C + """select coalesce(case when source_title is null then null when starts_with(source_title, 'Volume 1') then 'high' when starts_with(source_title, 'Volume 2') then 'low' end, 'unknown') as sufficiency, count(*) as n from chunks group by 1""")
def sufficiency_histogram(spark, d):
    level = F.when(F.col("source_title").startswith("Volume 1"), "high").when(F.col("source_title").startswith("Volume 2"), "low")
    return chunks(spark, d).groupBy(F.coalesce(level, F.lit("unknown")).alias("sufficiency")).agg(F.count("*").alias("n"))


@query("select count(*) as processed, round(avg(quality), 6) as success_rate, round(avg(case when toxic = 0 then 1.0 else 0.0 end), 6) as validation_rate from labels")
def pipeline_statistics(spark, d):
    return table(spark, d, "labels").agg(F.count("*").alias("processed"), F.round(F.avg("quality"), 6).alias("success_rate"),
                                         F.round(F.avg(F.when(F.col("toxic") == 0, 1.0).otherwise(0.0)), 6).alias("validation_rate"))


@query("""select lang, count(*) as n, count(*) filter (quality = 1) as passed, round(avg(quality), 6) as rate from documents join labels using (doc_id) group by 1""")
def metadata_success_by_category(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"), F.round(F.avg("quality"), 6).alias("rate"))


@query(C + ", g as (select source_title, count(*) as n from chunks group by 1) select sum(n)::bigint as hits, sum(case when source_title is not null then n else 0 end)::bigint as with_title, sum(n - 1)::bigint as duplicate_titles from g")
def citation_quality(spark, d):
    g = chunks(spark, d).groupBy("source_title").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("hits"), F.sum(F.when(F.col("source_title").isNotNull(), F.col("n")).otherwise(0)).alias("with_title"),
                 F.sum(F.col("n") - 1).alias("duplicate_titles"))


@query(C + """select source_id, count(*) filter (deprecated_at is not null) as deprecated, count(*) as n from chunks group by 1""")
def deprecation_counts(spark, d):
    return chunks(spark, d).groupBy("source_id").agg(F.count("deprecated_at").alias("deprecated"), F.count("*").alias("n"))


@query(C + """select rag_partition, count(*) as n, count(*) filter (embedded_at is null) as without_vector, count(*) filter (embedded_at is null) = 0 as ok from chunks where coalesce(trim(text), '') <> '' group by 1""")
def vector_coverage(spark, d):
    c = chunks(spark, d).where("coalesce(trim(text), '') != ''")
    return c.groupBy("rag_partition").agg(F.count("*").alias("n"), F.count_if(F.col("embedded_at").isNull()).alias("without_vector")).withColumn("ok", F.col("without_vector") == 0)


@query("""select conv_id as talk_id, (sum(length(coalesce(text, '')) // 4) + 800)::bigint as tokens from conversations group by 1""")
def context_token_estimate(spark, d):
    from ..functions.text import tokens_estimate

    return turns(spark, d).groupBy("talk_id").agg((F.sum(tokens_estimate(F.col("text"))) + 800).alias("tokens"))


@query(C + "select chunk_id, source_id from (select *, row_number() over (partition by coalesce(source_title, source_id) order by chunk_id) as n from chunks) where n = 1")
def first_document_per_title(spark, d):
    return ranking.first_per(chunks(spark, d).withColumn("title", F.coalesce("source_title", "source_id")), ["title"], F.asc("chunk_id")).select("chunk_id", "source_id")


# --- star schema: the relational families at large ----------------------------------------------------------


@query("""select n_name, o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey group by all""")
def orders_by_nation_priority(spark, d):
    nations = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"))  # a fixed dimension of 25 rows
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "o_orderpriority").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity)::double as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc,
  round(avg(l_quantity), 6) as avg_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def lineitem_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02 00:00:00'"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""select n_name, s_suppkey, revenue from (select n_name, s_suppkey, revenue, row_number() over (partition by n_name order by revenue desc, s_suppkey) as rn from
  (select s_nationkey, s_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on l_suppkey = s_suppkey group by all)
  join nation on s_nationkey = n_nationkey) where rn <= 3""")
def top_suppliers_by_nation(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    named = li.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return ranking.cap_per(named, ["n_name"], 3, F.desc("revenue"), F.asc("s_suppkey")).select("n_name", "s_suppkey", "revenue")
