"""Streams over the events, run over what is there; the SQL is the batch twin of what the watermark has let out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cache
from ..registry import query
from ..sources.scratch import folder
from ..sources.testdata import CHUNKS_SQL, chunks, table
from ..streaming import ingest, state
from ..streaming import usage as S
from .lifecycle import B, incoming, now, stored


def _events(spark, d):
    return S.event_stream(spark, f"{d}/events.parquet*")


_LAST = "(select max(ts) from events) - interval 1 day"


@query(f"""select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as calls, sum(floor(value)::bigint)::bigint as tokens from events
  group by 1, 2 having max(date_trunc('day', ts)) + interval 1 day <= {_LAST}""")
def stream_daily_usage(spark, d):
    return S.run_available(S.daily_usage(_events(spark, d)), "daily")


@query(f"""with w as (select user_id, unnest(range(time_bucket(interval 6 hours, ts) - interval 18 hours, time_bucket(interval 6 hours, ts) + interval 6 hours, interval 6 hours)) as start from events)
  select strftime(start, '%Y-%m-%d %H:%M') as start, user_id, count(*) as n from w group by w.start, user_id having w.start + interval 24 hours <= {_LAST}""")
def stream_rate_limit(spark, d):
    return S.run_available(S.sliding_counts(_events(spark, d)), "sliding")


@query(f"""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
  s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, user_id, count(*) as n from s group by user_id, k having max(ts) + interval 30 minutes <= {_LAST}""")
def stream_sessions(spark, d):
    return S.run_available(S.sessions(_events(spark, d)), "sessions")


@query("select count(*) as n, count(distinct event_id) as ids from events")
def stream_once_each(spark, d):
    e = _events(spark, d)
    return S.run_available(S.once_each(e.union(e)).select("event_id"), "once").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("""select user_id, count(*) as n, sum(v) filter (back <= 8)::bigint as total from (select user_id, trunc(value)::bigint as v, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events) group by 1""")
def stream_recent_values(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "ts", "value")
    values = state.history(S.run_available(S.recent_values(e), "recent").withColumnRenamed("n", "seen"), "user_id")
    return values.groupBy("user_id").agg(F.max("seen").alias("n"), F.sum("value").alias("total"))


@query("""select conv_id as talk_id, turn as turn_index, role, length(coalesce(text, ''))::bigint as chars, count(*) over (partition by conv_id) as seen
  from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 8""")
def stream_thread_history(spark, d):
    """The last eight turns of every thread, kept as state while turns come in."""
    schema = table(spark, d, "conversations").schema
    t = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/conversations.parquet*").select(
        F.col("conv_id").alias("talk_id"), F.col("turn").alias("turn_index"), "role", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    snapshots = S.run_available(state.latest(t, "talk_id", ["turn_index"], ["role", "chars"], 8), "threads")
    return state.history(snapshots, "talk_id").select("talk_id", "turn_index", "role", "chars", "seen")


@query("""with e as (select event_id, user_id, epoch_ms(ts) as ms, event_type, props from events), last as (select max(ms) - 86400000 as watermark from e)
  select user_id as prompt_id, event_id as id, (select arg_max(s.props, (s.ms, s.event_id)) from e s where s.user_id = r.user_id and s.event_type = 'purchase' and s.ms <= r.ms and s.ms > r.ms - 1800000) as value
  from e r, last where event_type <> 'purchase' and ms <= watermark""")
def stream_prompt_states(spark, d):
    """Purchases store a prompt for their user, other events read it: what is older than half an hour is gone."""
    e = _events(spark, d).select(F.col("user_id").alias("prompt_id"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "purchase", F.col("props")).alias("value"))
    return S.run_available(state.prompt_states(e), "prompts")


@query(B + """, m as (select coalesce(s.rag_partition, i.rag_partition) as rag_partition, coalesce(s.chunk_id, i.chunk_id) as chunk_id, s.chunk_id is null as fresh, i.chunk_id is null as gone,
   s.content_hash is distinct from i.content_hash as rehashed, (s.content_hash is distinct from i.content_hash or s.author is distinct from i.author or s.chunk_type is distinct from i.chunk_type or s.deprecated_at is not null) as differs,
   coalesce(i.content_hash, s.content_hash) as content_hash, s.embedded_at as se, s.deprecated_at as sd from chunks s full join incoming i on s.rag_partition = i.rag_partition and s.chunk_id = i.chunk_id),
 a as (select *, not fresh and (gone or not differs) as kept from m)
 select rag_partition, chunk_id, content_hash, case when se is not null and (kept or not rehashed) then se when kept and sd is not null then null else timestamp '2025-01-01' end as embedded_at,
   case when kept then sd end as deprecated_at, not (se is not null and (kept or not rehashed)) and not (kept and sd is not null) as has_vector from a""")
def stream_embed_loop(spark, d):
    """Batches of changed chunks come as files; each is merged, then all that waits for a vector is embedded in rounds."""
    batch, path = incoming(spark, d).drop("doc_id", "embedded_at", "deprecated_at"), folder(spark, "incoming")
    batch.repartition(4, "chunk_id").write.parquet(path)
    chunk_table = ingest.VersionedChunks(spark, folder(spark, "chunk-versions"), stored(spark, d).drop("doc_id"))
    ingest.ingest(ingest.chunk_stream(spark, path, batch.schema), "embed-loop", ingest.step(chunk_table, now()))
    last = chunk_table.current(columns=["content_hash", "embedded_at", "deprecated_at", "embedding"])
    return last.select("rag_partition", "chunk_id", "content_hash", "embedded_at", "deprecated_at", F.col("embedding").isNotNull().alias("has_vector"))


@query("""select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \n\t]+'))::bigint as words, length(coalesce(text, ''))::bigint as chars, doc_id % 2 = 0 as from_cache from documents""")
def extraction_cache(spark, d):
    """Half of the documents are extracted, then all of them: the second run computes what the first has not."""
    docs, place = table(spark, d, "documents").select("doc_id", "text"), folder(spark, "extractions")
    key = cache.cache_key(F.concat(F.lit("doc-"), "doc_id"), F.col("text"), {"preset": "fast", "version": 1})
    schema = T.StructType([T.StructField("words", T.LongType()), T.StructField("chars", T.LongType())])

    def measure():
        import re

        return lambda text: {"words": len(re.findall(r"[^ \n\t]+", text)), "chars": len(text)}

    cache.cached(docs.where("doc_id % 2 = 0"), key, place, measure, schema)
    return cache.cached(docs, key, place, measure, schema).drop("text")


@query(f"""with {CHUNKS_SQL}, r as (select chunk_id, updated_at, updated_at + case when doc_id % 7 = 0 then interval 3 hours end as deleted_at, updated_at - case when doc_id % 2 = 0 then interval 1 day else interval 0 day end as created_at from chunks)
  select chunk_id, case when deleted_at > timestamp '2024-01-01 05:00:00' then 'deleted' when created_at > timestamp '2024-01-01 05:00:00' then 'created' else 'updated' end as change from r
  where updated_at > timestamp '2024-01-01 05:00:00' or deleted_at > timestamp '2024-01-01 05:00:00'""")
def change_feed(spark, d):
    r = chunks(spark, d).select(
        "chunk_id", "updated_at", F.when(F.col("doc_id") % 7 == 0, F.col("updated_at") + F.expr("interval 3 hours")).alias("deleted_at"),
        F.when(F.col("doc_id") % 2 == 0, F.col("updated_at") - F.expr("interval 1 day")).otherwise(F.col("updated_at")).alias("created_at"))
    return S.changes_since(r, F.expr("timestamp_ntz'2024-01-01 05:00:00'")).select("chunk_id", "change")
