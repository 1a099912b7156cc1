"""The test tables seen as the engine's entities, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHUNK_TYPES, PRICES, WORLDVIEWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({index} as int) + 1"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: one row each, no shuffle."""
    d = table(spark, sf_dir, "documents").withColumn("chunk_type", _pick(CHUNK_TYPES, "doc_id % 9"))
    stamp = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    return d.select(
        "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("chunk_id"), "chunk_type",
        F.when(F.col("chunk_type").isin("book", "secondary_book"), "__shared__").otherwise("main").alias("rag_partition"),
        F.col("source").alias("source_id"), F.concat(F.lit("Volume "), F.substring("source", 4, 10)).alias("source_title"),
        F.expr("concat('seg-', doc_id div 50)").alias("segment_id"), F.expr("concat('Chapter ', doc_id div 50)").alias("segment_title"),
        F.expr("cast(doc_id % 50 as int)").alias("source_index"),
        F.expr("case doc_id % 4 when 0 then 'Author A' when 1 then 'Author B' when 2 then 'Author C' end").alias("author"),
        F.expr("if(doc_id % 5 = 0, null, 1)").alias("_tagged"), _pick(WORLDVIEWS, "doc_id % 12").alias("worldview"),
        F.col("lang").alias("language"), "text", F.sha2("text", 256).alias("content_hash"), stamp.alias("updated_at"),
        F.when(F.col("doc_id") % 3 != 0, stamp).alias("embedded_at"), F.when(F.col("doc_id") % 7 == 0, stamp).alias("deprecated_at"),
        F.when(F.col("chunk_type") == "quote_explanation", F.concat(F.lit("doc-"), F.col("doc_id") - 1)).alias("parent_id"),
    ).withColumn("worldview", F.when(F.col("_tagged") == 1, F.col("worldview"))).drop("_tagged").withColumn(
        "worldviews", F.when(F.col("worldview").isNotNull(), F.array("worldview")))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("event_type").alias("model"),
        F.floor("value").cast("long").alias("prompt_tokens"), F.get_json_object("props", "$.k").try_cast("long").alias("completion_tokens"),
        F.col("ts").alias("created_at"))


def pricing(spark: SparkSession) -> DataFrame:
    """Prices by model name; the test events' types stand for models, and some have no price."""
    names = dict(zip(["click", "view", "purchase", "deepseek-chat"], PRICES.values()))
    return spark.createDataFrame([(m, a, b) for m, (a, b) in names.items()], "model string, prompt_per_1m_usd double, completion_per_1m_usd double")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of conversations, as (talk_id, turn_index, role, text)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("talk_id"), F.col("turn").alias("turn_index"), "role", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc-"), "vec_id").alias("chunk_id"), "vec_id", "embedding", "label")


_TYPES = "[" + ", ".join(f"'{t}'" for t in CHUNK_TYPES) + "]"
_VIEWS = "[" + ", ".join(f"'{t}'" for t in WORLDVIEWS) + "]"
#: `chunks`, `usage` and `pricing` as the members of a with clause.
CHUNKS_SQL = f"""
chunks as (select *, case when chunk_type in ('book', 'secondary_book') then '__shared__' else 'main' end as rag_partition,
    case when chunk_type = 'quote_explanation' then 'doc-' || (doc_id - 1) end as parent_id,
    case when worldview is not null then [worldview] end as worldviews
  from (select doc_id, 'doc-' || doc_id as chunk_id, {_TYPES}[doc_id % 9 + 1] as chunk_type, source as source_id,
    'Volume ' || substr(source, 4) as source_title, 'seg-' || (doc_id // 50) as segment_id, 'Chapter ' || (doc_id // 50) as segment_title,
    (doc_id % 50)::int as source_index, case doc_id % 4 when 0 then 'Author A' when 1 then 'Author B' when 2 then 'Author C' end as author,
    case when doc_id % 5 <> 0 then {_VIEWS}[doc_id % 12 + 1] end as worldview, lang as language, text, sha256(text) as content_hash,
    timestamp '2024-01-01' + to_minutes(doc_id) as updated_at,
    case when doc_id % 3 <> 0 then timestamp '2024-01-01' + to_minutes(doc_id) end as embedded_at,
    case when doc_id % 7 = 0 then timestamp '2024-01-01' + to_minutes(doc_id) end as deprecated_at from documents))"""
USAGE_SQL = """
usage as (select event_id as id, user_id as account_id, event_type as model, floor(value)::bigint as prompt_tokens,
    try_cast(props ->> '$.k' as bigint) as completion_tokens, ts as created_at from events),
pricing as (select * from (values ('click', 0.27, 1.10), ('view', 0.55, 2.19), ('purchase', 0.14, 0.28), ('deepseek-chat', 0.435, 0.87))
    t(model, prompt_per_1m_usd, completion_per_1m_usd))"""
TURNS_SQL = "turns as (select conv_id as talk_id, turn as turn_index, role, text from conversations)"
