"""First-of-key, best-of-key, cap-per-key and chain operators: windows over one key, never over the whole table. A key
that may hold a large part of all rows is counted through in parts (`running`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def batch_first(df: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """The first row of a key in a batch, unless a later one is strictly newer."""
    return first_per(df, keys, F.desc_nulls_last("updated_at"), F.asc(position))


def best_hit(df: DataFrame, position: str = "rank", by: list[str] | None = None) -> DataFrame:
    """The best-scored row of each chunk, at its own position; rows without an id go."""
    return first_per(df.where("trim(chunk_id) != ''"), [*(by or []), "chunk_id"], F.desc("score"), F.asc(position))


def exact_duplicates(df: DataFrame, position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(first row of each (chunk_id, content_hash), counts requested / kept / duplicates)."""
    kept = first_per(df, ["chunk_id", "content_hash"], F.asc(position))
    counts = df.groupBy("chunk_id", "content_hash").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requested"), F.count("*").alias("kept"))
    return kept, counts.withColumn("duplicates", F.col("requested") - F.col("kept"))


def cap_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def cap_type(df: DataFrame, chunk_type: str = "chapter_summary", n: int = 3, by: str = "query_id", order: str = "rank") -> DataFrame:
    """At most n rows of one type; the others are not counted."""
    seen = F.sum(F.when(F.col("chunk_type") == chunk_type, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__n", seen).where((F.col("chunk_type") != chunk_type) | F.col("chunk_type").isNull() | (F.col("__n") <= n)).drop("__n")


def continuation(rows: DataFrame, anchors: DataFrame, reach: int = 120) -> DataFrame:
    """Rows of the anchor's segment with the indices right after it, up to the first gap and at most `reach` on.

    anchors: segment_id, max_index. Consecutive indices less their row number are constant up to the gap.
    """
    near = rows.join(anchors, "segment_id").where("source_index > max_index and source_index <= max_index + " + str(reach))
    at = Window.partitionBy("segment_id").orderBy("source_index")
    return near.withColumn("__n", F.row_number().over(at)).where("source_index = max_index + __n").drop("__n", "max_index")


def one_per_segment(hits: DataFrame, limit: int, by: str) -> DataFrame:
    """Longest term first, one hit a segment, at most `limit` a query."""
    one = first_per(hits, [by, "segment_id"], F.desc(F.length("term")), F.asc("term"), F.asc("chunk_id"))
    return cap_per(one, [by], limit, F.desc(F.length("term")), F.asc("term"), F.asc("chunk_id"))


def last_per(df: DataFrame, key: str, position: str, n: int) -> DataFrame:
    return cap_per(df, [key], n, F.desc(position))


def next_index(new_turns: DataFrame, stored: DataFrame) -> DataFrame:
    """New rows (talk_id, pos) numbered after the highest stored turn_index of their talk; from 0 where there is none."""
    top = stored.groupBy("talk_id").agg(F.max("turn_index").alias("top"))
    n = F.row_number().over(Window.partitionBy("talk_id").orderBy("pos"))
    return new_turns.join(top, "talk_id", "left").withColumn("turn_index", F.coalesce(F.col("top") + n, n - 1).cast("long")).drop("top")


def ordered_distinct(df: DataFrame, value: str, position: str, by: str) -> DataFrame:
    """First spelling of each value, letters compared without case."""
    return first_per(df.withColumn("__k", F.lower(value)), [by, "__k"], F.asc(position)).drop("__k")


def running(df: DataFrame, by: str, order: str, values: list[str], parts: int | None = None) -> DataFrame:
    """df with `n` (place of the row within `by`, from 1, in the order of `order`) and `upto_<value>` (sums up to the row).

    Rows are dealt by ranges of (by, order) and counted through within each range; what the ranges before have of the same
    key comes from one row for each key and range. So no key is gathered in one task, however many rows it has. `order` is
    unique within `by`.
    """
    from ..sources.scratch import written

    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, by, order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(by, "__part").agg(F.count("*").alias("__n"), *[F.sum(v).alias(f"__{v}") for v in values])
    offsets = sums.select(by, "__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in ("n", *values)])
    counted = dealt.withColumns({"n": F.count(F.lit(1)).over(inside), **{f"upto_{v}": F.sum(v).over(inside) for v in values}})
    key = F.col(f"o.{by}").eqNullSafe(F.col(f"c.{by}")) & (F.col("o.__part") == F.col("c.__part"))
    joined = counted.alias("c").join(offsets.alias("o"), key)
    return joined.select(*[f"c.{c}" for c in df.columns], (F.col("n") + F.col("o.__n")).alias("n"), *[(F.coalesce(f"upto_{v}", F.lit(0)) + F.col(f"o.__{v}")).alias(f"upto_{v}") for v in values])
