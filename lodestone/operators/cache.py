"""Results of costly calls, kept by what they depend on: content and configuration."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cache_key(path: Column, text: Column, config: dict, manual: Column | None = None) -> Column:
    """A digest of file path, content, manual metadata (JSON) and configuration."""
    settings = F.sha2(F.lit(json.dumps(config, sort_keys=True)), 256)
    return F.sha2(F.to_json(F.struct(
        path.alias("file_path"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash"), (manual if manual is not None else F.lit("{}")).alias("manual_metadata"), settings.alias("config_hash"))), 256)


def cached(rows: DataFrame, key: Column, cache: str, compute: Callable[[], Callable[[str], dict]], schema: T.StructType, text: str = "text", calls=None) -> DataFrame:
    """rows with the fields of schema and `from_cache`; `compute` (made once a task) is called for texts whose key the table
    `cache` does not hold, once a key, and its results are added to the table.

    calls: an accumulator that counts them. A job that fails adds nothing, so the next one computes anew.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    kept = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("run", T.StringType()), *schema.fields])
    spark.createDataFrame([], kept).write.mode("append").parquet(cache)
    keyed = rows.withColumn("cache_key", key)
    known = spark.read.schema(kept).parquet(cache)
    misses = keyed.select("cache_key", F.col(text).alias("text")).join(known.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])

    def extract(batches):
        import pandas as pd

        call = compute()
        for b in batches:
            found = pd.DataFrame([call(t or "") for t in b["text"]], columns=schema.names)
            if calls is not None:
                calls.add(len(b))
            yield pd.concat([b[["cache_key"]].reset_index(drop=True).assign(run=run), found], axis=1)

    misses.mapInPandas(extract, kept).write.mode("append").parquet(cache)
    known = spark.read.schema(kept).parquet(cache).dropDuplicates(["cache_key"])  # two runs at a time may both have computed a key
    return keyed.join(known, "cache_key").withColumn("from_cache", F.col("run") != run).drop("cache_key", "run")
