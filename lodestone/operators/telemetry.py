"""Runs that leave their figures in a table: rows, seconds and counts that the job itself has observed."""

from __future__ import annotations

import logging
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SCHEMA = "run_id string, kind string, name string, at timestamp, seconds double, rows long, figures map<string,double>, error string"
_log = logging.getLogger(__name__)


def append(df: DataFrame, sink: str) -> None:
    """Best effort: what has been done does not fail because its figures could not be kept."""
    try:
        df.write.mode("append").parquet(sink)
    except Exception:
        _log.warning("figures were not kept in %s", sink, exc_info=True)


def recorded(df: DataFrame, path: str, sink: str, kind: str, name: str, **figures: Column) -> DataFrame:
    """df, written to `path` and read back; a row about the run is added to the table `sink`.

    figures: aggregates of df, computed by the job that writes it. A run that fails leaves a row with its error, and raises.
    """
    spark, began, seen = df.sparkSession, time.time(), Observation()
    found, error = {}, None
    try:
        df.observe(seen, F.count("*").alias("rows"), *[c.cast("double").alias(n) for n, c in figures.items()]).write.parquet(path)
        found = seen.get
        return spark.read.schema(df.schema).parquet(path)
    except Exception as e:
        error = str(e).splitlines()[0][:500]
        raise
    finally:
        row = (uuid.uuid4().hex, kind, name, time.time() - began, found.get("rows"), {n: found[n] for n in figures if found.get(n) is not None}, error)
        names = "run_id string, kind string, name string, seconds double, rows long, figures map<string,double>, error string"
        append(spark.createDataFrame([row], names).withColumn("at", F.current_timestamp()).select("run_id", "kind", "name", "at", "seconds", "rows", "figures", "error"), sink)


def evaluation(questions: DataFrame, answers: DataFrame, references: DataFrame, path: str) -> None:
    """One JSON record for each question, with its answer and its references in order; answered or not."""
    refs = references.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]).alias("references"))
    questions.join(answers, "query_id", "left").join(refs, "query_id", "left").select(
        "query_id", "question", "answer", F.coalesce("references", F.array().cast("array<string>")).alias("references")).write.json(path)
