"""Sparse retrieval: BM25 over the occurrences of the queries' terms, found in one pass over the texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.scratch import folder

K1, B = 1.2, 0.75
#: Query terms up to this number are tested in the scan itself; beyond, occurrences are joined to them.
TESTED_TERMS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a table in one file of one row group would keep one core busy."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few else df


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, w: how often each query holds each term."""
    return queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("w"))


class Split(NamedTuple):
    """Chunks without their texts, with `len` and `held`: the words of a text that are terms of queries, repeats included, or all words (`every`)."""

    rows: DataFrame
    every: bool


def split(chunks: DataFrame, wanted: DataFrame) -> Split:
    """chunks split for the wanted terms: written once, for any number of searches."""
    spark = chunks.sparkSession
    terms = wanted.select("term").distinct()
    some = [r["term"] for r in terms.limit(TESTED_TERMS + 1).collect()]
    kept = F.filter("held", lambda w: w.isin(some)) if len(some) <= TESTED_TERMS else F.col("held")
    docs = spread(chunks).withColumn("held", words(F.col("text"))).drop("text").withColumn("len", F.size("held").cast("double"))
    path = folder(spark, "occurrences")
    docs.withColumn("held", kept).write.parquet(path)
    return Split(spark.read.parquet(path), len(some) > TESTED_TERMS)


def occurrences(held: Split, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, len, term, tf) of the wanted terms, and maybe others, in texts that are split, and one row with n and avg_len over all of them."""
    each = held.rows.select("chunk_id", "len", F.explode("held").alias("term"))
    each = each.join(wanted.select("term").distinct(), "term", "left_semi") if held.every else each  # a few others cost less than this
    return each.groupBy("chunk_id", "len", "term").agg(F.count("*").cast("double").alias("tf")), held.rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def bm25(chunks: DataFrame | Split, queries: DataFrame, idf: bool = True) -> DataFrame:
    """query_id, chunk_id, score (six decimals) of all chunks that share a term with the query. chunks: with texts, or `split` before."""
    wanted = query_terms(queries)
    held = chunks if isinstance(chunks, Split) else split(chunks.select("chunk_id", "text"), wanted)
    posts, stats = occurrences(held, wanted)
    df = posts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    weight = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) if idf else F.lit(1.0)
    weighted = wanted.join(df.select("term", weight.alias("idf"), "avg_len"), "term")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return posts.join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("idf") * tf), 6).alias("score"))


def sparse_top(chunks: DataFrame | Split, queries: DataFrame, fetch: int, idf: bool = True) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return bm25(chunks, queries, idf).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= fetch).select("query_id", "rank", "chunk_id", "score")


def sparse_retrieve(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, held: Split | None = None) -> DataFrame:
    """The best k chunks of each query. held: the chunks `split` before, so that several searches read the texts once."""
    from ..operators.filters import cap_hits
    from ..schemas import overfetch
    from .dense import with_payload

    inside = lambda rows: rows if where is None else rows.where(where)
    scope = inside(chunks)
    return cap_hits(with_payload(sparse_top(scope if held is None else Split(inside(held.rows), held.every), queries, overfetch(k)), scope, "text", "chunk_type", "source_id", "source_title", "author", "parent_id"), k)
