"""Fusing, reranking and choosing between ranked lists. A ranked list has query_id, rank (from 1), chunk_id, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vectors import dot
from ..schemas import FUSED, RRF_K

def per_query():
    return Window.partitionBy("query_id")


def rrf(first: DataFrame, second: DataFrame, k: int = FUSED, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (constant + rank); ties keep the order of first appearance."""
    both = first.select("query_id", "chunk_id", "rank", F.lit(0).alias("list")).union(second.select("query_id", "chunk_id", "rank", F.lit(1).alias("list")))
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    ranked = fused.withColumn("rank", F.row_number().over(per_query().orderBy(F.desc("score"), "seen")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def slots(dense: DataFrame, sparse: DataFrame, k: int, k_sparse: int = 0) -> DataFrame:
    """The first k - k_sparse dense hits, then sparse hits that are not among them, up to k."""
    k_sparse = k_sparse or max(2, k // 3)
    head = dense.where(F.col("rank") <= k - k_sparse)
    tail = sparse.join(head.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = head.select("query_id", "chunk_id", "score", F.lit(0).alias("list"), "rank").union(tail.select("query_id", "chunk_id", "score", F.lit(1).alias("list"), "rank"))
    ranked = both.withColumn("rank", F.row_number().over(per_query().orderBy("list", "rank")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def ordered_union(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """All of the first list, then what the second adds, cut to k where the first list has any hit for the query."""
    has = first.select("query_id").distinct().withColumn("has", F.lit(True))
    tail = second.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = first.select("query_id", "chunk_id", "score", F.lit(0).alias("list"), "rank").union(tail.select("query_id", "chunk_id", "score", F.lit(1).alias("list"), "rank"))
    ranked = both.withColumn("rank", F.row_number().over(per_query().orderBy("list", "rank"))).join(has, "query_id", "left")
    return ranked.where((F.col("rank") <= k) | F.col("has").isNull()).select("query_id", "rank", "chunk_id", "score")


def rerank(hits: DataFrame, k: int, query_vector: str = "query_embedding", vector: str = "embedding") -> DataFrame:
    """By the dot product of the query's and the passage's vector, then by the former rank; scores stay as they were."""
    again = hits.withColumn("__dot", F.round(dot(F.col(query_vector), F.col(vector)), 9))
    return again.withColumn("rank", F.row_number().over(per_query().orderBy(F.desc("__dot"), "rank"))).where(F.col("rank") <= k).drop("__dot")


def widened(base: DataFrame, wide: DataFrame, k_final: int, least_chars: int = 400) -> DataFrame:
    """The base list, or the wide one for queries whose base list has too few hits or too little text."""
    enough = base.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).where(
        (F.col("n") >= k_final) & (F.col("chars") >= least_chars)).select("query_id")
    return base.join(enough, "query_id", "left_semi").withColumn("widened", F.lit(False)).unionByName(
        wide.join(enough, "query_id", "left_anti").withColumn("widened", F.lit(True)))


def better(first: DataFrame, second: DataFrame) -> DataFrame:
    """query_id, choice: `second` where it has more hits, or as many and more text."""
    size = lambda df, p: df.groupBy("query_id").agg(F.struct(F.count("*"), F.sum(F.length("text"))).alias(p))
    return size(first, "a").join(size(second, "b"), "query_id", "full").select(
        "query_id", F.when(F.col("a").isNull() | (F.col("b") > F.col("a")), "second").otherwise("first").alias("choice"))


def first_sufficient(stages: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """Hits of the first stage (name, hits, least count) that has enough for the query."""
    every = None
    for i, (name, hits, least) in enumerate(stages):
        part = hits.withColumn("stage", F.lit(name)).withColumn("__no", F.lit(i)).withColumn("__least", F.lit(least))
        every = part if every is None else every.unionByName(part)
    enough = every.groupBy("query_id", "__no", "__least").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("__least"))
    chosen = enough.groupBy("query_id").agg(F.min("__no").alias("__no"))
    return every.join(chosen, ["query_id", "__no"], "left_semi").drop("__no", "__least")


def sufficiency_by_score(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, sufficiency of every query: high for three scores above 0.7, medium for two hits or one above 0.5, insufficient
    without a hit, else low."""
    counted = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0.7).alias("strong"), F.count_if(F.col("score") > 0.5).alias("fair"))
    counted = queries.select("query_id").join(counted, "query_id", "left").na.fill(0, ["n", "strong", "fair"])
    level = F.when(F.col("n") == 0, "insufficient").when(F.col("strong") >= 3, "high").when((F.col("n") >= 2) | (F.col("fair") > 0), "medium").otherwise("low")
    return counted.select("query_id", level.alias("sufficiency"))


def text_level(chars: Column, hits: Column) -> Column:
    return F.when((chars < 200) | (hits == 0), "low").when((chars >= 2000) & (hits >= 3), "high").when(chars >= 600, "medium").otherwise("low")


def sufficiency_by_text(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n, chars, sufficiency of every query by the number and the length of its hits."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length(strip(F.col("text")))).alias("chars"))
    n = queries.select("query_id").join(n, "query_id", "left").na.fill(0, ["n", "chars"])
    return n.select("query_id", "n", "chars", text_level(F.col("chars"), F.col("n")).alias("sufficiency"))
