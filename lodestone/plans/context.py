"""Packing ranked hits into a context of bounded length, and numbering citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import CONTEXT_CHARS

def per_query():
    return Window.partitionBy("query_id")


def pack(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, rank, chunk_id, text, cum, packed: hits in order until the budget would be exceeded, then none.

    Lengths are positive, so sums only grow and the first overflow ends the context. The hit that overflows is
    still listed (packed false), the ones behind it are not.
    """
    texts = hits.withColumn("text", strip(F.col("text"))).where("text != ''")
    upto = F.sum(F.length("text")).over(per_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    summed = texts.withColumn("cum", upto).withColumn("packed", F.col("cum") <= budget)
    return summed.where(F.col("packed") | (F.col("cum") - F.length("text") <= budget)).select("query_id", "rank", "chunk_id", "text", "cum", "packed")


def pack_numbered(hits: DataFrame, budget: int = CONTEXT_CHARS, start: int = 1, with_score: bool = False) -> DataFrame:
    """query_id, n, chunk_id, line: `[n] text`, optionally with score and type; the rendered lines count."""
    texts = hits.withColumn("text", strip(F.col("text"))).where("text != ''").withColumn("n", F.row_number().over(per_query().orderBy("rank")) + start - 1)
    kind = F.when(F.coalesce("chunk_type", F.lit("")) != "", F.concat(F.lit(", "), "chunk_type")).otherwise("")
    score = F.concat(F.lit(" (r: "), F.format_string("%.4f", F.round("score", 4)), kind, F.lit(")")) if with_score else F.lit("")
    lines = texts.withColumn("line", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]"), score, F.lit(" "), "text"))
    upto = F.sum(F.length("line")).over(per_query().orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("cum", upto).where(F.col("cum") <= budget).select("query_id", "n", "chunk_id", "line")


def context_text(packed: DataFrame, line: str = "text", order: str = "rank", separator: str = "\n\n") -> DataFrame:
    """One string a query; at most a budget of characters meets in a group."""
    return packed.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), separator).alias("context"))


def renumber(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """answer_id, answer, order: marks [n] of known citations numbered anew by first appearance; others stay.

    answers: answer_id, answer; cited: answer_id, n. All of it happens in the answer's row.
    """
    known = cited.groupBy("answer_id").agg(F.collect_set("n").alias("known"))
    seen = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int")))
    rows = answers.join(known, "answer_id", "left").withColumn("order", F.filter(seen, lambda n: F.array_contains(F.coalesce("known", F.array().cast("array<int>")), n)))
    # Split before every mark; each part begins with at most one mark.
    parts = F.split("answer", r"(?=\[\d{1,6}\])", -1)

    def anew(part):
        n = F.regexp_extract(part, r"^\[(\d{1,6})\]", 1)
        at = F.array_position("order", n.try_cast("int"))
        return F.when((n != "") & (at > 0), F.concat(F.lit("["), at.cast("string"), F.lit("]"), F.regexp_replace(part, r"^\[\d{1,6}\]", ""))).otherwise(part)

    return rows.withColumn("answer", F.array_join(F.transform(parts, anew), "")).select("answer_id", "answer", "order")
