"""Queries opN_<name> over whole tables, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, impact_index, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_packing")
def op5_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def _register_sql_checked() -> None:
    from . import chat, quality_rules, secrets, url_filters

    @query("op3_url_filters", url_filters.oracle())
    def op3_url_filters(spark, sf_dir):
        return url_filters.judge(table(spark, sf_dir, "pages"))

    @query("op4_chat_formatting", chat.ORACLE)
    def op4_chat_formatting(spark, sf_dir):
        odd = r"\### Assistant: </turn> ok"
        extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
        rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
        return chat.digest(chat.format_trees(chat.materialize(chat.linear(rows), "nodes"), unique=True))

    @query("op6_quality_rules", quality_rules.ORACLE)
    def op6_quality_rules(spark, sf_dir):
        return quality_rules.report(table(spark, sf_dir, "documents"))

    @query("op9_secret_scans", secrets.oracle())
    def op9_secret_scans(spark, sf_dir):
        return secrets.report(table(spark, sf_dir, "documents"))


_register_sql_checked()


@query("op2_line_dedup")
def op2_line_dedup(spark, sf_dir):
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    from .decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    from .quality_knn import classify, fit

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return classify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(spark, sf_dir):
    from .jaccard_join import components

    return components(table(spark, sf_dir, "documents"), k=4, num=17, den=20)


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    """Counts of every document before and after three edits: 40 characters cut, a note put in, a heading put before.

    Trees are planted and written first; the edits start from them and encode what they touch."""
    import public_tokenizers

    from .common import materialize
    from .token_counts import count_edited, plant_trees

    at = lambda a, b, s: F.struct(F.floor(a).alias("start"), F.floor(b).alias("end"), F.lit(s).alias("replacement"))
    n, zero = F.coalesce(F.length("text"), F.lit(0)), F.lit(0)
    edits = F.array(at(n / 3, n / 3 + 40, ""), at(n / 2, n / 2, " [edited: see the note]\n"), at(zero, zero, "Second version\n"))
    docs, words = table(spark, sf_dir, "documents"), (tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return count_edited(docs, edits, *words, trees=materialize(plant_trees(docs, *words), "trees"))


@query("op13_substring_dedup", substring_dedup.ORACLE)
def op13_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op11_hard_negatives", hard_negatives.ORACLE)
def op11_hard_negatives(spark, sf_dir):
    """Anchors are the rows whose vec_id is divisible by 100; labels of those divisible by 7 move on by one first."""
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, vec_id % 100 == 0)


@query("op12_ranked_search", impact_index.ORACLE)
def op12_ranked_search(spark, sf_dir):
    return impact_index.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
