"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Every stage but the last returns the columns of documents, further ones included, whatever their names. Odd rows: a null
or empty text fails the quality rules and goes there; a stage that is run by itself keeps such rows, and packing gives them
a piece of one token. Rows with a null doc_id are judged by their texts: line dedup takes them before all others, the
Jaccard join keeps them all, decontamination and packing treat them like others. Rows that repeat both id and text get
the same decisions; of those the Jaccard join keeps one, and of one id with several texts each text is judged by itself.
Very long texts are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialize, scratch, unused
from lodestone.llm.decontamination import drop_contaminated
from lodestone.llm.jaccard_join import keep_one
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.packing import pack
from lodestone.llm.quality_rules import filter_quality
from lodestone.llm.queries import table, tokenizer_path


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rule or lie beyond their group's thresholds go."""
    return filter_quality(docs)


def line_dedup(spark, docs, sf_dir):
    """Later copies of repeated runs of lines go; n_chars follows the text."""
    aside, = unused(docs, "lines_removed_")
    cut = dedup_lines(docs.withColumnRenamed("lines_removed", aside)).drop("lines_removed").withColumnRenamed(aside, "lines_removed")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies stays: five words, a similarity of 0.8 or more."""
    return keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item, up to the edit budget, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination), ("packing", packing),
]
#: Tokenizer ids and column generation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. Each stage is written; what it and the one before it wrote on the way is removed then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch() as kept:
            docs = materialize(stage(spark, before, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        discard(before)
    return docs
