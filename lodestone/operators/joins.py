"""Joins of hits with what they cite: parents, paragraphs, terms and lemmas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, lemma_variants
from .ranking import cap_per, first_per


def _parents(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("__pid"), F.col("chunk_type").alias("__ptype"))


def swap_or_drop(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Explanations become their parent quote, and go if there is none; other hits stay. Scores and places stay."""
    joined = hits.join(_parents(chunks), F.col("parent_id") == F.col("__pid"), "left")
    swap = F.col("chunk_type") == "quote_explanation"
    return joined.where(~F.coalesce(swap, F.lit(False)) | (F.col("__ptype") == "quote")).withColumn(
        "chunk_id", F.when(swap, F.col("__pid")).otherwise(F.col("chunk_id"))).withColumn(
        "chunk_type", F.when(swap, F.lit("quote")).otherwise(F.col("chunk_type"))).drop("__pid", "__ptype")


def swap_once(hits: DataFrame, chunks: DataFrame, by: str = "query_id") -> DataFrame:
    """As swap_or_drop, and an explanation also goes if its quote is a hit itself or has been swapped in before."""
    own = hits.where("chunk_type != 'quote_explanation'").select(F.col(by).alias("__q"), F.col("chunk_id").alias("__c"))
    explained = hits.where("chunk_type = 'quote_explanation'").join(own, (F.col(by) == F.col("__q")) & (F.col("parent_id") == F.col("__c")), "left_anti")
    once = first_per(explained, [by, "parent_id"], F.asc("rank"))
    return swap_or_drop(hits.where("chunk_type != 'quote_explanation'").unionByName(once), chunks)


def swap_or_keep(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Explanations become their parent where it exists; otherwise they stay as they are."""
    joined = hits.join(_parents(chunks), F.col("parent_id") == F.col("__pid"), "left")
    swap = (F.col("chunk_type") == "quote_explanation") & F.col("__pid").isNotNull()
    return joined.withColumn("chunk_id", F.when(swap, F.col("__pid")).otherwise(F.col("chunk_id"))).withColumn(
        "chunk_type", F.when(swap, F.col("__ptype")).otherwise(F.col("chunk_type"))).drop("__pid", "__ptype")


def lowest_paragraph(links: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """chunk_id, paragraph_id: the active paragraph with the lowest number. An aggregate, so it combines before the shuffle."""
    active = paragraphs.where("deleted_at is null").select("paragraph_id", "paragraph_number")
    return links.join(active, "paragraph_id").groupBy("chunk_id").agg(F.min(F.struct("paragraph_number", "paragraph_id")).alias("x")).select(
        "chunk_id", "x.paragraph_id", "x.paragraph_number")


def held_candidates(texts: DataFrame, needles: DataFrame, by: tuple[str, ...] = (), q: int = 8) -> DataFrame:
    """`by`, hash, needle: the needles that a text (by its xxhash64) may hold; callers check with contains().

    texts: text and `by`; needles: needle and `by`. A needle is keyed by its first q characters, or by itself if it is
    shorter, and joined with the runs of that length in each text, so texts and needles are never all paired. Empty
    needles are in nothing.
    """
    keyed = needles.where("needle != ''").select(*by, "needle", F.substring("needle", 1, q).alias("__g")).distinct()
    lengths = keyed.select(F.length("__g").alias("__l")).distinct()  # at most q rows
    grams = F.regexp_extract_all("text", F.concat(F.lit("(?s)(?=(.{"), F.col("__l").cast("string"), F.lit("}))")), F.lit(1))
    runs = texts.select(*by, "text").crossJoin(F.broadcast(lengths)).select(*by, F.xxhash64("text").alias("hash"), F.explode(F.array_distinct(grams)).alias("__g"))
    return runs.join(keyed, [*by, "__g"]).select(*by, "hash", "needle").distinct()


def term_hits(prompts: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms (chunk_id, segment_id, term) that a prompt holds anywhere, also within a word, letters compared without case."""
    from ..sources.scratch import written

    low = F.lower("prompt")
    # Written, so that the planner knows how few they are: then they are sent to the texts' runs, not the runs to them.
    needles = written(terms.select(F.lower("term").alias("needle")).distinct(), "needles")
    found = held_candidates(prompts.select(low.alias("text")), needles)
    hits = prompts.select("query_id", "prompt", F.xxhash64(low).alias("hash")).join(found, "hash").where(low.contains(F.col("needle")))
    return hits.join(terms.withColumn("needle", F.lower("term")), "needle").drop("needle", "hash")


def capped_terms(terms: DataFrame, limit: int) -> DataFrame:
    """The terms (chunk_id, segment_id, term) that `one_per_segment` may keep if it takes `limit` hits a query.

    Before a term's hits at most `limit` - 1 segments are taken, so `limit` of its segments are enough: those with the
    smallest chunk_id of that term, and there the smallest one. So a prompt's hits do not grow with the number of chunks.
    """
    one = terms.groupBy("term", "segment_id").agg(F.min("chunk_id").alias("chunk_id"))
    return cap_per(one, ["term"], limit, F.asc("chunk_id")).select("chunk_id", "segment_id", "term")


def lemma_matches(prompts: DataFrame, lemmas: DataFrame, limit: int = 10, least: int = 3) -> DataFrame:
    """query_id, pos, chunk_id: words of a prompt that are lemmas, as they stand or without `-en`; the first `limit`.

    lemmas: lemma, chunk_id. The exact form wins over the shortened one.
    """
    words = prompts.select("query_id", F.posexplode(F.regexp_extract_all(F.lower("prompt"), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("pos", "w")).where(F.length("w") >= least)
    forms = words.select("query_id", "pos", F.posexplode(lemma_variants(F.col("w"))).alias("form", "lemma"))
    found = first_per(forms.join(lemmas, "lemma"), ["query_id", "pos"], F.asc("form"), F.asc("chunk_id"))
    once = first_per(found, ["query_id", "chunk_id"], F.asc("pos"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return once.withColumn("n", n).where(F.col("n") <= limit).select("query_id", "pos", "lemma", "chunk_id")


def _unique_part(quotes: DataFrame, paragraphs: DataFrame, q: int = 24) -> DataFrame:
    """segment_id, norm, d: the only paragraph of the segment whose text holds the quote's or is held by it.

    None where the segment has equal texts, one or several, and none for empty texts.
    """
    at = ["segment_id", "norm"]
    mine = quotes.select(*at).where("norm != ''").distinct().join(paragraphs.select(*at), at, "left_anti").withColumn("hash", F.xxhash64("norm"))
    theirs = paragraphs.select("segment_id", "paragraph_id", F.col("norm").alias("other"), F.xxhash64("norm").alias("other_hash")).where("other != ''")
    mine_text, other_text = mine.select("segment_id", F.col("norm").alias("text")), theirs.select("segment_id", F.col("other").alias("text"))
    inside = held_candidates(other_text, mine.select("segment_id", F.col("norm").alias("needle")), ("segment_id",), q).select("segment_id", F.xxhash64("needle").alias("hash"), F.col("hash").alias("other_hash"))
    around = held_candidates(mine_text, theirs.select("segment_id", F.col("other").alias("needle")), ("segment_id",), q).select("segment_id", "hash", F.xxhash64("needle").alias("other_hash"))
    pairs = inside.union(around).distinct().join(mine, ["segment_id", "hash"]).join(theirs, ["segment_id", "other_hash"])
    held = pairs.where(F.col("other").contains(F.col("norm")) | F.col("norm").contains(F.col("other")))
    return held.groupBy(*at).agg(F.count("*").alias("n"), F.min("paragraph_id").alias("d")).where("n = 1").drop("n")


def match_quotes(quotes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """quote_id, paragraph_id, how: by chunk id, content hash, unique normal text in the segment, else the unique one there that holds the text or is held by it.

    quotes: quote_id, chunk_id, content_hash, segment_id, text; paragraphs: paragraph_id, chunk_id, content_hash, segment_id, text.
    """
    one = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("paragraph_id").alias("hit")).where("n = 1").drop("n")
    normal = F.lower(collapse(F.regexp_replace("text", r"\[[^\]]*\]", "")))
    p = paragraphs.withColumn("norm", normal)
    by_id = one(p, ["chunk_id"]).withColumnRenamed("hit", "a")
    by_hash = one(p, ["content_hash"]).withColumnRenamed("hit", "b")
    by_text = one(p, ["segment_id", "norm"]).withColumnRenamed("hit", "c")
    by_part = _unique_part(quotes.withColumn("norm", normal), p)
    joined = quotes.withColumn("norm", normal).join(by_id, "chunk_id", "left").join(by_hash, "content_hash", "left").join(by_text, ["segment_id", "norm"], "left").join(by_part, ["segment_id", "norm"], "left")
    how = F.when(F.col("a").isNotNull(), "chunk_id").when(F.col("b").isNotNull(), "content_hash").when(F.col("c").isNotNull(), "text").when(F.col("d").isNotNull(), "part")
    return joined.select("quote_id", F.coalesce("a", "b", "c", "d").alias("paragraph_id"), how.alias("how"))
