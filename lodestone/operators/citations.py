"""What is shown of hits: flat results, citations, navigation fields, references and context of a paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..schemas import NAVIGATION_TYPES, NO_AUTHORS, REFERENCE_CHARS, SHARED_PARTITION, SHARED_TYPES
from .ranking import first_per

CITATION_FIELDS = ["source_id", "source_title", "segment_title", "lecture_date", "chunk_type", "source_type", "author", "book_title", "venue", "vortragstitel", "paragraph_id", "parent_id"]


def _filled(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def shown_book(book: str = "book_title", source: str = "source_title", segment: str = "segment_title") -> Column:
    """The book's title, else the source's where it differs from the chapter's and neither is blank."""
    apart = _filled(source).isNotNull() & _filled(segment).isNotNull() & (F.trim(source) != F.trim(segment))
    return F.coalesce(F.nullif(F.col(book), F.lit("")), F.when(apart, F.trim(source)))


def flat_results(hits: DataFrame) -> DataFrame:
    """One flat row a hit. Summaries keep their parent and place, quotes their text and author; assistants are no authors."""
    quote, summary = F.col("chunk_type").isin("quote", "quote_explanation"), F.col("chunk_type") == "chapter_summary"
    book = shown_book()
    return hits.select(
        "chunk_id", F.coalesce("source_id", F.lit("")).alias("source_id"), "segment_id", F.coalesce(book, "source_title").alias("title"), book.alias("book_title"),
        "segment_title", snippet(F.col("text")).alias("snippet"), "chunk_type", F.when(~F.coalesce(F.lower(F.trim("author")).isin(NO_AUTHORS), F.lit(False)), F.col("author")).alias("author"),
        F.when(summary, _filled("parent_id")).alias("parent_id"), F.when(summary, F.coalesce("source_index", "segment_index")).alias("source_index"),
        F.when(quote, F.col("text")).alias("quote_text"), F.when(quote, F.col("author")).alias("quote_author"))


def citation_fields(hits: DataFrame) -> DataFrame:
    """Fourteen fields of a citation; what is missing is empty, only the chapter's number stays null."""
    have = set(hits.columns)
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in CITATION_FIELDS]
    return hits.select("chunk_id", *text, F.col("segment_index") if "segment_index" in have else F.lit(None).cast("int").alias("segment_index"))


def provenance(hits: DataFrame) -> DataFrame:
    """Where hits come from, without their texts."""
    return hits.select("chunk_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source_id", "source_title", "segment_title", "chunk_type", "author")])


def quote_navigation(hits: DataFrame) -> DataFrame:
    """chunk_id, paragraph_number, paragraph_id, quote_span, quote_verified: whole numbers only, spans with both ends only."""
    whole = F.col("quote_span.start").isNotNull() & F.col("quote_span.end").isNotNull()
    return hits.select("chunk_id", F.col("paragraph").try_cast("int").alias("paragraph_number"), _filled("paragraph_id").alias("paragraph_id"),
                       F.when(whole, F.col("quote_span")).alias("quote_span"), "quote_verified")


def display_name(author: Column, title: Column) -> Column:
    """`author: title`, or whichever there is."""
    a, t = F.coalesce(author, F.lit("")), F.coalesce(title, F.lit(""))
    return F.when((a != "") & (t != ""), F.concat(a, F.lit(": "), t)).when(t != "", t).otherwise(a)


def navigable(hits: DataFrame, links: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """hits with the paragraph to open, its own source, and whether a hit that should have one has none.

    hits: chunk_id, chunk_type, source_id, paragraph_id; links: chunk_id, paragraph_id; paragraphs: paragraph_id,
    paragraph_number, source_id, deleted_at.
    """
    from .joins import lowest_paragraph

    lowest = lowest_paragraph(links, paragraphs).select("chunk_id", F.col("paragraph_id").alias("__lowest"))
    live = paragraphs.where("deleted_at is null").select(F.col("paragraph_id").alias("__pid"), F.col("source_id").alias("__source"))
    found = hits.join(lowest, "chunk_id", "left").withColumn("paragraph_id", F.coalesce(_filled("paragraph_id"), "__lowest"))
    found = found.join(live, F.col("paragraph_id") == F.col("__pid"), "left")
    opens = F.coalesce(F.col("chunk_type").isin(NAVIGATION_TYPES), F.lit(False))
    return found.withColumn("source_id", F.when(opens, F.coalesce("__source", "source_id")).otherwise(F.col("source_id"))).withColumn(
        "navigation_error", opens & F.col("paragraph_id").isNull()).drop("__lowest", "__pid", "__source")


def paragraph_context(requests: DataFrame, chunks: DataFrame, collection: str) -> DataFrame:
    """query_id, chunk_id, source_index, fallback: the chunks of the requested source and segment that hold the paragraph,
    or all of them where none does.

    requests: query_id, source_id, segment_id, paragraph (null: everything). A paragraph `n|` begins a text or follows a
    blank line.
    """
    scope = (F.col("rag_partition") == collection) | ((F.col("rag_partition") == SHARED_PARTITION) & F.col("chunk_type").isin(SHARED_TYPES))
    rows = requests.join(chunks.where(scope), ["source_id", "segment_id"])
    mark = F.concat(F.lit("\n\n"), F.col("paragraph").cast("string"), F.lit("|"))
    rows = rows.withColumn("holds", F.col("paragraph").isNull() | F.concat(F.lit("\n\n"), "text").contains(mark))
    some = F.max("holds").over(Window.partitionBy("query_id"))
    return rows.withColumn("fallback", ~some).where(F.col("holds") | F.col("fallback")).select("query_id", "chunk_id", "source_index", "fallback")


def latest_chunk(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """wanted_id, chunk_id, rag_partition: the newest active chunk for ids `chunk` or `partition:chunk`."""
    ids = wanted.select("wanted_id", F.regexp_replace("wanted_id", "^[^:]*:", "").alias("chunk_id"))
    rows = ids.join(chunks.where("deprecated_at is null"), "chunk_id")
    return first_per(rows, ["wanted_id"], F.desc_nulls_last("updated_at"), F.asc("rag_partition")).select("wanted_id", "chunk_id", "rag_partition")


def enrich_references(evaluated: DataFrame, cited: DataFrame, sources: DataFrame, citations: DataFrame, scores: DataFrame) -> DataFrame:
    """query_id, chunk_id, description, relevance, title, author, text, cited of all references that were evaluated or cited.

    evaluated: query_id, chunk_id, description, relevance; cited: query_id, chunk_id; sources (text, source_title,
    segment_title, author) and citations (source_title, segment_title, author) by chunk_id; scores: query_id, chunk_id, score.
    """
    key = ["query_id", "chunk_id"]
    every = evaluated.select(*key).union(cited.select(*key)).distinct()
    rows = every.join(evaluated, key, "left").join(cited.select(*key).distinct().withColumn("cited", F.lit(True)), key, "left").join(scores, key, "left")
    rows = rows.join(sources.select("chunk_id", F.struct("text", "source_title", "segment_title", "author").alias("s")), "chunk_id", "left")
    rows = rows.join(citations.select("chunk_id", F.struct("source_title", "segment_title", "author").alias("c")), "chunk_id", "left")
    some = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    return rows.select(
        *key, some("description", "c.segment_title", "c.source_title").alias("description"), F.coalesce("relevance", "score", F.lit(0.5)).alias("relevance"),
        some("s.source_title", "c.source_title").alias("source_title"), some("s.segment_title", "c.segment_title").alias("segment_title"),
        some("s.author", "c.author").alias("author"), F.left(F.coalesce("s.text", F.lit("")), F.lit(REFERENCE_CHARS)).alias("text"), F.coalesce("cited", F.lit(False)).alias("cited"))


def cited_chunks(answers: DataFrame, entries: DataFrame, references: DataFrame) -> DataFrame:
    """query_id, chunk_id: what the numbers [n] of an answer stand for; talks stand for the chunks they refer to.

    answers: query_id, answer; entries: query_id, n, chunk_id, chunk_type; references: talk_id, chunk_id.
    """
    from ..functions.text import citation_numbers

    numbers = answers.select("query_id", F.explode(citation_numbers(F.col("answer"))).alias("n"))
    hits = numbers.join(entries, ["query_id", "n"])
    refs = references.select(F.col("talk_id").alias("__talk"), F.col("chunk_id").alias("__ref"))
    talk = F.col("chunk_type") == "talk"
    rows = hits.join(refs, talk & (F.col("chunk_id") == F.col("__talk")), "left")
    return rows.select("query_id", F.when(F.coalesce(talk, F.lit(False)), F.col("__ref")).otherwise(F.col("chunk_id")).alias("chunk_id")).where("chunk_id is not null").distinct()


def aliases_of(chunks: DataFrame, column: str = "aliases_json") -> DataFrame:
    """segment, alias (lower case) of each alias in a JSON array; what is no array has none."""
    array = F.when(F.trim(column).startswith("["), F.from_json(F.col(column), "array<string>"))
    return chunks.select(F.lower("segment_title").alias("segment"), F.explode(array).alias("alias")).select("segment", F.lower("alias").alias("alias")).where("alias != '' and segment != ''").distinct()


def fill_paragraphs(chunks: DataFrame, ids: Column, paragraphs: Column, updates: DataFrame) -> DataFrame:
    """chunks whose paragraph is null get that of two parallel arrays of ids and paragraphs."""
    pairs = updates.select(F.explode(F.arrays_zip(ids.alias("id"), paragraphs.alias("paragraph"))).alias("u")).select(F.col("u.id").alias("chunk_id"), F.col("u.paragraph").alias("__new"))
    return chunks.join(pairs, "chunk_id", "left").withColumn("paragraph", F.coalesce("paragraph", "__new")).drop("__new")


def related_files(files: DataFrame) -> DataFrame:
    """text files (name, content) with word_stats and csv_stats from the files of the same base name (name, kind, stats)."""
    base = F.regexp_replace("name", r"\.[^.]*$", "")
    stats = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("stats")))
    others = files.where("kind in ('quantify', 'csv')").groupBy(base.alias("base")).agg(stats("quantify").alias("word_stats"), stats("csv").alias("csv_stats"))
    return files.where("kind = 'txt'").withColumn("base", base).join(others, "base", "left").select("name", "word_stats", "csv_stats")
