"""Markdown sources: quote collections and document trees, parsed within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, quote_key, strip

_BLOCK = "array<struct<chapter:int,heading:string,sub:string,number:int,text:string>>"


def _fold(text: Column, mark, step) -> Column:
    """Lines folded into blocks. mark(struct of line and row, the line without white space around it) adds kind; step(state, struct) -> state; the state holds chapter, heading, sub, number, buffer, blocks."""
    start = F.struct(F.lit(0).alias("chapter"), F.lit("").alias("heading"), F.lit("").alias("sub"), F.lit(0).alias("number"), F.lit("").alias("buffer"),
                     F.array().cast(_BLOCK).alias("blocks"))
    lines = F.concat(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1), F.array(F.lit("")))  # an empty line ends the last block
    rows = F.transform(lines, lambda line: F.struct(line.alias("line"), strip(line).alias("row")))
    blocks = F.aggregate(F.transform(rows, mark), start, step, lambda s: s["blocks"])
    return F.transform(blocks, lambda b: b.withField("text", strip(b["text"])))


def _flushed(s: Column) -> tuple[Column, Column]:
    """(blocks, number) after the buffer is closed. It holds lines that are not blank, so it is empty or a block."""
    n = s["number"] + F.when(s["buffer"] != "", 1).otherwise(0)
    block = F.struct(s["chapter"].alias("chapter"), s["heading"].alias("heading"), s["sub"].alias("sub"), n.alias("number"), s["buffer"].alias("text"))
    return F.when(s["buffer"] != "", F.array_append(s["blocks"], block)).otherwise(s["blocks"]), n


def document_blocks(text: Column) -> Column:
    """Paragraphs of a document: chapter (## headings, from 1; 0 before), its heading, sub-heading (###), number in the chapter.

    Paragraphs end at blank lines and headings; the number starts anew in a chapter, not in a sub-chapter. Lines with one
    `#` are titles and hold no text.
    """

    # An expression that is named twice is computed twice: what needs patterns is told once a line, as a letter.
    def mark(x: Column) -> Column:
        heading = F.regexp_extract(x["row"], r"^(#{1,3})\s+\S", 1)
        return x.withField("kind", F.when(x["row"] == "", "").when(x["row"].startswith("#") & (heading != ""), heading).otherwise("text"))

    def step(s: Column, x: Column) -> Column:
        line, row, kind = x["line"], x["row"], x["kind"]
        chapter, sub, ends = kind == "##", kind == "###", kind != "text"
        blocks, n = _flushed(s)
        return F.struct(
            F.when(chapter, s["chapter"] + 1).otherwise(s["chapter"]).alias("chapter"), F.when(chapter, row).otherwise(s["heading"]).alias("heading"),
            F.when(chapter, F.lit("")).when(sub, row).otherwise(s["sub"]).alias("sub"),
            F.when(chapter, F.lit(0)).when(ends, n).otherwise(s["number"]).alias("number"),
            F.when(ends, F.lit("")).otherwise(F.concat_ws("\n", F.nullif(s["buffer"], F.lit("")), line)).alias("buffer"),
            F.when(ends, blocks).otherwise(s["blocks"]).alias("blocks"))

    return _fold(text, mark, step)


def document_title(text: Column) -> Column:
    """The first line that is not blank, if it is a `#` heading."""
    found = F.regexp_extract(text, r"^\s*#[ \t]+(\S[^\n]*)", 1)
    return F.when(found != "", strip(found)).otherwise("Ohne Titel")


def flatten(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, paragraph_id (ch1.p2), heading_path, text: one row a paragraph."""
    b = docs.select(key, F.explode(document_blocks(F.col(text))).alias("b"))
    path = F.filter(F.array("b.heading", "b.sub"), lambda h: h != "")
    return b.select(key, F.concat(F.lit("ch"), "b.chapter", F.lit(".p"), "b.number").alias("paragraph_id"), path.alias("heading_path"), F.col("b.text").alias("text"))


def read_blocks(flat: DataFrame, addresses: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs by id, or by heading path: a chapter's path gives its own paragraphs, not its sub-chapters'.

    addresses: key, paragraph_id, heading_path (the one that is null does not count).
    """
    a = addresses.select(F.col(key).alias("__k"), F.col("paragraph_id").alias("__p"), F.col("heading_path").alias("__h"))
    by_id = flat.join(a.where("__p is not null"), (F.col(key) == F.col("__k")) & (F.col("paragraph_id") == F.col("__p")))
    by_path = flat.join(a.where("__h is not null"), (F.col(key) == F.col("__k")) & (F.col("heading_path") == F.col("__h")))
    return by_id.union(by_path).select(*flat.columns).distinct()


def quotes(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, segment_id, paragraph, quote, quote_key of a quote collection.

    Headings name the segment; a comment `<!-- segment_id: x paragraph: n -->` before a block names both for it.
    """
    flat = files.select(key, F.explode(document_blocks(F.regexp_replace(text, r"(?m)^#+(\s)", "##$1"))).alias("b")).select(key, "b.heading", "b.text")
    mark = r"^<!--\s*segment_id:\s*([^\s]+)\s*(?:paragraph:\s*(\d+)\s*)?-->"
    marked = F.col("text").rlike(mark)
    n = F.when(marked, F.regexp_extract("text", mark, 2).try_cast("int")).otherwise(1)
    body = collapse(F.when(marked, F.regexp_replace("text", mark, "")).otherwise(F.col("text")))
    segment = F.when(marked, F.regexp_extract("text", mark, 1)).otherwise(collapse(F.regexp_replace("heading", r"^#+\s+", "")))
    return flat.select(key, segment.alias("segment_id"), n.alias("paragraph"), body.alias("quote"), quote_key(body).alias("quote_key")).where("quote != '' and paragraph >= 1")
