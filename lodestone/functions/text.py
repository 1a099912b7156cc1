"""Text functions as column expressions. `length` counts code points; white space is Unicode's where (?U) is set."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import APP_TYPES, DEFAULT_SEARCH_TYPES

# Fixed values.
GERMAN_SIGNS = ["der", "die", "das", "und", "oder", "aber", "mit", "von", "zu", "im", "am", "ist", "war", "wird", "sein", "haben",
                "werden", "können", "müssen", "ß", "ä", "ö", "ü"]
ARTICLES = ["der", "die", "das", "ein", "eine", "des", "dem", "den", "einem", "einer"]
AGREEMENT = "(?i)^[\\s„“\"»«']*(ich stimme zu)"
CREATING = r"(?i)^(ja[,.]?\s+)?(ich\s+)?(lege|erstelle|mache)"
#: Alternatives of what announces a change of the working text, and of what asks for one: by its name, or without it.
WRITING = [
    "im Arbeitstext umgesetzt", "in den Arbeitstext", "habe .{0,40}(geändert|angepasst|eingetragen|überarbeitet|ergänzt)", "werde .{0,40}(schreiben|speichern|eintragen|ändern|ergänzen)",
    "speichere .{0,20}(gleich|jetzt|im Arbeitstext)", "lege .{0,30}arbeitstext", "erstelle .{0,20}arbeitstext", "Änderung ist", "lautet nun", "neue[rn]? .{0,25} lautet", "neuer Satz"]
WRITE_BY_NAME = [
    r"arbeitstext\s+(anlegen|erstellen|schreiben|erzeugen|beginnen|starten)", r"leg.{0,10}arbeitstext\s+an", "erstell.{0,10}arbeitstext", r"mach\s+(mir\s+)?(einen?\s+)?arbeitstext",
    r"schreib.{0,30}(in\s+(den|einen)\s+)?arbeitstext", r"im\s+arbeitstext", r"in\s+(den|einen|dem|meinen)\s+arbeitstext", "arbeitstext.{0,10}(anlegen|erstellen|schreiben|erzeugen|beginnen|starten|anleg)",
    r"(einen?\s+)?arbeitstext.{0,5}(für|mit|und)"]
WRITE_IMPLIED = r"(schreib|trag|füg|ergänz|änder|aktualisier|notier|eintrag|hinzufüg|aufschreib).*\b(das|dies|auch|dazu|noch|bitte|ebenfalls|ein|hinzu|auf)\b"

#: The bounds of words of ASCII letters, digits and underscores. Java's own \b knows other letters, with or without (?U).
ASCII_BOUND = "(?-iu:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def embedding_text(c: Column) -> Column:
    """Text for the embedder: tags q and i, paragraph markers at line starts and soft hyphens removed."""
    untagged = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)</?\s*(q|i)\b[^>]*>", "")
    return F.replace(F.regexp_replace(untagged, r"(?m)^\d{1,4}\|\s?", ""), F.lit("­"), F.lit(""))


@F.arrow_udf(T.StringType())
def unescape(texts: pa.Array) -> pa.Array:
    """Character references, named and numeric, as HTML 5 reads them; no built-in function knows its list of names."""
    return pa.array([html.unescape(t) if t is not None else None for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def unescape_closed(texts: pa.Array) -> pa.Array:
    """Character references that end in a semicolon; one that is cut off, like `&amp` at the end of a title, stays as it is."""
    one = lambda m: html.entities.html5.get(m[0][1:], m[0]) if m[0][1] != "#" else html.unescape(m[0])
    return pa.array([re.sub(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", one, t) if t is not None else None for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode normal form C; Spark has no function for it."""
    return pa.array([unicodedata.normalize("NFC", t) if t is not None else None for t in texts.to_pylist()], pa.string())


def html_to_text(c: Column, closed: bool = False) -> Column:
    """Tags become blanks, character references their characters, white space one blank; text without either is kept.

    HTML 5 also reads some references without a semicolon; with `closed`, these stay.
    """
    text = (unescape_closed if closed else unescape)(F.regexp_replace(c, "<[^>]+>", " "))
    return F.when(c.contains("<") | c.contains("&"), collapse(text)).otherwise(collapse(c))


def redact(c: Column, phrases: list[str]) -> Column:
    """The phrases removed, longest first, single words only as whole words; the text itself if nothing were left."""
    out, done = c, set()
    for p in sorted((p.strip() for p in phrases), key=lambda p: -len(p)):
        if p and p.lower() not in done:
            done.add(p.lower())
            quoted = "\\Q" + p + "\\E"
            out = F.regexp_replace(out, rf"(?iu)(?U)\b{quoted}\b" if " " not in p else rf"(?iu){quoted}", " ")
    return F.coalesce(F.nullif(collapse(out), F.lit("")), c)


def lemma(c: Column) -> Column:
    """Lower case, without a leading article, last word."""
    bare = F.lower(F.regexp_replace(strip(c), rf"(?i)^({'|'.join(ARTICLES)})\s+", ""))
    return F.regexp_extract(strip(bare), r"(?U)(\S*)$", 1)


def lemma_variants(c: Column) -> Column:
    """The lemma, and without its ending where it ends in `en`."""
    return F.array_compact(F.array(c, F.when((F.length(c) > 3) & c.endswith("en"), F.left(c, F.length(c) - 2))))


def snippet(c: Column, limit: int = 240) -> Column:
    """One line of at most `limit` characters, an ellipsis included."""
    line = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(F.left(line, F.lit(limit - 1)), r"(?U)\s+$", ""), F.lit("…")))


def truncate(c: Column, limit: int) -> Column:
    line = strip(c)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(F.left(line, F.lit(limit - 3)), r"(?U)\s+$", ""), F.lit("...")))


def trim_to_sentence(c: Column, limit: int) -> Column:
    """Cut at the last sentence end within the limit, else hard with an ellipsis."""
    cut = F.left(c, F.lit(limit))
    at_end = F.regexp_extract(cut, r"(?s)^(.*[.?!])[ \n]", 1)
    return F.when(F.length(c) <= limit, c).when(at_end != "", at_end).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit("…")))


def first_sentence(c: Column, limit: int = 600) -> Column:
    found = F.regexp_extract(c, r"(?s)^(.*?[.!?])", 1)
    return F.left(strip(F.when(found != "", found).otherwise(c)), F.lit(limit))


def is_incomplete(c: Column, min_chars: int) -> Column:
    s = strip(c)
    return (s == "") | ~s.rlike(r"""[.!?…]["'”»)\]]*\s*$""") | (F.length(s) < min_chars)


def agrees(c: Column) -> Column:
    return strip(c).rlike(AGREEMENT)


def announces_create(c: Column) -> Column:
    """The first line says that a document is being created."""
    return F.substring_index(strip(c), "\n", 1).rlike(CREATING)


def announces_write(c: Column) -> Column:
    """An answer says that the working text is being changed."""
    return c.rlike("(?iud)" + "|".join(WRITING))


def requests_write(c: Column, has_document: Column, ascii_words: bool = False) -> Column:
    """A message asks for work on the working text: by name, or, where a document is linked, without it.

    Words end where letters of any script do; with `ascii_words`, also at letters that are not ASCII: `öein` has the word `ein`.
    """
    implied = "(?iud)" + WRITE_IMPLIED.replace(r"\b", ASCII_BOUND) if ascii_words else "(?iuUd)" + WRITE_IMPLIED
    return c.rlike("(?iud)" + "|".join(WRITE_BY_NAME)) | (has_document & c.rlike(implied))


def citation_numbers(c: Column) -> Column:
    """Distinct n of the marks [n], in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int")))


def strip_usage_comment(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\s*<!--\s*usage:.*?-->\s*$", "")


def looks_german(c: Column) -> Column:
    low, hits = F.lower(c), F.lit(0)
    for sign in GERMAN_SIGNS:
        hits = hits + low.contains(sign).cast("int")
    return hits >= 3


def quote_key(c: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(c, r"\[[^\]]*\]", "")))


def paragraph_number(c: Column) -> Column:
    n = strip(c.cast("string")).try_cast("int")
    return F.when(n >= 1, n)


def person_name(c: Column) -> Column:
    return F.lower(collapse(F.translate(c, "_", " ")))


def book_title(c: Column) -> Column:
    """`A_B#T_U#4` reads `A B: T U (GA 4)`; what has no such parts keeps them out."""
    part = lambda n: collapse(F.translate(F.split_part(c, F.lit("#"), F.lit(n)), "_", " "))
    head = F.when(part(2) != "", F.concat(part(1), F.lit(": "), part(2))).otherwise(part(1))
    return F.when(part(3) != "", F.concat(head, F.lit(" (GA "), part(3), F.lit(")"))).otherwise(head)


def file_author(stem: Column) -> Column:
    return F.when(stem.contains("@"), clean_name(F.substring_index(stem, "@", 1))).when(stem.contains("#"), clean_name(F.substring_index(stem, "#", 1)))


def file_title(stem: Column) -> Column:
    after = lambda sign: F.substr(stem, F.instr(stem, sign) + 1)
    return clean_name(F.when(stem.contains("@"), after("@")).when(stem.contains("#"), after("#")).otherwise(stem))


def clean_name(c: Column) -> Column:
    return strip(F.translate(c, "_", " "))


def year_of(c: Column) -> Column:
    """First bracketed group of four digits within the first 500 characters."""
    return F.nullif(F.regexp_extract(F.left(c, F.lit(500)), r"\[(.*?(\d{4}).*?)\]", 2), F.lit(""))


def page_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\[.*?S\.\s*(\d+).*?\]", 1), F.lit(""))


def fenced_json(c: Column) -> Column:
    """What stands in a fence, else from the first bracket to the last, else nothing."""
    fence = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)```", 1)
    loose = F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1)
    return F.when(fence != "", strip(fence)).when(loose != "", loose)


def fill(template: str, **slots: Column) -> Column:
    """{name} replaced by the slot's column; unknown names by nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[(F.coalesce(slots[p].cast("string"), F.lit("")) if p in slots else F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def retrieval_query(message: Column, paragraph: Column, last_answer: Column, limit: int = 400) -> Column:
    """Message, the paragraph's body without its header line and the last answer, each cut, by blank lines."""
    body = F.regexp_replace(strip(paragraph), r"^\[[^\]]*\]\s*\n?", "")
    block = lambda c: F.nullif(F.left(strip(c), F.lit(limit)), F.lit(""))
    return F.concat_ws("\n\n", strip(message), block(body), block(last_answer))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokens_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def point_id(chunk_id: Column) -> Column:
    """UUID version 5 of the id in the DNS name space."""
    name = F.unhex(F.concat(F.lit("6ba7b8109dad11d180b400c04fd430c8"), F.hex(F.encode(chunk_id, "UTF-8"))))
    h = F.left(F.sha1(name), F.lit(32))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def section_b(c: Column) -> Column:
    """What follows `b)` in a report, up to `c)` or the grade at a line's start, else to the end; empty without it."""
    closed = F.regexp_extract(c, r"(?is)\bb\)\s*(.*?)(?=\n\s*c\)\s*|\n\s*bewertung\s*:)", 1)
    return strip(F.when(closed != "", closed).otherwise(F.regexp_extract(c, r"(?is)\bb\)\s*(.*)$", 1)))


def iso_time(c: Column) -> Column:
    """ISO times with `Z` or an offset, in UTC; null for what is none."""
    return F.to_utc_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), "UTC").cast("timestamp_ntz")


def chunk_types(asked: Column) -> Column:
    """Chunk types of app types: aliases expand, other names stay, each once in the order of first appearance; nothing asked is all."""
    keys = F.filter(F.transform(F.coalesce(asked, F.array().cast("array<string>")), lambda t: F.lower(strip(t))), lambda t: t != "")
    known = F.create_map(*[x for k, v in APP_TYPES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    out = F.array_distinct(F.flatten(F.transform(keys, lambda t: F.coalesce(F.try_element_at(known, t), F.array(t)))))
    return F.when(F.size(keys) == 0, F.array(*[F.lit(t) for t in DEFAULT_SEARCH_TYPES])).otherwise(out)
