"""Data quality: violations as arrays of messages, completeness, grades and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, collapse
from ..schemas import CHUNK_TYPES, WORLDVIEWS

# Fixed values.
REQUIRED = ["document_id", "category", "text"]
RECOMMENDED = ["author", "title", "book_title", "year", "filename"]
SEARCHABLE = ["author", "book_title", "title", "category", "worldview", "year", "tags", "language"]
WEIGHTS = (0.4, 0.3, 0.2, 0.1)
LANGUAGES = ["de", "en", "fr", "es", "it", "nl", "pt", "ru"]
DIMENSIONS = [384, 512, 768, 1024, 1536, 2048]
EXTENSIONS = [".txt", ".md", ".pdf", ".docx", ".html", ".xml"]
CONFIDENCE = {"author": 0.3, "title": 0.3, "book_title": 0.2, "worldview": 0.4, "category": 0.3, "year": 0.2, "page_number": 0.1, "filename": 0.1, "file_hash": 0.1}
LENGTHS = {"author": 200, "title": 500, "book_title": 500, "language": 10, "filename": 255}
MIN_TEXT, MAX_TEXT, TOOL_LIMIT = 10, 1_000_000, 50_000
FIRST_YEAR, YEARS_AHEAD, SIZE_SPARE = 1000, 10, 100
ISBN = (r"^(?:ISBN(?:-1[03])?:? )?(?=[0-9X]{10}$|(?=(?:[0-9]+[- ]){3})[- 0-9X]{13}$|97[89][0-9]{10}$|(?=(?:[0-9]+[- ]){4})[- 0-9]{17}$)"
        r"(?:97[89][- ]?)?[0-9]{1,5}[- ]?[0-9]+[- ]?[0-9]+[- ]?[0-9X]$")
#: Preset -> least grade, whether errors of validation fail a document.
PRESETS = {"default": ("C", True), "production": ("C", False), "development": ("B", True)}
GRADES = "FDCBA"


def violations(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules whose condition holds; a null condition is no violation."""
    return F.array_compact(F.array(*[F.when(test, F.lit(message)) for test, message in rules]))


def chunk_violations() -> Column:
    """Metadata of a chunk: required fields, known type, importance 1..10, list of worldviews without blanks."""
    missing = lambda c: blank_to_null(F.col(c)).isNull()
    return violations(
        (missing("source_id"), "source_id is missing"), (missing("chunk_id"), "chunk_id is missing"), (missing("content_hash"), "content_hash is missing"),
        (~F.coalesce(F.col("chunk_type").isin(CHUNK_TYPES), F.lit(False)), "chunk_type is unknown"),
        ((F.col("importance") < 1) | (F.col("importance") > 10), "importance is out of range"),
        (F.exists("worldviews", lambda w: F.trim(w) == ""), "worldviews hold a blank"),
        (~F.forall("worldviews", lambda w: w.isin(WORLDVIEWS)), "worldviews hold an unknown name"),
        (F.col("source_index") < 0, "source_index is negative"))


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def document_errors() -> Column:
    return violations(
        *[(blank_to_null(F.col(c).cast("string")).isNull(), f"{c} is missing") for c in REQUIRED],
        *[(F.length(c) > n, f"{c} is too long") for c, n in LENGTHS.items()],
        (~F.col("year").cast("string").rlike(r"^\d{4}$"), "year is not four digits"),
        (F.length("text") > MAX_TEXT, "text is too long"))


def document_warnings() -> Column:
    return violations(
        *[((F.length(c) > 0.8 * n) & (F.length(c) <= n), f"{c} is nearly too long") for c, n in LENGTHS.items()],
        (~F.col("language").isin(LANGUAGES), "language is unknown"), (F.length("text") < MIN_TEXT, "text is short"),
        *[(blank_to_null(F.col(c).cast("string")).isNull(), f"{c} is recommended") for c in RECOMMENDED])


def format_findings(this_year: int) -> tuple[Column, Column]:
    """(errors, warnings) of year, isbn, page_number, language, embedding_dimension and filename."""
    given = lambda c: F.col(c) != ""
    year = F.when(F.col("year").rlike(r"^\d{4}$"), F.col("year").cast("int"))
    extension = F.lower(F.regexp_extract("filename", r"[^/.](\.[^./]+)$", 1))
    errors = violations(
        (given("year") & year.isNull(), "year is not four digits"), (given("isbn") & ~F.col("isbn").rlike(ISBN), "isbn has no valid form"),
        (given("page_number") & ~F.col("page_number").rlike(r"^\d+$"), "page_number is no number"), ((F.col("embedding_dimension") != 0) & ~F.col("embedding_dimension").isin(DIMENSIONS), "embedding_dimension is unknown"))
    warnings = violations(
        (year < FIRST_YEAR, "year seems too old"), (year > this_year + YEARS_AHEAD, "year is in the future"), (given("language") & ~F.col("language").isin(LANGUAGES), "language is unknown"),
        ((extension != "") & ~extension.isin(EXTENSIONS), "file extension is unusual"))
    return errors, warnings


def consistency_findings() -> tuple[Column, Column]:
    """(errors, warnings) of fields that belong together: chunks, category and worldview, confidence, sizes, times."""
    beyond = F.col("chunk_index") >= F.col("total_chunks")
    errors = violations(
        (beyond, "chunk_index is not below total_chunks"), (F.col("total_chunks").isNotNull() & ~beyond & (F.col("chunk_index") < 0), "chunk_index is negative"),
        (~F.col("confidence_score").between(0.0, 1.0), "confidence_score is out of range"), (F.col("updated_at") < F.col("created_at"), "updated_at is before created_at"),
        (F.col("processed_at") < F.col("created_at"), "processed_at is before created_at"))
    warnings = violations(
        ((F.col("category") != "") & (F.col("worldview") != "") & (F.col("category") != F.col("worldview")), "category and worldview differ"),
        ((F.col("text") != "") & (F.col("chunk_size") != 0) & (F.abs(F.length("text") - F.col("chunk_size")) > SIZE_SPARE), "chunk_size is not the text's length"))
    return errors, warnings


def business_findings() -> tuple[Column, Column]:
    """(errors, warnings) of titles, authors, chunks of several and pages."""
    several, missing = F.col("total_chunks") > 1, lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    errors = violations((several & F.col("chunk_index").isNull(), "chunk_index is missing"), (several & missing("chunk_id"), "chunk_id is missing"))
    warnings = violations(
        ((F.col("title") != "") & (F.col("title") == F.col("book_title")), "title and book_title are the same"), ((F.col("author") != "") & F.array_contains("co_authors", F.col("author")), "author is a co-author, too"),
        (F.col("category").isin(WORLDVIEWS) & missing("author"), "author is missing for a worldview"), (F.col("page_number") == "0", "page_number is 0"))
    return errors, warnings


def completeness_findings() -> tuple[Column, Column]:
    """(warnings, suggestions): one warning for all recommended fields that are empty, one where most searchable ones are."""
    empty = lambda names: F.array_compact(F.array(*[F.when(filled(F.col(n)) == 0, F.lit(n)) for n in names]))
    recommended, many = empty(RECOMMENDED), F.size(empty(SEARCHABLE)) > len(SEARCHABLE) // 2
    none = lambda *names: F.size(empty(names)) == len(names)
    warnings = violations((F.size(recommended) > 0, "recommended fields are missing"), (many, "many searchable fields are missing"))
    suggestions = violations((many, "add searchable fields"), (none("year"), "add the year"), (none("tags"), "add tags"), (none("category", "worldview"), "add category or worldview"))
    return warnings, F.concat(F.transform(recommended, lambda n: F.concat(F.lit("add "), n)), suggestions)


def findings(docs: DataFrame, this_year: int) -> DataFrame:
    """docs with errors, warnings and suggestions of all rules: required fields, lengths, formats, consistency, business, completeness."""
    required = violations(*[(blank_to_null(F.col(c).cast("string")).isNull(), f"{c} is missing") for c in REQUIRED])
    long = violations(*[(F.length(c) > n, f"{c} is too long") for c, n in LENGTHS.items()], (F.length("text") > MAX_TEXT, "text is too long"))
    nearly = violations(*[((F.length(c) > 0.8 * n) & (F.length(c) <= n), f"{c} is nearly too long") for c, n in LENGTHS.items()], ((F.col("text") != "") & (F.length("text") < MIN_TEXT), "text is short"))
    pairs = [format_findings(this_year), consistency_findings(), business_findings()]
    missing, suggestions = completeness_findings()
    return docs.withColumns({"errors": F.concat(required, long, *[p[0] for p in pairs]), "warnings": F.concat(nearly, *[p[1] for p in pairs], missing), "suggestions": suggestions})


def succeeds(preset: str, grade_: Column, errors: Column) -> tuple[Column, Column]:
    """(success, below the preset's grade) of a document with this grade and number of errors."""
    least, fails = PRESETS[preset]
    return (errors == 0) if fails else F.lit(True), F.instr(F.lit(GRADES), grade_) < GRADES.index(least) + 1


def filled(c: Column) -> Column:
    return F.when(F.coalesce(F.length(c.cast("string")) > 0, F.lit(False)), 1.0).otherwise(0.0)


def completeness(fields: dict[str, Column], others: dict[str, Column]) -> Column:
    """Weighted shares of filled required, recommended, searchable and other fields; absent fields count as empty."""
    share = lambda names: reduce(lambda a, b: a + b, [filled(fields[n]) if n in fields else F.lit(0.0) for n in names]) / len(names)
    rest = reduce(lambda a, b: a + b, [filled(c) for c in others.values()], F.lit(0.0)) / max(len(others), 1)
    a, b, c, d = WEIGHTS
    return F.bround(share(REQUIRED) * a + share(RECOMMENDED) * b + share(SEARCHABLE) * c + rest * d, 3)


def grade(complete: Column, errors: Column, warnings: Column) -> Column:
    return (F.when(errors > 0, "F").when((complete >= 0.9) & (warnings == 0), "A").when((complete >= 0.8) & (warnings <= 2), "B")
            .when((complete >= 0.7) & (warnings <= 5), "C").when(complete >= 0.5, "D").otherwise("F"))


def confidence(extracted: dict[str, Column]) -> Column:
    """Filled weight over the weight of what was tried, between 0.1 and 1."""
    most = sum(CONFIDENCE[k] for k in extracted)
    got = reduce(lambda a, b: a + b, [filled(c) * CONFIDENCE[k] for k, c in extracted.items()], F.lit(0.0))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), got / most if most else F.lit(0.0)))


def overall(conf: Column, complete: Column, errors: Column, warnings: Column) -> Column:
    score = 0.3 * conf + 0.4 * complete - 0.2 * F.least(F.lit(1.0), 0.2 * errors) - 0.1 * F.least(F.lit(0.5), 0.1 * warnings)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def pipeline(docs: DataFrame, least_quality: float = 0.3) -> DataFrame:
    """Length gate, cut, extraction, validation, assessment: text columns in, `accepted` and its parts out.

    docs: document_id, category, text, filename, language. Each stage is a projection; nothing is shuffled.
    """
    from ..functions.text import file_author, file_title, page_of, year_of

    stem = F.regexp_replace("filename", r"\.[A-Za-z0-9]+$", "")
    x = docs.withColumn("text", F.left("text", F.lit(MAX_TEXT))).withColumn("author", file_author(stem)).withColumn("title", file_title(stem)).withColumn(
        "book_title", F.lit(None).cast("string")).withColumn("year", year_of(F.col("text"))).withColumn("page_number", page_of(F.col("text"))).withColumn(
        "worldview", F.get(F.filter(F.split("category", "/"), lambda p: p.isin(WORLDVIEWS)), F.lit(0))).withColumn("tags", F.lit(None).cast("string"))
    named = {c: F.col(c) for c in {*REQUIRED, *RECOMMENDED, *SEARCHABLE}}
    x = x.withColumn("errors", document_errors()).withColumn("warnings", document_warnings()).withColumn("completeness", completeness(named, {"page_number": F.col("page_number")}))
    x = x.withColumn("confidence", confidence({k: F.col(k) for k in ("author", "title", "book_title", "worldview", "category", "year", "page_number", "filename")}))
    x = x.withColumn("quality", overall(F.col("confidence"), F.col("completeness"), F.size("errors"), F.size("warnings")))
    return x.withColumn("accepted", (F.length("text") >= MIN_TEXT) & (F.size("errors") == 0) & (F.col("quality") >= least_quality)).withColumn(
        "grade", grade(F.col("completeness"), F.size("errors"), F.size("warnings")))


def clean_metadata(rows: DataFrame) -> DataFrame:
    """author, year and page_number trimmed, blank ones null; years that are no four digits and pages that are no number
    are refused and counted in `rejected`."""
    plain = {c: F.nullif(F.trim(c), F.lit("")) for c in ("author", "year", "page_number")}
    bad = [F.coalesce(~plain[c].rlike(form), F.lit(False)) for c, form in (("year", r"^\d{4}$"), ("page_number", r"^\d+$"))]
    return rows.select(
        *[c for c in rows.columns if c not in plain], collapse(F.translate(plain["author"], "_", " ")).alias("author"),
        F.when(~bad[0], plain["year"]).alias("year"), F.when(~bad[1], plain["page_number"]).alias("page_number"), (bad[0].cast("int") + bad[1].cast("int")).alias("rejected"))


def file_violations() -> Column:
    """Arguments of an embedding call: path with a known extension, known width."""
    extension = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return violations((blank_to_null(F.col("path")).isNull(), "path is missing"), (~extension.isin(EXTENSIONS), "extension is unknown"), (~F.col("dims").isin(DIMENSIONS), "dims are unknown"))


def tool_violations() -> Column:
    """Calls of the document tool: operation, what it needs, and the size limit."""
    needs_content = F.col("operation").isin("replace", "append", "insert")
    return violations(
        (~F.coalesce(F.col("operation").isin("replace", "append", "insert", "delete"), F.lit(False)), "operation is unknown"),
        (needs_content & (F.coalesce("content", F.lit("")) == ""), "content is missing"),
        (F.col("operation").isin("insert", "delete") & F.col("paragraph_id").isNull(), "paragraph_id is missing"),
        (F.length("content") > TOOL_LIMIT, "content is too long"))
