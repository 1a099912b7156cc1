"""Data quality over chunks and documents, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..registry import query
from ..schemas import CHUNK_TYPES, WORLDVIEWS
from ..sources.testdata import CHUNKS_SQL, chunks, table

C = f"with {CHUNKS_SQL} "
_T, _W = ", ".join(f"'{t}'" for t in CHUNK_TYPES), ", ".join(f"'{w}'" for w in WORLDVIEWS)


def _odd(spark, d):
    """Chunks with planted faults."""
    m = F.col("doc_id") % 8
    return chunks(spark, d).withColumn("source_id", F.when(m == 1, " ").otherwise(F.col("source_id"))).withColumn("chunk_type", F.when(m == 2, "page").otherwise(F.col("chunk_type"))).withColumn(
        "importance", F.when(m == 3, 11).otherwise(5)).withColumn("worldviews", F.when(m == 4, F.array(F.lit("Idealismus"), F.lit(" "))).otherwise(F.col("worldviews")))


@query(C + """select chunk_id, case doc_id % 8 when 1 then 'source_id is missing' when 2 then 'chunk_type is unknown' when 3 then 'importance is out of range'
  when 4 then 'worldviews hold a blank|worldviews hold an unknown name' else '' end as violations from chunks""")
def chunk_validation(spark, d):
    return _odd(spark, d).select("chunk_id", F.array_join(Q.chunk_violations(), "|").alias("violations"))


def _documents(spark, d):
    m = F.col("doc_id") % 6
    return table(spark, d, "documents").select(
        F.when(m != 1, F.col("doc_id").cast("string")).alias("document_id"), "doc_id", F.concat(F.lit("base/"), F.when(m < 3, "Idealismus").otherwise("misc"), F.lit("/x")).alias("category"),
        F.concat(F.when(m == 0, F.concat(F.lit("[Dornach "), 1900 + F.col("doc_id") % 100, F.lit(", S. 12] "))).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"),
        F.when(m == 2, "A_B@T_U.txt").when(m == 5, F.concat(F.repeat(F.lit("n"), 230), F.lit(".txt"))).otherwise("title.txt").alias("filename"),
        F.when(m == 4, "xx").otherwise(F.col("lang")).alias("language"))


_DOCS = r"""d as (select doc_id, doc_id % 6 as m, case when doc_id % 6 <> 1 then doc_id::varchar end as document_id, case when doc_id % 6 < 3 then 'Idealismus' end as worldview,
   left(case when doc_id % 6 = 0 then '[Dornach ' || (1900 + doc_id % 100) || ', S. 12] ' else '' end || coalesce(text, ''), 1000000) as text,
   case when doc_id % 6 = 2 then 'A B' end as author, case when doc_id % 6 = 4 then 'xx' else lang end as language from documents),
 p as (select *, nullif(regexp_extract(left(text, 500), '\[(.*?(\d{4}).*?)\]', 2), '') as year, nullif(regexp_extract(text, '\[.*?S\.\s*(\d+).*?\]', 1), '') as page from d),
 f as (select *, (document_id is not null)::int as f1, (length(text) > 0)::int as f3, (author is not null)::int as fa, (year is not null)::int as fy, (worldview is not null)::int as fw, (page is not null)::int as fp, (length(language) > 0)::int as fl,
   (document_id is null)::int + (text = '' or regexp_matches(text, '^\s+$'))::int as e, (m = 5)::int + (m = 4)::int + (length(text) < 10)::int + (author is null)::int + 1 + (year is null)::int as w from p),
 q as (select *, (f1 + 1 + f3) / 3.0::double * 0.4 + (fa + 1 + 0 + fy + 1) / 5.0::double * 0.3 + (fa + 0 + 1 + 1 + fw + fy + 0 + fl) / 8.0::double * 0.2 + fp * 0.1 as c0,
   (fa * 0.3 + 0.3 + fw * 0.4 + 0.3 + fy * 0.2 + fp * 0.1 + 0.1) / 1.9::double as conf from f)"""


@query(f"with {_DOCS} select doc_id, e::int as errors, w::int as warnings, round_even(c0, 3) as completeness from q")
def metadata_completeness(spark, d):
    p = Q.pipeline(_documents(spark, d))
    return p.select("doc_id", F.size("errors").alias("errors"), F.size("warnings").alias("warnings"), F.round("completeness", 3).alias("completeness"))


@query(f"""with {_DOCS} select doc_id, case when e > 0 then 'F' when c >= 0.9 and w = 0 then 'A' when c >= 0.8 and w <= 2 then 'B' when c >= 0.7 and w <= 5 then 'C' when c >= 0.5 then 'D' else 'F' end as grade,
  round(greatest(0.1, least(1.0, conf)), 6) as confidence, round(greatest(0.0, least(1.0, 0.3 * greatest(0.1, least(1.0, conf)) + 0.4 * c - 0.2 * least(1.0, 0.2 * e) - 0.1 * least(0.5, 0.1 * w))), 4)::double as quality
  from (select *, round_even(c0, 3) as c from q)""")
def quality_grade(spark, d):
    p = Q.pipeline(_documents(spark, d))
    return p.select("doc_id", "grade", F.round("confidence", 6).alias("confidence"), F.round("quality", 4).alias("quality"))


@query(C + "select chunk_id, case when worldview is null then 'x|y z' else lower(worldview) || '|x|y z' end as tags from chunks")
def tag_cleaning(spark, d):
    tags = F.array_compact(F.array(F.concat(F.lit(" "), "worldview"), F.lit("X "), F.lit(" "), F.lit("x"), F.lit("y Z")))
    return chunks(spark, d).select("chunk_id", F.array_join(Q.clean_tags(tags), "|").alias("tags"))


@query("""select doc_id, case doc_id % 4 when 1 then 'extension is unknown' when 2 then 'dims are unknown' when 3 then 'path is missing' else '' end as file, case doc_id % 4 when 0 then 'operation is unknown' when 1 then 'content is missing'
  when 2 then 'paragraph_id is missing' else '' end as tool from documents""")
def argument_validation(spark, d):
    m = F.col("doc_id") % 4
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(m != 3, F.when(m == 1, "a.exe").otherwise("a.TXT")).alias("path"), F.when(m == 2, 100).otherwise(768).alias("dims"),
        F.when(m == 1, "append").when(m == 2, "delete").when(m == 3, "insert").otherwise("burn").alias("operation"), F.when(m != 1, "c").alias("content"), F.when(m == 3, "p1").alias("paragraph_id"))
    return rows.select("doc_id", F.array_join(Q.file_violations(), "|").alias("file"), F.array_join(Q.tool_violations(), "|").alias("tool"))


_RULES = r"""f as (select doc_id, case when doc_id % 11 <> 0 then 'd' || doc_id end as document_id, case doc_id % 5 when 0 then 'Idealismus' when 1 then 'notes' when 2 then '' end as category, case when doc_id % 4 = 0 then 'Realismus' when doc_id % 4 = 1 then 'Idealismus' end as worldview,
    coalesce(text, '') as text, case when doc_id % 3 > 0 then 'Author ' || doc_id % 9 end as author, ['Author ' || doc_id % 7, 'Author 3'] as co_authors, 'T' || doc_id % 6 as title, 'T' || doc_id % 4 as book_title,
    case doc_id % 6 when 0 then '1904' when 1 then '19x4' when 2 then '0900' when 3 then '2999' when 4 then '' end as year, case doc_id % 7 when 0 then '3-7274-0040-1' when 1 then '12' when 2 then '9783727400407' end as isbn,
    case doc_id % 8 when 0 then '0' when 1 then 'S. 3' when 2 then '17' end as page_number, case when doc_id % 10 = 0 then 'xx' else lang end as language, case doc_id % 9 when 0 then 768 when 1 then 100 when 2 then 0 end as embedding_dimension,
    case doc_id % 5 when 0 then 'a.TXT' when 1 then 'b.exe' when 2 then 'c' when 3 then repeat('n', 230) || '.md' end as filename, case when doc_id % 3 = 0 then (doc_id % 6)::int - 1 end as chunk_index, case when doc_id % 2 = 0 then (doc_id % 5)::int end as total_chunks,
    case when doc_id % 13 > 0 then 'c' || doc_id end as chunk_id, length(coalesce(text, '')) + (doc_id % 3) * 80 as chunk_size, doc_id % 23 / 20.0::double as confidence_score, doc_id % 17 as created_at, doc_id % 19 as updated_at, case when doc_id % 2 = 0 then doc_id % 23 end as processed_at,
    case when doc_id % 7 = 0 then 'tag' end as tags from documents),
  r as (select *, case when regexp_matches(year, '^\d{4}$') then year::int end as y, lower(regexp_extract(filename, '[^/.](\.[^./]+)$', 1)) as ext, list_filter(['author', 'title', 'book_title', 'year', 'filename'], lambda n: case n when 'author' then coalesce(author, '') when 'title' then title when 'book_title' then book_title when 'year' then coalesce(year, '') else coalesce(filename, '') end = '') as rec,
    (coalesce(author, '') = '')::int + (coalesce(category, '') = '')::int + (worldview is null)::int + (coalesce(year, '') = '')::int + (tags is null)::int + (coalesce(language, '') = '')::int > 4 as many from f)"""


def _found(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {test} then '{message}' end" for test, message in rules) + "], lambda x: x is not null), '|')"


@query(f"""with {_RULES} select doc_id, {_found(
    ("document_id is null", "document_id is missing"), ("trim(coalesce(category, '')) = ''", "category is missing"), ("regexp_matches(text, '^\\s*$')", "text is missing"), ("length(filename) > 255", "filename is too long"), ("length(text) > 1000000", "text is too long"),
    ("year <> '' and y is null", "year is not four digits"), ("isbn = '12'", "isbn has no valid form"), ("page_number <> '' and not regexp_matches(page_number, '^\\d+$')", "page_number is no number"), ("embedding_dimension = 100", "embedding_dimension is unknown"),
    ("chunk_index >= total_chunks", "chunk_index is not below total_chunks"), ("total_chunks is not null and chunk_index < total_chunks and chunk_index < 0", "chunk_index is negative"), ("confidence_score > 1", "confidence_score is out of range"),
    ("updated_at < created_at", "updated_at is before created_at"), ("processed_at < created_at", "processed_at is before created_at"), ("total_chunks > 1 and chunk_index is null", "chunk_index is missing"), ("total_chunks > 1 and chunk_id is null", "chunk_id is missing"))} as errors, {_found(
    ("length(filename) > 204 and length(filename) <= 255", "filename is nearly too long"), ("text <> '' and length(text) < 10", "text is short"), ("y < 1000", "year seems too old"), ("y > 2036", "year is in the future"), ("language = 'xx'", "language is unknown"),
    ("ext = '.exe'", "file extension is unusual"), ("category <> '' and worldview <> '' and category <> worldview", "category and worldview differ"), ("text <> '' and chunk_size <> 0 and abs(length(text) - chunk_size) > 100", "chunk_size is not the text''s length"),
    ("title = book_title", "title and book_title are the same"), ("list_contains(co_authors, author)", "author is a co-author, too"), ("category = 'Idealismus' and author is null", "author is missing for a worldview"), ("page_number = '0'", "page_number is 0"),
    ("len(rec) > 0", "recommended fields are missing"), ("many", "many searchable fields are missing"))} as warnings,
  array_to_string(list_concat(list_transform(rec, lambda n: 'add ' || n), list_filter([case when many then 'add searchable fields' end, case when coalesce(year, '') = '' then 'add the year' end, case when tags is null then 'add tags' end, case when coalesce(category, '') = '' and worldview is null then 'add category or worldview' end], lambda x: x is not null)), '|') as suggestions from r""")
def metadata_rules(spark, d):
    """Documents with fields of all kinds, right and wrong ones, against every rule."""
    i = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values], *[F.lit(None).cast("string")] * (n - len(values))), (i % n + 1).cast("int"))
    docs = table(spark, d, "documents").select(
        "doc_id", F.when(i % 11 != 0, F.concat(F.lit("d"), i)).alias("document_id"), pick(5, "Idealismus", "notes", "").alias("category"), pick(4, "Realismus", "Idealismus").alias("worldview"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(i % 3 > 0, F.concat(F.lit("Author "), i % 9)).alias("author"), F.array(F.concat(F.lit("Author "), i % 7), F.lit("Author 3")).alias("co_authors"), F.concat(F.lit("T"), i % 6).alias("title"), F.concat(F.lit("T"), i % 4).alias("book_title"),
        pick(6, "1904", "19x4", "0900", "2999", "").alias("year"), pick(7, "3-7274-0040-1", "12", "9783727400407").alias("isbn"), pick(8, "0", "S. 3", "17").alias("page_number"), F.when(i % 10 == 0, "xx").otherwise(F.col("lang")).alias("language"),
        pick(9, "768", "100", "0").cast("int").alias("embedding_dimension"), pick(5, "a.TXT", "b.exe", "c", "n" * 230 + ".md").alias("filename"), F.when(i % 3 == 0, (i % 6).cast("int") - 1).alias("chunk_index"), F.when(i % 2 == 0, (i % 5).cast("int")).alias("total_chunks"),
        F.when(i % 13 > 0, F.concat(F.lit("c"), i)).alias("chunk_id"), (F.length(F.coalesce("text", F.lit(""))) + i % 3 * 80).alias("chunk_size"), (i % 23 / 20.0).alias("confidence_score"), (i % 17).alias("created_at"), (i % 19).alias("updated_at"),
        F.when(i % 2 == 0, i % 23).alias("processed_at"), F.when(i % 7 == 0, "tag").alias("tags"))
    found = Q.findings(docs, 2026)
    return found.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("errors", "warnings", "suggestions")])


@query(f"""with {_DOCS}, g as (select doc_id, e, case when e > 0 then 'F' when c >= 0.9 and w = 0 then 'A' when c >= 0.8 and w <= 2 then 'B' when c >= 0.7 and w <= 5 then 'C' when c >= 0.5 then 'D' else 'F' end as grade from (select *, round_even(c0, 3) as c from q))
  select doc_id, preset, case preset when 'production' then true else e = 0 end as success, strpos('FDCBA', grade) < case preset when 'development' then 4 else 3 end as below from g, (values ('default'), ('production'), ('development')) p(preset)""")
def quality_presets(spark, d):
    """What the presets make of the same documents."""
    rows, out = Q.pipeline(_documents(spark, d)).select("doc_id", "grade", F.size("errors").alias("n")), None
    for preset in Q.PRESETS:
        success, below = Q.succeeds(preset, F.col("grade"), F.col("n"))
        part = rows.select("doc_id", F.lit(preset).alias("preset"), success.alias("success"), below.alias("below"))
        out = part if out is None else out.unionByName(part)
    return out
