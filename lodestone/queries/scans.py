"""Sources and model calls over generated files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as M
from ..operators import tools
from ..registry import query
from ..sources import files, markdown
from ..sources.scratch import folder
from ..sources.testdata import CHUNKS_SQL, chunks, table
from .retrieval import sparse_retrieve, sparse_sql, sql, text_queries

C = f"with {CHUNKS_SQL} "


@query("select r_regionkey, r_name from region")
def region_scan(spark, d):
    return table(spark, d, "region").select("r_regionkey", "r_name")


@query(C + "select chunk_id as id, chunk_type, source_index, length(coalesce(text, ''))::bigint as chars from chunks")
def jsonl_scan(spark, d):
    """Chunks written as JSON lines, with comments and blank lines between them, and read again."""
    rows = chunks(spark, d).select(F.explode(F.array(
        F.lit(""), F.lit("# comment"), F.to_json(F.struct(F.col("chunk_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.struct("chunk_type", "source_index").alias("metadata"))))).alias("value"))
    path = folder(spark, "jsonl")
    rows.write.text(path)
    return files.read_json_lines(spark, path).select("id", F.col("metadata.chunk_type").alias("chunk_type"), F.col("metadata.source_index").alias("source_index"), F.length("text").cast("long").alias("chars"))


@query("select 'w' || doc_id as word, lang as type, case when doc_id % 5 = 0 then 0 else doc_id end::int as count, doc_id % 100 || '' as percentage from documents")
def word_count_csv(spark, d):
    path = folder(spark, "words")
    table(spark, d, "documents").select(F.concat(F.lit("w"), "doc_id").alias("word"), F.col("lang").alias("type"), F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise(F.col("doc_id").cast("string")).alias("count"),
                                        F.concat(F.col("doc_id") % 100, F.lit("%")).alias("percentage")).write.option("header", "true").csv(path)
    return files.word_counts(spark, path)


def outlined(spark, d):
    """Documents as outlines: of their own lines, with blank ones between them, every fifth is a chapter's heading and every seventh a sub-chapter's."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    mark = lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), x)).when(i % 7 == 4, F.concat(F.lit("### "), x)).otherwise(x)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(lines, mark), "\n\n").alias("text"), F.trim(F.get(lines, F.lit(2))).alias("third"))


#: Paragraphs of the same outlines: doc_id, chapter, heading, sub, number, text; `pos` is the line.
_OUTLINE = r"""
lines as (select doc_id, pos - 1 as pos, case when (pos - 1) % 5 = 2 then '## ' || x when (pos - 1) % 7 = 4 then '### ' || x else x end as line
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
kinds as (select *, trim(line) as row, case when regexp_matches(trim(line), '^##\s+\S') then 'chapter' when regexp_matches(trim(line), '^###\s+\S') then 'sub' when regexp_matches(trim(line), '^#\s+\S') then 'title' when trim(line) = '' then 'blank' else 'text' end as kind from lines),
chapters as (select *, count(*) filter (kind = 'chapter') over (partition by doc_id order by pos) as chapter from kinds),
paragraphs as (select *, coalesce(first_value(case when kind = 'chapter' then row end ignore nulls) over (partition by doc_id, chapter order by pos), '') as heading,
    coalesce(last_value(case when kind = 'sub' then row end ignore nulls) over (partition by doc_id, chapter order by pos rows between unbounded preceding and current row), '') as sub,
    count(*) filter (kind = 'text') over (partition by doc_id, chapter order by pos) as number from chapters)"""


@query(f"with {_OUTLINE} select doc_id, 'ch' || chapter || '.p' || number as paragraph_id, case when heading <> '' and sub <> '' then heading || '/' || sub else heading || sub end as path, row as text from paragraphs where kind = 'text'")
def document_tree(spark, d):
    flat = markdown.flatten(outlined(spark, d))
    return flat.select("doc_id", "paragraph_id", F.array_join("heading_path", "/").alias("path"), "text")


@query(rf"""with {_OUTLINE}, wanted as (select doc_id, '## ' || trim(string_split(text, chr(10))[3]) as third from documents where doc_id % 10 <> 3),
  own as (select doc_id, chapter, string_agg(row, chr(10) || chr(10) order by pos) as content from paragraphs where kind = 'text' and sub = '' group by all),
  first as (select p.doc_id, min(chapter) as chapter from paragraphs p join wanted w on w.doc_id = p.doc_id and p.heading = w.third where kind = 'text' group by 1)
select doc_id, 0 as address_no, row as content, '' as error from paragraphs where kind = 'text' and chapter = 0 and number = 1 and doc_id % 10 <> 3
union all select doc_id, 1, content, '' from own join first using (doc_id, chapter)
union all select doc_id, null, null, case doc_id % 20 when 3 then 'addresses is missing' else 'tool is unknown' end from documents where doc_id % 10 = 3""")
def tool_read_blocks(spark, d):
    """One call for each document: its first paragraph, the chapter under its third line and a paragraph that no document has; some calls are wrong."""
    docs = outlined(spark, d)
    at = lambda p=None, h=None: F.struct(F.lit(p).cast("string").alias("paragraph_id"), (F.array(h) if h is not None else F.lit(None).cast("array<string>")).alias("heading_path"))
    args = F.to_json(F.struct(F.array(at("ch0.p1"), at(h=F.concat(F.lit("## "), F.coalesce("third", F.lit("")))), at("ch0.p0")).alias("addresses")))
    calls = docs.select(F.col("doc_id").alias("call_id"), "doc_id", F.when(F.col("doc_id") % 20 == 13, "write_blocks").otherwise("read_blocks").alias("tool"), F.when(F.col("doc_id") % 10 == 3, "{}").otherwise(args).alias("args"))
    found, refused = tools.invoke(calls, docs)
    return found.select("doc_id", "address_no", "content", F.lit("").alias("error")).unionByName(refused.select(
        "doc_id", F.lit(None).cast("int").alias("address_no"), F.lit(None).cast("string").alias("content"), F.array_join("errors", "|").alias("error")))


@query(r"""with l as (select doc_id, pos - 1 as pos, trim(regexp_replace(x, '\s+', ' ', 'g')) as quote from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents))
  select doc_id, case when pos % 2 = 0 then 'seg-' || doc_id else 'Part ' || (doc_id % 9) end as segment_id, case when pos % 2 = 0 then (pos + 1)::int else 1 end as paragraph, quote from l where quote <> ''""")
def markdown_quotes(spark, d):
    """Quote collections: a document's lines as blocks under one heading, every other one with a comment that names its segment and paragraph."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    block = F.transform(lines, lambda x, i: F.when(F.trim(x) == "", F.lit("")).when(i % 2 == 0, F.concat(F.lit("<!-- segment_id: seg-"), "doc_id", F.lit(" paragraph: "), (i + 1).cast("string"), F.lit(" -->\n"), x)).otherwise(x))
    text = F.concat(F.lit("# Part   "), F.col("doc_id") % 9, F.lit("\n\n"), F.array_join(block, "\n\n"))
    q = markdown.quotes(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id")
    return q.select("doc_id", "segment_id", "paragraph", "quote")


def _last(mark: str) -> str:
    """Where a mark begins last within the window w, from 0; -1 without one."""
    return f"case when contains(w, {mark}) then length(w) - position(reverse({mark}) in reverse(w)) - length({mark}) + 1 else -1 end"


@query(f"""with recursive c as (select doc_id, text, length(text)::bigint as n, 0::bigint as start, 0::bigint as stop, 0::bigint as next, -1::bigint as no from documents where length(text) > 0
  union all select doc_id, text, n, next, stop_, case when stop_ < n then greatest(stop_ - 200, next + 1) else n end, no + 1 from (
    select *, case when next + 1000 >= n then n when blank > 500 then next + blank + 2 when mark > 500 then next + mark + 2 else next + 1000 end as stop_ from (
      select *, {_last("chr(10) || chr(10)")} as blank, greatest({_last("'. '")}, {_last("'! '")}, {_last("'? '")}) as mark from (select *, substr(text, next + 1, 1000) as w from c where next < n)))),
  p as (select doc_id, no as chunk_no, start, regexp_replace(substr(text, start + 1, stop - start), '^\\s+|\\s+$', '', 'g') as text from c where no >= 0)
  select doc_id, (row_number() over (partition by doc_id order by chunk_no) - 1)::int as chunk_no, start::int as start, md5(text) as text from p where text <> ''""")
def chunk_texts(spark, d):
    """Overlapping chunks of all texts."""
    return M.chunk(table(spark, d, "documents").where("text is not null")).withColumn("text", F.md5("text"))


@query(r"""select doc_id, length(coalesce(text, ''))::bigint as chars, len(regexp_extract_all(coalesce(text, ''), '[^ \n]+'))::bigint as words from documents""")
def embedded_by_service(spark, d):
    """A service that takes eight texts, loses every third connection and mixes up answers about long texts; it counts characters and words."""

    def service():
        import re

        sent = [0]

        def answer(texts):
            sent[0] += 1
            if sent[0] % 3 == 0:
                raise ConnectionError("lost")
            if len(texts) > M.PER_REQUEST:
                raise RuntimeError("too many texts")
            if len(texts) > 1 and any(len(t) > 4000 for t in texts):
                return [[1.0]] * (len(texts) + 1)
            return [[float(len(t)), float(len(re.findall(r"[^ \n]+", t)))] for t in texts]

        return answer

    rows = M.embed_by_service(table(spark, d, "documents").select("doc_id", "text"), service, wait=0.001)
    return rows.select("doc_id", F.get("embedding", F.lit(0)).cast("long").alias("chars"), F.get("embedding", F.lit(1)).cast("long").alias("words"))


#: Separates texts within the files of `folder_texts`.
_MARK = "\x1e"


@query(r"""select doc_id, lang as category, md5(replace(coalesce(text, ''), chr(13), '')) as text from documents where not contains(coalesce(text, ''), chr(30))""")
def folder_texts(spark, d):
    """Texts written as files, a folder for each language, some in UTF-8 and some in Latin-1 where that can hold them, and read as bytes."""
    path, text = folder(spark, "texts"), F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))
    rows = table(spark, d, "documents").where(~F.coalesce(F.contains("text", F.lit(_MARK)), F.lit(False))).select("doc_id", "lang", text.alias("text"))
    narrow = ~F.col("text").rlike(r"[^\x00-\xFF]") & F.col("text").rlike(r"[\xA0-\xFF]") & (F.col("doc_id") % 2 == 0)
    for chosen, encoding in ((narrow, "ISO-8859-1"), (~narrow, "UTF-8")):
        rows.where(chosen).select("lang", F.concat(F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("value")).write.mode("append").option("lineSep", _MARK).option("encoding", encoding).partitionBy("lang").text(path)
    found = files.read_texts(spark, path).where("kind = 'txt'").select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("category"), F.explode(F.split("text", _MARK)).alias("value"))
    return found.where("value != ''").select(
        F.substring_index("value", "\n", 1).cast("long").alias("doc_id"), "category", F.md5(F.regexp_replace("value", r"^[0-9]+\n", "")).alias("text"))


@query("select lang as category, count(*) as docs, sum(strlen(coalesce(text, '')) + strlen(doc_id::varchar) + 2)::bigint as bytes from documents group by 1")
def folder_catalogue(spark, d):
    """The folders of texts with their files' sizes; what lies in hidden folders is left out."""
    path = folder(spark, "catalogue")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value"))
    for name in [r[0] for r in rows.select("lang").distinct().collect()]:  # the languages
        rows.where(F.col("lang") == name).select("value").write.option("lineSep", _MARK).text(f"{path}/{name}")
    rows.select("value").limit(1).write.text(f"{path}/.hidden")
    sizes = files.catalogue(spark, path).groupBy("category").agg(F.sum("size").alias("bytes"))
    return rows.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("docs")).join(sizes, "category")


@query()
def hashed_embeddings(spark, d):
    return M.embed(table(spark, d, "benchmark")).select("item_id", "embedding")


@query(sql(sparse_sql("s", 10), end="""select query_id, chunk_id, case rank when 1 then 0.8 else 0.4 end::double as relevance, case rank when 1 then 'fits well' else 'fits' end as description from s where rank <= 2 and query_id % 40 = 0
  union all select query_id, chunk_id, round_even(greatest(0.05, least(1.0, score / max(score) over (partition by query_id))), 4) as relevance, 'ranked high' as description from s where query_id % 40 <> 0 qualify row_number() over (partition by query_id order by score desc, rank) <= 3"""))
def reference_evaluation(spark, d):
    """A stub judges each query's hits: the first two fit, one of them twice, another too little, and one it has made up; to half of
    the queries it gives no answer, and their best three by score stand."""
    def chat():
        import json

        def answer(prompt):
            lines = prompt.split("\n")
            ids = [x.split(": ")[0] for x in lines if x.startswith("doc-") and ": " in x]
            found = [(ids[0], "fits  well", 0.8), (ids[0], "fits less", 0.5), *[(i, "fits", 0.4) for i in ids[1:2]], *[(i, "hardly", 0.2) for i in ids[2:3]], ("doc-made-up", "fits", 0.9)]
            return "```json\n" + json.dumps([{"chunk_id": c, "description": t, "relevance": r} for c, t, r in found]) + "\n```"

        return answer

    hits = sparse_retrieve(chunks(spark, d), text_queries(spark, d), 10)
    judged = M.evaluate_references(hits.where("query_id % 40 = 0"), chat)
    return judged.unionByName(M.evaluate_references(hits.where("query_id % 40 <> 0"), lambda: lambda prompt: "no idea"))


@query(C + "select chunk_id, content_hash, chunk_type, source_index as paragraph from chunks where chunk_type in ('quote', 'quote_explanation') and source_index >= 1")
def quote_file_records(spark, d):
    """Chunks written as JSON lines, a file for each kind; those that name a quote's paragraph are read again."""
    path = folder(spark, "quotes")
    meta = F.struct("chunk_id", "content_hash", "chunk_type", F.col("source_index").alias("paragraph"))
    chunks(spark, d).select("chunk_type", F.to_json(F.struct(meta.alias("metadata"))).alias("value")).write.partitionBy("chunk_type").text(path)
    return files.quote_records(spark, [path]).select("chunk_id", "content_hash", "chunk_type", "paragraph")


@query(r"""select doc_id, word, count(*) as count from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) as word from documents) group by all""")
def quantified_words(spark, d):
    """Word statistics as literal dictionaries, made of the texts and read as such."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    # Texts are dealt out by document once; counts and dictionaries are made where they lie then.
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    counted = docs.select("doc_id", F.explode(words).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    item = F.concat(F.lit("'"), F.col("w"), F.lit("': "), F.col("n").cast("string"))
    literal = counted.groupBy("doc_id").agg(F.concat(F.lit("{'word_stats': {"), F.array_join(F.collect_list(item), ", "), F.lit("}}")).alias("text"))
    return literal.select("doc_id", F.explode(files.quantify("text")).alias("s")).select("doc_id", "s.word", "s.count")


@query("""select 'nation' as name, n_nationkey as key, case when n_nationkey % 4 = 0 then upper(n_name) || '!' else n_name end as value, '' as error from nation where n_nationkey % 3 > 0 or n_nationkey % 4 = 0
  union all select 'region', r_regionkey, r_name, '' from region union all select 'lost', null, null, 'failed'""")
def table_sync(spark, d):
    """Tables copied with a check of their counts, then upserted by key; one that cannot be is named, and the others go on."""
    n, r = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "region").select("r_regionkey", "r_name")
    first, second = folder(spark, "copied"), folder(spark, "target")
    n.where("n_nationkey % 3 > 0").write.parquet(first)
    files.copy_checked(spark, first, second)
    news = n.where("n_nationkey % 4 = 0").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    done, failed = files.sync_tables(spark, {"nation": (news, ["n_nationkey"]), "region": (r, ["r_regionkey"]), "lost": (n, ["no_such_key"])}, {"nation": spark.read.parquet(second), "lost": n})
    named = lambda name, key, value: done[name].select(F.lit(name).alias("name"), F.col(key).cast("long").alias("key"), F.col(value).alias("value"), F.lit("").alias("error"))
    out = named("nation", "n_nationkey", "n_name").unionByName(named("region", "r_regionkey", "r_name"))
    lost = spark.createDataFrame([(name, None, None, "failed") for name in failed], out.schema)
    return out.unionByName(lost)


@query(C + "select chunk_id, length(coalesce(text, ''))::bigint as chars from chunks where doc_id % 2 = 0")
def collection_scroll(spark, d):
    """A whole collection, and one that is not there, which is empty."""
    path, kind = folder(spark, "collection"), "chunk_id string, chars long"
    chunks(spark, d).where("doc_id % 2 = 0").select("chunk_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")).write.parquet(path)
    return files.read_collection(spark, path, kind).unionByName(files.read_collection(spark, path + "-absent", kind))
