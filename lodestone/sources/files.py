"""File sources: JSON lines, text, word-count tables, directories, manifests. All reading is Spark's."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_name, strip
from ..schemas import CHUNK


def parse_json_lines(lines: DataFrame, schema: T.StructType = CHUNK) -> DataFrame:
    """Rows of `value` as schema plus `bad` (the line where it is no such object, else null); blank and `#` lines go."""
    kept = lines.where((strip(F.col("value")) != "") & ~F.ltrim("value").startswith("#"))
    marked = T.StructType([*schema.fields, T.StructField("bad", T.StringType())])
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return kept.select(parsed.alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType = CHUNK, strict: bool = True) -> DataFrame:
    """Chunks of JSON-lines files. strict: a line that does not parse fails the batch and is shown."""
    rows = parse_json_lines(spark.read.text(path), schema)
    if not strict:
        return rows
    fail = F.raise_error(F.concat(F.lit("not a record: "), F.left("bad", F.lit(200)))).cast("string")
    first = schema.fields[0].name
    return rows.withColumn(first, F.when(F.col("bad").isNotNull(), fail).otherwise(F.col(first))).drop("bad")


def quote_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """chunk_id, content_hash, paragraph of quotes and explanations with a paragraph of 1 or more, with their file."""
    meta = "struct<metadata:struct<chunk_id:string,content_hash:string,chunk_type:string,paragraph:int>>"
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", meta).alias("r")).select("file", "r.metadata.*")
    return rows.where("chunk_type in ('quote', 'quote_explanation') and paragraph >= 1")


def catalogue(spark: SparkSession, base: str) -> DataFrame:
    """category (first folder), name, author and title from the name, size, time of all .txt files; hidden folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(base).select("path", "length", "modificationTime")
    inner = F.split_part(F.col("path"), F.lit(base.rstrip("/") + "/"), F.lit(-1))
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.txt$", "")
    return files.select(
        F.when(inner.contains("/"), F.substring_index(inner, "/", 1)).alias("category"), name.alias("name"), "path",
        F.when(stem.contains("@"), clean_name(F.substring_index(stem, "@", 1))).alias("author"), clean_name(F.substring_index(stem, "@", -1)).alias("title"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")).where("category is null or not startswith(category, '.')")


def decode(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8."""
    return F.when(F.expr("is_valid_utf8(cast(content as string))"), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, kind and error of files, by their extension; unknown kinds are rows with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = kind.isin("txt", "md", "csv", "quantify")
    return files.select("path", F.when(known, kind).otherwise("unknown").alias("kind"), F.when(known, decode(F.col("content"))).alias("text"),
                        F.when(~known, F.concat(F.lit("unknown file type: "), kind)).alias("error"))


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """word, type, count, percentage of CSV files with these columns; counts that are no digits are 0."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select("word", "type", F.when(F.col("count").rlike("^[0-9]+$"), F.col("count").try_cast("int")).otherwise(0).alias("count"),
                       F.translate("percentage", "%", "").alias("percentage"))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("count", T.LongType())])))
def quantify(texts: pa.Array) -> pa.Array:
    """Literal dictionaries `{'word_stats': {word: count}}` or lists of such entries; what is neither has no entries."""
    import ast

    def one(text):
        try:
            stats = ast.literal_eval(text or "").get("word_stats", [])
        except (ValueError, SyntaxError, AttributeError):
            return []
        items = stats.items() if isinstance(stats, dict) else [(s.get("word"), s.get("count")) for s in stats if isinstance(s, dict)]
        return [(str(w), int(c)) for w, c in items if isinstance(c, int)]

    words, counts, ends = [], [], [0]
    for text in texts.to_pylist():
        for w, c in one(text):
            words.append(w)
            counts.append(c)
        ends.append(len(words))
    entries = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "count"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


def manifest(spark: SparkSession, path: str) -> dict:
    """A YAML manifest; a bounded file of settings."""
    import yaml

    return yaml.safe_load("\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect())) or {}


def list_actions(actions: DataFrame, primary: list[str], beta: bool = False) -> DataFrame:
    """Actions (id, label, beta) in their fixed order, others behind by id; beta ones say so and may be left out."""
    at = F.array_position(F.array(*[F.lit(p) for p in primary]), F.col("id"))
    shown = actions if beta else actions.where(~F.coalesce("beta", F.lit(False)))
    label = F.when(F.col("beta"), F.concat("label", F.lit(" (beta)"))).otherwise(F.col("label"))
    return shown.select("id", label.alias("label"), F.when(at > 0, at).alias("__at")).orderBy(F.asc_nulls_last("__at"), "id").drop("__at")


def write_report(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def copy_checked(spark: SparkSession, source: str, target: str) -> int:
    """Copy a table and compare the counts; a difference raises."""
    spark.read.parquet(source).write.parquet(target)
    a, b = (spark.read.parquet(p).count() for p in (source, target))
    if a != b:
        raise RuntimeError(f"{a} rows were read, {b} are there")
    return b


def sync_tables(spark: SparkSession, sources: dict[str, tuple[DataFrame, list[str]]], targets: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Upsert tables by key; a table that fails is skipped and named with its error."""
    from ..operators.merge import replace_keys

    done, failed = {}, {}
    for name, (df, keys) in sources.items():
        try:
            done[name] = replace_keys(targets[name], df, keys) if name in targets else df
        except Exception as error:  # the sync goes on with the other tables
            failed[name] = str(error).splitlines()[0]
    return done, failed


def read_collection(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All points of a collection; one that does not exist yet is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
