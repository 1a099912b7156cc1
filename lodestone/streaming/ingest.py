"""The incremental ingest loop: batches merged into a chunk table of versions, and what has no vector embedded in rounds.

The table holds a base and, for every step, only the rows that the step has changed; reading takes a key's row of the
highest version. A step reads what came before its own version and overwrites that version, so a batch that is replayed
after a failure changes nothing, and a small batch writes little, however large the table is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.models import embed, hashed_embedding
from ..operators.filters import active
from ..operators.merge import KEY, upsert
from ..operators.ranking import running
from ..sources.scratch import folder

#: Distance between the versions of two batches: each writes its merge and the rounds of embedding after it.
STEPS = 1_000
MAX_CHUNKS = 5_000


class VersionedChunks:
    """A chunk table under `path`; `base` makes version -1."""

    def __init__(self, spark: SparkSession, path: str, base: DataFrame | None = None):
        self.spark, self.path = spark, path
        if base is not None:
            self.write(base.withColumn("embedding", F.lit(None).cast("array<float>")) if "embedding" not in base.columns else base, -1)

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def rows(self, before: int | None = None) -> DataFrame:
        """All rows of the versions below `before`, with their version."""
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        return rows if before is None else rows.where(F.col("version") < before)

    def current(self, before: int | None = None, keys: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
        """A row for each key, of the versions below `before`; with `keys`, for these only; with `columns`, KEY and these only."""
        rows = self.rows(before)
        rows = rows if columns is None else rows.select(*KEY, "version", *columns)
        rows = rows if keys is None else rows.join(keys, KEY, "left_semi")
        names = [c for c in rows.columns if c not in (*KEY, "version")]
        last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*names), "version").alias("row"))
        return last.select(*KEY, "row.*")

    def compact(self, before: int, path: str) -> VersionedChunks:
        """The same rows as one base elsewhere."""
        return VersionedChunks(self.spark, path, self.current(before))


def merge_batch(table: VersionedChunks, batch: DataFrame, version: int, now: Column) -> None:
    """What the batch inserts or updates becomes `version`. Rows whose hash stays keep their vector."""
    keys = batch.select(*KEY).distinct()
    stored = table.current(version, keys)
    merged = upsert(stored, batch, now).where("action != 'kept'").drop("action")
    vectors = table.current(version, keys, ["embedding", "content_hash"]).withColumnRenamed("content_hash", "__hash")
    kept = F.when(F.col("__hash") == F.col("content_hash"), F.col("embedding"))
    table.write(merged.join(vectors, KEY, "left").withColumn("embedding", kept).drop("__hash"), version)


def embed_waiting(table: VersionedChunks, version: int, now: Column, max_chunks: int = MAX_CHUNKS, model: Callable = hashed_embedding) -> int:
    """All active rows without a vector are embedded as `version`, `max_chunks` a round by (updated_at, chunk_id); the rounds' number.

    What waits is found once, without texts, and numbered through; only its rows are then read whole, and written round by
    round. So a round costs what its own rows cost, however many rounds there are. A repeated call writes the same again.
    """
    spark = table.spark
    waits = F.col("embedded_at").isNull() & active()
    last = table.rows(version).groupBy(*KEY).agg(F.max_by(F.struct("version", "updated_at", waits.alias("waits")), "version").alias("row"))
    waiting = last.where("row.waits").select(*KEY, "row.version", F.struct("row.updated_at", "chunk_id", "rag_partition").alias("place"), F.lit(0).alias("all"))
    rounds = running(waiting, "all", "place", []).select(*KEY, "version", F.expr(f"(n - 1) div {max_chunks}").alias("round"))
    rows = table.rows(version).where(waits).join(rounds, [*KEY, "version"]).drop("version", "embedding")
    path = folder(spark, "waiting")
    # Each round's rows in several files: the model is called for them in many tasks.
    rows.repartition("round", F.pmod(F.xxhash64("chunk_id"), F.lit(spark.sparkContext.defaultParallelism))).write.partitionBy("round").parquet(path)
    dealt = spark.read.schema(rows.schema).parquet(path)
    n = (rounds.agg(F.max("round")).first()[0] or 0) + 1  # without any, one that is empty
    for r in range(n):
        embedded = embed(dealt.where(F.col("round") == r).drop("round"), model=model).withColumn("embedded_at", now)
        embedded.write.mode("append" if r else "overwrite").parquet(f"{table.path}/version={version}")
    return n


def step(table: VersionedChunks, now: Column, max_chunks: int = MAX_CHUNKS, model: Callable = hashed_embedding) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge a batch, then embed in rounds until nothing waits. Repeating a batch writes the same versions."""

    def run(batch: DataFrame, batch_id: int) -> None:
        first = batch_id * STEPS
        merge_batch(table, batch, first, now)
        embed_waiting(table, first + 1, now, max_chunks, model)

    return run


def ingest(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None]) -> None:
    """Batches of what is there, one after another; `each` must bear being repeated for a batch after a failure."""
    where = folder(stream.sparkSession, name)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def chunk_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
