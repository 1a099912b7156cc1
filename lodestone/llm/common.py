"""Shared pieces of the pipeline operators: durable intermediate tables, size checks and components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of a word in the text contracts.
WS_CLASS = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of a batch that goes to a Python worker: texts may be very long, and a worker holds a batch at once.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"

_own_dir: str | None = None
_written: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a folder of our own, on one machine only."""
    global _own_dir
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lodestone-")
    return _own_dir


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker, and the executor beside it, holds of a table at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, sizes are known, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    _written.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are materialized inside are removed at the end, but for those put into the list that is given."""
    start, keep = len(_written), []
    try:
        yield keep
    finally:
        kept = {df._lodestone_path for df in keep}
        discard(*[df for df in _written[start:] if getattr(df, "_lodestone_path", None) not in kept])
        _written[start:] = keep


def discard(*frames: DataFrame) -> None:
    """Remove materialized tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_lodestone_path", None):
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            df._lodestone_path = None


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many leading underscores as keep them apart from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def sweep(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of tables that have been written: its cleaner waits for the driver's garbage
    collection, which may not come for long while the executors' disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes. Hashing a word anew costs less than to look it up in a table."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def lower_ascii(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def connected_components(nodes_links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), component being the smallest node that links reach.

    Alternating large-star and small-star rounds. Each round is two minimum aggregations (combined
    before the shuffle) and two plain equi-joins of written tables, so a hub's links can be split by
    adaptive execution; nothing is gathered on the driver but the number of changed links.
    """
    links = (
        nodes_links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u != v")
        .distinct()
    )
    edges = materialize(links, "cc")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        large = materialize(large, "cc-large")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v")))
            .where("u != v").distinct()
        )
        after = materialize(small, "cc")
        # Done when every node points straight at a root and no root points anywhere.
        open_ends = after.select(F.col("v").alias("u")).distinct().join(after.select("u").distinct(), "u", "left_semi")
        forks = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        done = open_ends.union(forks).isEmpty()
        discard(edges, large)
        edges = after
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
