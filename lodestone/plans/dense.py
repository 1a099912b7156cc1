"""Dense retrieval: exact cosine top-k of many queries over all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import folder

#: Floats of query vectors that one pass broadcasts; more queries take further passes over the vectors.
BLOCK_FLOATS = 8_000_000
DIGITS = 9
#: Vectors and queries of one product; times the wanted hits that a task gathers before it ranks them.
ROWS, COLUMNS, HELD = 2_000, 2_048, 4
#: Hits that a task may gather in one pass; queries whose wanted hits are more take further passes.
HELD_ROWS = 2_000_000


def _unit_rows(values: pa.ListArray, width: int) -> np.ndarray:
    """Vectors of length 1; those of other widths are 0, so that they keep the score 0."""
    out = np.zeros((len(values), width))
    good = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width
    if good.any():
        m = np.asarray(values.filter(pa.array(good)).flatten(), dtype=np.float64).reshape(-1, width)
        out[good] = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return out


def _best(held: list[pa.Table], fetch: int) -> pa.Table:
    """The first `fetch` of each query by (score desc, key), in this order."""
    table = pa.concat_tables(held)
    table = table.take(pc.sort_indices(table, [("q", "ascending"), ("score", "descending"), ("key", "ascending")]))
    q = table.column("q").to_numpy()
    return table.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < fetch))


def _scored(vectors: DataFrame, block: list[tuple], fetch: int, id_field: T.StructField) -> DataFrame:
    """(query_id, chunk_id, score): each task's own best `fetch` rows of each query, by (score desc, chunk_id)."""
    key = vectors.schema["chunk_id"]
    ids = pa.array([r[0] for r in block], to_arrow_type(id_field.dataType))
    q = np.array([r[1] for r in block], dtype=np.float64).reshape(len(block), -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))
    schema = T.StructType([id_field, key, T.StructField("score", T.DoubleType())])

    def run(batches):
        ids, unit = shared.value
        held, least = [], np.full(len(unit), -np.inf)
        for batch in batches:
            for rows in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                m, keys = _unit_rows(rows.column("embedding"), unit.shape[1]), rows.column("chunk_id")
                for lo in range(0, len(unit), COLUMNS):
                    at = slice(lo, lo + COLUMNS)
                    score = np.round(m @ unit[at].T, DIGITS) + 0.0
                    hit = score >= least[at]  # all that ties with the last place stays until the keys decide
                    if len(score) > fetch and np.count_nonzero(hit) > fetch * score.shape[1]:
                        hit &= score >= np.partition(score, len(score) - fetch, axis=0)[len(score) - fetch]
                    row, col = np.nonzero(hit)
                    held.append(pa.table({"q": pa.array(col + lo, pa.int32()), "score": score[row, col], "key": keys.take(pa.array(row))}))
            if sum(t.num_rows for t in held) > HELD * fetch * len(unit):
                held = [_best(held, fetch)]
                q, first, n = np.unique(held[0].column("q").to_numpy(), return_index=True, return_counts=True)
                full = n == fetch
                least[q[full]] = held[0].column("score").to_numpy()[first[full] + fetch - 1]
        if held:
            best = _best(held, fetch).combine_chunks()
            for part in best.to_batches():
                yield pa.RecordBatch.from_arrays([ids.take(part.column("q")), part.column("key"), part.column("score")], names=schema.names)

    return vectors.select("chunk_id", "embedding").mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, fetch: int) -> DataFrame:
    """query_id, rank, chunk_id, score. vectors: chunk_id, embedding; queries: query_id, embedding.

    Every task scores its vectors against a broadcast block of queries and passes on its best `fetch`
    rows a query; these are ranked per query. Ties go to the smaller chunk_id. While the queries, or their hits, need more than one
    block, blocks are gathered, searched and written one after another, so the driver holds one at a time.
    """
    spark = vectors.sparkSession
    id_field = T.StructField("query_id", queries.schema["query_id"].dataType)
    asked, floats = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-floats // BLOCK_FLOATS), -(-asked * fetch * HELD // HELD_ROWS))
    out = None
    for b in range(blocks):
        some = queries.select("query_id", "embedding") if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "embedding")
        rows = [(r["query_id"], r["embedding"]) for r in some.collect()]  # about BLOCK_FLOATS numbers
        found = _scored(vectors, rows, fetch, id_field) if rows else spark.createDataFrame([], T.StructType([id_field, vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())]))
        if blocks > 1:
            path = folder(spark, "scored")
            found.write.parquet(path)
            found = spark.read.schema(found.schema).parquet(path)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= fetch).select("query_id", "rank", "chunk_id", "score")


def with_payload(ranked: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Hits with columns of their chunks. There are at most fetch * queries hits, so the planner may broadcast them."""
    return ranked.join(chunks.select("chunk_id", *columns), "chunk_id")


def dense_retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Filter, top-k with over-fetch, then the length filter: fewer than k hits may be left, as many as the over-fetch holds."""
    from ..operators.filters import cap_hits
    from ..schemas import overfetch

    scope = chunks if where is None else chunks.where(where)
    inside = vectors.join(scope.select("chunk_id"), "chunk_id", "left_semi")
    hits = with_payload(top_k(inside, queries, overfetch(k)), scope, "text", "chunk_type", "source_id", "source_title", "author", "parent_id")
    return cap_hits(hits, k)
