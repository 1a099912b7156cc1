"""The typology cascade: a request goes on to the next, wider stage only where the one before has left it unmet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import cap_hits
from ..sources.scratch import written
from . import context, fusion
from .dense import dense_retrieve, top_k, with_payload
from .sparse import sparse_top

#: Hits of the stages, what is enough for the first, lists and fused hits of the last, what is reranked and packed.
NARROW, ENOUGH, WIDE, LISTS, FUSED, RERANKED, CHARS = 14, 6, 28, 24, 40, 12, 14_000
_FIELDS = ("text", "chunk_type", "source_id", "source_title", "author", "parent_id")


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, where: Column, k: int = LISTS, fused: int = FUSED) -> DataFrame:
    """Dense and sparse lists over all chunks, fused; the filter comes after, as it does where the lists are another service's."""
    inside = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    both = fusion.rrf(top_k(inside, queries, k), sparse_top(chunks, queries.select("query_id", "text"), k), fused)
    return cap_hits(with_payload(both, chunks, *_FIELDS).where(where), fused)


def typology(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """query_id, rank, chunk_id, stage, text, cum, packed: the context of each request.

    queries: query_id, embedding, text, scope; scopes: name -> filter of chunks, one for each typology. Stage 1 takes
    the best NARROW chunks of the scope, stage 2 the best WIDE for requests with fewer than ENOUGH, stage 3 fused
    lists for those that still have none. Each stage's hits are written, so the next reads the unmet requests' ids from them.
    """
    stages, unmet = [], queries
    for name, found in (("narrow", lambda q, w: dense_retrieve(chunks, vectors, q, NARROW, w)), ("wide", lambda q, w: dense_retrieve(chunks, vectors, q, WIDE, w)),
                        ("hybrid", lambda q, w: hybrid(chunks, vectors, q, w))):
        hits = None
        for scope, where in scopes.items():
            asked = unmet.where(F.col("scope") == scope)
            if not asked.isEmpty():
                part = found(asked.drop("scope"), where).select("query_id", "rank", "chunk_id", "score", *_FIELDS)
                hits = part if hits is None else hits.unionByName(part)
        if hits is None:
            break
        hits = written(hits.withColumn("stage", F.lit(name)), "cascade")
        enough = hits.groupBy("query_id").count().where(F.col("count") >= (ENOUGH if name == "narrow" else 1)).select("query_id")
        stages.append(hits.join(enough, "query_id", "left_semi"))
        unmet = written(unmet.join(enough, "query_id", "left_anti"), "unmet")
    chosen = stages[0]
    for s in stages[1:]:
        chosen = chosen.unionByName(s)
    with_vectors = chosen.join(vectors.select("chunk_id", "embedding"), "chunk_id").join(
        queries.select("query_id", F.col("embedding").alias("query_embedding")), "query_id")
    best = fusion.rerank(with_vectors, RERANKED)
    return context.pack(best, CHARS).join(chosen.select("query_id", "chunk_id", "stage"), ["query_id", "chunk_id"])
