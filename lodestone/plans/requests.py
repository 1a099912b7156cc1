"""Retrieval as requests ask for it: by method, by intent with a second try, in slots of one prompt, and verified in two passes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import filters, joins
from ..schemas import CONTEXT_CHARS, INTENT_TYPES, SKIP_INTENTS
from ..sources.scratch import folder
from . import fusion
from .dense import dense_retrieve, with_payload
from .sparse import Split, query_terms, sparse_retrieve, split

PAYLOAD = ("text", "chunk_type", "source_id", "source_title", "author", "parent_id")


@dataclass(frozen=True)
class Corpus:
    """What requests are answered from: chunks, their vectors, and the queries as vectors and as texts."""

    chunks: DataFrame
    vectors: DataFrame
    query_vectors: DataFrame
    query_texts: DataFrame
    held: Split | None = None

    def split(self) -> Corpus:
        """With all texts split once for all queries: for plans of several sparse searches."""
        return replace(self, held=split(self.chunks, query_terms(self.query_texts)))

    def only(self, ids: DataFrame) -> Corpus:
        """For the queries whose ids are given."""
        some = lambda q: q.join(ids.select("query_id"), "query_id", "left_semi")
        return replace(self, query_vectors=some(self.query_vectors), query_texts=some(self.query_texts))

    def dense(self, k: int, where: Column | None = None) -> DataFrame:
        return dense_retrieve(self.chunks, self.vectors, self.query_vectors, k, where)

    def sparse(self, k: int, where: Column | None = None) -> DataFrame:
        return sparse_retrieve(self.chunks, self.query_texts, k, where, self.held)

    def hybrid(self, k_dense: int, k_sparse: int, k: int, where: Column | None = None) -> DataFrame:
        """Dense and sparse hits fused; dense ones alone where no sparse ones are wanted."""
        dense = self.dense(k_dense, where)
        if not k_sparse:
            return dense.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
        return fusion.rrf(dense, self.sparse(k_sparse, where), k)


@dataclass(frozen=True)
class Spec:
    """One query of a plan. method: dense, sparse, hybrid or dense+sparse; k hits of k_retrieve candidates."""

    name: str
    method: str = "dense"
    types: tuple[str, ...] = ()
    author: str | None = None
    k: int = 1
    k_retrieve: int = 0
    k_sparse: int = 0
    no_sparse: bool = False

    def where(self) -> Column:
        return filters.payload(book_types=self.types, author=self.author)


def run(corpus: Corpus, spec: Spec) -> DataFrame:
    """query_id, rank, chunk_id, score: the hits that a spec asks for; k is 1 at least, k_retrieve k at least."""
    k = max(spec.k, 1)
    wide, where = max(spec.k_retrieve, k), spec.where()
    if spec.method == "hybrid":
        hits = corpus.hybrid(wide, 0 if spec.no_sparse else wide, wide, where)
    elif spec.method == "dense+sparse" and not spec.no_sparse:
        hits = fusion.slots(corpus.dense(wide, where), corpus.sparse(wide, where), k, spec.k_sparse)
    elif spec.method == "sparse":
        hits = corpus.sparse(wide, where)
    else:
        hits = corpus.dense(wide, where)
    return hits.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def quotes_and_books(corpus: Corpus, k_branch: int, k: int, author: str) -> DataFrame:
    """Hybrid hits among quotes and among one author's books, fused."""
    scopes = filters.payload(book_types=["quote", "quote_explanation"]), filters.payload(book_types=["primary", "secondary"], author=author)
    return fusion.rrf(*[corpus.hybrid(k_branch, k_branch, k_branch, s) for s in scopes], k)


def by_intent(corpus: Corpus, requests: DataFrame, author: str) -> DataFrame:
    """query_id, attempt, rank, chunk_id, score, sufficiency of every request that needs retrieval.

    requests: query_id, intent, source_id (null: any). An intent decides the chunk types of the first attempt. Requests
    whose hits, within their source, are insufficient get a second one, wider and of all types. Requests without a hit in
    the end have one row without a chunk.
    """
    corpus = corpus.split()
    asked = requests.where(~F.col("intent").isin(SKIP_INTENTS)).withColumn("intent", F.when(F.col("intent").isin(list(INTENT_TYPES)), F.col("intent")).otherwise("sonstiges"))

    def within(hits: DataFrame) -> DataFrame:
        found = with_payload(hits, corpus.chunks, "source_id").withColumnRenamed("source_id", "__source").join(asked.select("query_id", "source_id"), "query_id")
        return found.where(F.col("source_id").isNull() | (F.col("source_id") == F.col("__source"))).select("query_id", "rank", "chunk_id", "score")

    first = None
    for intent, types in INTENT_TYPES.items():
        some = corpus.only(asked.where(F.col("intent") == intent))
        hits = quotes_and_books(some, 8, 12, author) if intent == "quelle_suchen" else some.hybrid(15, 15, 10, filters.payload(book_types=types))
        first = hits if first is None else first.unionByName(hits)
    first = _kept(within(first), "first-attempt")
    level = fusion.sufficiency_by_score(first, asked)
    again = asked.join(level.where("sufficiency = 'insufficient'"), "query_id", "left_semi")
    second = _kept(within(corpus.only(again).hybrid(25, 25, 15)), "second-attempt")
    level = level.where("sufficiency != 'insufficient'").withColumn("attempt", F.lit(1)).unionByName(fusion.sufficiency_by_score(second, again).withColumn("attempt", F.lit(2)))
    return level.join(first.unionByName(second), "query_id", "left").select("query_id", "attempt", "rank", "chunk_id", "score", "sufficiency")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: later steps use it more than once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prompt_slots(corpus: Corpus, specs: list[Spec], budget: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, slot, n, chunk_id, line: the numbered context of each slot; numbers run on from slot to slot.

    Explanations in slots of quotes become their quotes, each once. A slot takes hits until its lines exceed the budget.
    """
    out, start = None, None
    for spec in specs:
        hits = with_payload(run(corpus, spec), corpus.chunks, "chunk_type", "parent_id")
        if set(spec.types) & {"quote", "quote_explanation"}:
            hits = joins.swap_once(hits, corpus.chunks)
        hits = with_payload(hits.drop("chunk_type"), corpus.chunks, "text", "chunk_type")
        texts = hits.withColumn("text", strip(F.col("text"))).where("text != ''")
        texts = texts.join(start, "query_id", "left") if start is not None else texts.withColumn("start", F.lit(0))
        at = Window.partitionBy("query_id").orderBy("rank")
        lines = texts.withColumn("n", F.row_number().over(at) + F.coalesce("start", F.lit(0)))
        head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] (r: "), F.format_string("%.4f", F.round("score", 4)), F.lit(", "), "chunk_type", F.lit(") "))
        lines = lines.withColumn("line", F.concat(head, "text"))
        upto = F.sum(F.length("line")).over(at.rowsBetween(Window.unboundedPreceding, 0))
        packed = lines.withColumn("upto", upto).where(F.col("upto") <= budget).select("query_id", F.lit(spec.name).alias("slot"), "n", "chunk_id", "line")
        packed = _kept(packed, "slot")
        out = packed if out is None else out.unionByName(packed)
        start = out.groupBy("query_id").agg(F.max("n").alias("start"))
    return out


def quote_sources(corpus: Corpus, books: int = 4, lectures: int = 4) -> DataFrame:
    """The context of a quote: hits in books, then hits in lectures."""
    first, second = corpus.dense(books, filters.payload(book_types=["primary"])), corpus.dense(lectures, filters.payload(book_types=["talk", "talk_summary"]))
    rows = first.select("query_id", "chunk_id", "score", F.lit(0).alias("part"), "rank").union(second.select("query_id", "chunk_id", "score", F.lit(1).alias("part"), "rank"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank"))).select("query_id", "rank", "part", "chunk_id", "score")


def reranked(corpus: Corpus, k_base: int, k: int, where: Column, widen_to: int = 0) -> DataFrame:
    """Dense hits reordered by their vectors; for queries with too few of them, or too little text, those of a wider list."""
    vectors = corpus.vectors.select("chunk_id", "embedding")
    asked = corpus.query_vectors.select("query_id", F.col("embedding").alias("query_embedding"))
    again = lambda hits: fusion.rerank(hits.join(vectors, "chunk_id", "left").join(asked, "query_id"), k).drop("embedding", "query_embedding")
    base = _kept(again(corpus.dense(k_base, where)), "reranked")
    if not widen_to:
        return base
    enough = base.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).where((F.col("n") >= k) & (F.col("chars") >= 400))
    thin = corpus.only(corpus.query_vectors.join(enough, "query_id", "left_anti"))
    wide = fusion.rerank(thin.dense(widen_to, where).join(vectors, "chunk_id", "left").join(asked, "query_id"), k).drop("embedding", "query_embedding")
    return base.join(enough.select("query_id"), "query_id", "left_semi").unionByName(wide)


def two_passes(corpus: Corpus, derived: Corpus, where: Column, k_base: int = 18, k: int = 8, widen_to: int = 48) -> DataFrame:
    """query_id, pass, rank, chunk_id: hits of a query, widened where they are thin, then those of the query derived from it."""
    first, second = reranked(corpus, k_base, k, where, widen_to), reranked(derived, k_base, k, where)
    one = lambda hits, n: hits.select("query_id", F.lit(n).alias("pass"), "rank", "chunk_id")
    return one(first, 1).union(one(second, 2))
