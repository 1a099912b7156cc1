"""Predicates over chunks, hits and talks, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import person_name, strip
from ..schemas import MIN_CHUNK_CHARS, SHARED_PARTITION, SHARED_TYPES

BOOK_TYPES = {"primary": "book", "secondary": "secondary_book"}


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def active() -> Column:
    return F.col("deprecated_at").isNull()


def payload(worldview: str | None = None, book_types: Iterable[str] = (), author: str | None = None) -> Column:
    """Worldview contained, author equal, chunk type among the given; what is not given does not filter."""
    types = [BOOK_TYPES.get(t, t) for t in book_types if t]
    tests = []
    if worldview:
        tests.append(F.array_contains("worldviews", worldview))
    if author:
        tests.append(F.col("author") == author)
    if types:
        tests.append(F.col("chunk_type").isin(types))
    return all_of(tests)


def key_values(wanted: dict, json: str = "metadata") -> Column:
    """Keys of a JSON column, compared as text; blank keys do not filter."""
    return all_of(F.get_json_object(json, f"$.{k.strip()}") == str(v) for k, v in wanted.items() if k and k.strip())


def source(source_id: str, chunk_type: str | None = None) -> Column:
    at = F.col("source_id") == source_id
    return at if chunk_type is None else at & (F.col("chunk_type") == chunk_type)


def embed_scope(partition: str, *, include_shared: bool = True, shared_sources: list[str] | None = None, sources: list[str] | None = None,
                types: list[str] | None = None, only_unembedded: bool = False, include_deprecated: bool = False) -> Column:
    """Rows to embed: the partition and the shared one. None is everything, an empty list is nothing."""
    scope = F.col("rag_partition") == partition
    if include_shared and shared_sources != []:
        shared = F.col("rag_partition") == SHARED_PARTITION
        scope = scope | (shared if shared_sources is None else shared & F.col("source_id").isin(shared_sources))
    tests = [scope]
    if sources:
        tests.append(F.col("source_id").isin(sources))
    if types is not None:
        tests.append(F.col("chunk_type").isin(types) if types else F.lit(False))
    if only_unembedded:
        tests.append(F.col("embedded_at").isNull())
    if not include_deprecated:
        tests.append(active())
    return all_of(tests)


def shared_scope(collection: str, column: str = "rag_partition") -> Column:
    return (F.col(column) == collection) | ((F.col(column) == SHARED_PARTITION) & F.col("chunk_type").isin(SHARED_TYPES))


def long_enough(text: str = "text", least: int = MIN_CHUNK_CHARS) -> Column:
    return F.length(strip(F.col(text))) >= least


def cap_hits(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """Per query the first k hits that are long enough, ranked anew. Hits: query_id, rank, text, ..."""
    kept = hits.where(long_enough())
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).where(F.col("rank") <= k)


def scoped(sources: Iterable[str] = (), types: Iterable[str] = ()) -> Column:
    """Hits of the given sources and types; an empty set does not filter, a null type never passes a type set."""
    sources, types = list(sources), list(types)
    tests = [F.col("source_id").isin(sources)] if sources else []
    return all_of(tests + ([F.coalesce(F.col("chunk_type").isin(types), F.lit(False))] if types else []))


def title_matches(title: Column, prefix: str) -> Column:
    """The title begins with the prefix, or with the title part of an id `Author#Title#N`."""
    direct = title.startswith(prefix)
    parts = prefix.split("#")
    return direct | title.startswith(parts[1].replace("_", " ")) if len(parts) >= 3 else direct


def first_failure(types: list[str], author: str | None, sources: list[str], prefix: str | None) -> Column:
    """Name of the first test that a hit fails (type, author, source, title), or `kept`."""
    out = F.lit("kept")
    if prefix:
        out = F.when(~F.coalesce(title_matches(F.col("source_title"), prefix), F.lit(False)), "title").otherwise(out)
    if sources:
        out = F.when(~F.coalesce(F.col("source_id").isin(sources), F.lit(False)), "source").otherwise(out)
    if author:
        out = F.when(~F.coalesce(person_name(F.col("author")) == person_name(F.lit(author)), F.lit(False)), "author").otherwise(out)
    if types:
        out = F.when(~F.coalesce(F.col("chunk_type").isin(types), F.lit(False)), "type").otherwise(out)
    return out


def id_prefix(column: str, prefix: str) -> Column:
    """LIKE on a prefix; its trailing per cent signs are one, an underscore is a wildcard."""
    return F.col(column).like(prefix.rstrip("%") + "%")


def title_like(needle: str, *columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{needle}%") for c in columns])


def talks(collection: str | None = None, statuses: str | None = None, q: str | None = None) -> Column:
    tests = []
    if collection:
        tests.append(F.col("collection") == collection)
    if statuses:
        tests.append(F.col("status").isin([s.strip() for s in statuses.split(",") if s.strip()]))
    if q:
        tests.append(F.col("title").ilike(f"%{q}%") | F.col("user_name").ilike(f"%{q}%"))
    return all_of(tests)


def talk_search(paragraph_id: str | None = None, pinned: bool = False, q: str | None = None) -> Column:
    """With a paragraph its talks, whether pinned or not; else talks without one, pinned ones if asked for."""
    tests = [F.col("paragraph_id") == paragraph_id] if paragraph_id else [F.col("paragraph_id").isNull()] + ([F.col("pinned")] if pinned else [])
    if q:
        tests.append(F.col("title").ilike(f"%{q}%") | F.col("summary").ilike(f"%{q}%"))
    return all_of(tests)


def tool_available(has_document: bool, mode: str) -> Column:
    """Manifests: requires_document (null: either way), modes (empty: all)."""
    return (F.col("requires_document").isNull() | (F.col("requires_document") == has_document)) & (
        (F.size("modes") == 0) | F.array_contains("modes", mode))
