"""Merging chunk batches into stored versions: every operator returns the new version as a frame, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..schemas import SEARCH_KEYS
from .filters import active

KEY = ["rag_partition", "chunk_id"]


def resolve_source_type(own: Column, default: Column) -> Column:
    return F.coalesce(blank_to_null(own), blank_to_null(default))


def upsert(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """stored after the batch (one row a key there), with `action`: inserted, updated or kept.

    A row is updated if its hash or payload differs or it was deprecated; embedded_at is cleared only where the hash
    differs, deprecated_at always.
    """
    fields = [c for c in batch.columns if c not in (*KEY, "embedded_at", "deprecated_at")]
    new = batch.select(*KEY, F.struct(*fields).alias("new"))
    old = stored.select(*KEY, F.struct(*fields, "embedded_at", "deprecated_at").alias("old"))
    both = old.join(new, KEY, "full")
    rehashed = ~F.col("old.content_hash").eqNullSafe(F.col("new.content_hash"))
    differs = F.lit(False)
    for c in fields:
        if c != "updated_at":
            differs = differs | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(differs | F.col("old.deprecated_at").isNotNull(), "updated").otherwise("kept")
    both = both.withColumn("action", action)
    take = F.col("action") == "kept"
    written = [F.when(take, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in fields if c != "updated_at"]
    return both.select(
        *KEY, *written, F.when(take, F.col("old.updated_at")).otherwise(now).alias("updated_at"),
        F.when(take, F.col("old.embedded_at")).when((F.col("action") == "updated") & ~rehashed, F.col("old.embedded_at")).alias("embedded_at"),
        F.when(take, F.col("old.deprecated_at")).alias("deprecated_at"), "action")


def classify(batch: DataFrame, points: DataFrame) -> DataFrame:
    """batch with `change`: new, changed_embed, payload_only or unchanged, against the points of the vector store.

    Of the search keys those are compared that both have; a key that neither has is equal.
    """
    keys = [c for c in SEARCH_KEYS if c in points.columns and c in batch.columns]
    if alone := [c for c in SEARCH_KEYS if (c in points.columns) != (c in batch.columns)]:
        raise ValueError(f"only one side has {alone}")
    old = points.select("chunk_id", F.struct("content_hash", "chunk_type", *keys).alias("old"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(c))
    hashed = F.coalesce(F.col("old.content_hash") == F.col("content_hash"), F.lit(False))
    typed = F.coalesce(F.col("old.chunk_type") == F.col("chunk_type"), F.lit(False))
    change = F.when(F.col("old").isNull(), "new").when(~hashed, "changed_embed").when(typed & same, "unchanged").otherwise("payload_only")
    return batch.join(old, "chunk_id", "left").withColumn("change", change).drop("old")


def ingest_report(classified: DataFrame) -> DataFrame:
    n = lambda what: F.count_if(F.col("change") == what).alias(what)
    return classified.agg(F.count("*").alias("requested"), n("new"), n("changed_embed"), n("payload_only"), n("unchanged"))


def ingest_counters(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """requested, duplicates, ingested, unchanged, changed, new, stale: one row about a batch whose rows may repeat.

    Stale are stored rows of the batch's sources and types that it does not name.
    """
    once = batch.dropDuplicates(["chunk_id", "content_hash"])
    counted = classify(once, stored).agg(
        F.count("*").alias("rows"), F.count_if(F.col("change") != "unchanged").alias("ingested"), F.count_if(F.col("change") == "unchanged").alias("unchanged"),
        F.count_if(F.col("change").isin("changed_embed", "payload_only")).alias("changed"), F.count_if(F.col("change") == "new").alias("new"))
    left = stale_points(stored, batch, batch).agg(F.count("*").alias("stale"))
    asked = batch.agg(F.count("*").alias("requested"))
    return asked.crossJoin(counted).crossJoin(left).select(  # one row each
        "requested", (F.col("requested") - F.col("rows")).alias("duplicates"), "ingested", "unchanged", "changed", "new", "stale")


def replace_keys(mirror: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by key, then insert."""
    return mirror.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def orphans(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Active rows of the sources that `current` (source_id, chunk_id) names, whose id it does not name."""
    named = current.select("source_id").distinct()
    return stored.where(active()).join(named, "source_id", "left_semi").join(current.select("source_id", "chunk_id").distinct(), ["source_id", "chunk_id"], "left_anti")


def deprecate(stored: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Active rows among ids (rag_partition, chunk_id) get a deprecation time."""
    marks = ids.select(*KEY).distinct().withColumn("__hit", F.lit(True))
    return stored.join(marks, KEY, "left").withColumn(
        "deprecated_at", F.when(F.col("__hit") & F.col("deprecated_at").isNull(), now).otherwise(F.col("deprecated_at"))).drop("__hit")


def mark_embedded(stored: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Rows with these chunk ids, in whatever partition, get an embedding time."""
    marks = ids.select("chunk_id").distinct().withColumn("__hit", F.lit(True))
    return stored.join(marks, "chunk_id", "left").withColumn("embedded_at", F.when(F.col("__hit"), now).otherwise(F.col("embedded_at"))).drop("__hit")


def stale_points(points: DataFrame, current: DataFrame, scope: DataFrame) -> DataFrame:
    """Points within scope (source_id, chunk_type) that are not among the current ids; an empty current set makes all stale."""
    keys = ["source_id", "chunk_type"]
    return points.join(scope.select(*keys).distinct(), keys, "left_semi").join(current.select(*keys, "chunk_id").distinct(), [*keys, "chunk_id"], "left_anti")


class GuardedDelete:
    """mirror and points after the delete, and how many rows matched and were deleted."""

    def __init__(self, mirror: DataFrame, points: DataFrame, matched: int, deleted: int):
        self.mirror, self.points, self.matched, self.deleted = mirror, points, matched, deleted


def delete_guarded(mirror: DataFrame, points: DataFrame, where: Column | None = None, prefix: str | None = None, everything: bool = False, limit: int | None = None, dry_run: bool = False) -> GuardedDelete:
    """Delete chunks that a filter, a prefix of source_id, or everything selects, from the mirror and from the points.

    One of the three has to be given; a prefix excludes `everything`. Where the mirror has no row that matches, the points
    are searched instead, but for a prefix, of which the mirror alone knows; for `everything` that takes a limit. The ids
    are written by the job that counts them, at most limit + 1 of the points; more than `limit` raise before anything is
    deleted, and what is deleted are the written ids. A dry run only counts.
    """
    from pyspark.sql import Observation

    from ..sources.scratch import written

    if where is None and not prefix and not everything:
        raise ValueError("a filter, a prefix or everything has to be given")
    if everything and prefix:
        raise ValueError("everything and a prefix exclude each other")
    test = F.lit(True)
    if not everything:
        test = (where if where is not None else F.lit(True)) & (F.startswith("source_id", F.lit(prefix)) if prefix else F.lit(True))

    def counted(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        ids = written(rows.select("chunk_id").observe(seen, F.count("*").alias("n")), "deleted-ids")
        return ids, seen.get["n"]

    ids, n = counted(mirror.where(test))
    if n == 0 and not prefix:
        if everything and limit is None:
            raise ValueError("the mirror is empty: everything takes a limit")
        found = points.where(test)
        ids, n = counted(found if limit is None else found.limit(limit + 1))
    if limit is not None and n > limit:
        raise ValueError(f"{n} chunks match, {limit} are allowed")
    if dry_run or n == 0:
        return GuardedDelete(mirror, points, n, 0)
    gone = ids.distinct()
    return GuardedDelete(mirror.join(gone, "chunk_id", "left_anti"), points.join(gone, "chunk_id", "left_anti"), n, n)


def embed_type(chunk_type: Column, source_type: Column, override: Column) -> Column:
    """A given type replaces `book` for books and lectures."""
    return F.when(override.isNotNull() & source_type.isin("book", "lecture") & (chunk_type == "book"), override).otherwise(chunk_type)


def set_payload(points: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Payload fields of the named points; vectors and other fields stay."""
    new = updates.select("chunk_id", F.struct(*fields).alias("__new"))
    joined = points.join(new, "chunk_id", "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in points.columns])


def set_vector(points: DataFrame, updates: DataFrame, key: str, name: str) -> DataFrame:
    """points with the vector of one name (in the map `vectors`) set from updates (key, vector); all else stays."""
    joined = points.join(updates.select(key, F.col("vector").alias("__new")), key, "left")
    kept = F.map_filter("vectors", lambda k, _: k != name)
    return joined.withColumn("vectors", F.when(F.col("__new").isNotNull(), F.map_concat(kept, F.create_map(F.lit(name), "__new"))).otherwise(F.col("vectors"))).drop("__new")
