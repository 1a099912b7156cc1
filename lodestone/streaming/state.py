"""State of keyed streams: bounded histories and prompt states that expire, by transformWithState.

The state lies in the RocksDB store, which the session has to name (`with_state_store`). Rows of a key come as an iterator
of Arrow batches and are folded one by one, so a key may hold any share of a batch: memory is what the state keeps.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: How long a stored prompt can be read.
PROMPT_TTL = "30 minutes"
#: Rows that are added to a state's list in one call.
_PART = 10_000


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state of this kind needs the RocksDB store."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Latest(StatefulProcessor):
    """The last `keep` rows of a key by `order`, and how many have come."""

    def __init__(self, key: str, schema: T.StructType, order: list[str], keep: int):
        self.key, self.schema, self.order, self.keep = key, schema, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value, read and written once a batch: every call takes a way to the store.
        self.last = handle.getValueState("last", T.StructType([T.StructField("n", T.LongType()), T.StructField("rows", T.ArrayType(self.schema))]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.schema.names
        at = [names.index(c) for c in self.order]
        n, last = self.last.get() or (0, [])
        heap = [(tuple(r[i] for i in at), tuple(r)) for r in last]
        heapq.heapify(heap)
        for row in rows:
            n += 1
            values = tuple(row[c] for c in names)
            entry = (tuple(values[i] for i in at), values)
            if len(heap) < self.keep:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
        kept = [values for _, values in sorted(heap)]
        self.last.update((n, kept))
        made = Row(self.key, "seen", *names)
        for values in kept:
            yield made(*key, n, *values)

    def close(self) -> None:
        pass


def latest(rows: DataFrame, key: str, order: list[str], fields: list[str], keep: int) -> DataFrame:
    """key, seen, order, fields: after every batch, the last `keep` rows of each key that it has touched; `seen` counts all
    rows of the key so far, so the rows with the highest `seen` of a key are its history. Order columns are not null."""
    names = [*order, *[f for f in fields if f not in order]]
    times = {c: rows.schema[c].dataType for c in names if isinstance(rows.schema[c].dataType, T.TimestampType)}
    # State gives times back without their zone, so they are kept as numbers.
    plain = rows.select(key, *[F.unix_micros(c).alias(c) if c in times else F.col(c) for c in names])
    state = T.StructType([plain.schema[c] for c in names])
    out = T.StructType([rows.schema[key], T.StructField("seen", T.LongType()), *state.fields])
    with_state_store(rows.sparkSession)
    kept = plain.groupBy(key).transformWithState(_Latest(key, state, order, keep), out, "Append", "None")
    return kept.select(key, "seen", *[F.timestamp_micros(c).alias(c) if c in times else F.col(c) for c in names])


def history(snapshots: DataFrame, key: str) -> DataFrame:
    """The last snapshot of each key out of what `latest` has given."""
    top = snapshots.groupBy(key).agg(F.max("seen").alias("seen"))
    return snapshots.join(top, [key, "seen"], "left_semi")


class _PromptsByEventTime(StatefulProcessor):
    """Reads are answered when the watermark has passed them: then all that was stored before has come, in whatever order.

    Every call to the state takes a way to the store, so a key's rows of a batch are added as one list, with one timer for
    their first read and one for the end of the last stored value's life; a timer answers all reads that are due.
    """

    def __init__(self, key: str, ttl_ms: int):
        self.made, self.ttl = Row(key, "id", "value"), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at bigint, id bigint, value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        part, first, last = [], None, None
        for row in rows:
            at, value = row["at"], row["value"]
            part.append((at, row["id"], value))
            if value is None:
                first = at if first is None else min(first, at)
            else:
                last = at if last is None else max(last, at)
            if len(part) == _PART:
                self.held.appendList(part)
                part = []
        if part:
            self.held.appendList(part)
        if first is not None:
            self.handle.registerTimer(first)
        if last is not None:
            self.handle.registerTimer(last + self.ttl)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All reads up to the watermark are answered; later ones stay, and what is stored as long as a later read may find it."""
        upto = timerValues.getCurrentWatermarkInMs()
        due, later, stored = array("q"), array("q"), []  # reads by twos: time, id
        for at, id_, value in self.held.get():
            if value is not None:
                stored.append((at, id_, value))
            else:
                (due if at <= upto else later).extend((at, id_))
        stored.sort(key=lambda x: x[:2])
        times = [x[0] for x in stored]
        for at, id_ in zip(due[::2], due[1::2]):
            n = bisect_right(times, at)
            yield self.made(*key, id_, stored[n - 1][2] if n and times[n - 1] > at - self.ttl else None)
        alive = stored[bisect_right(times, upto - self.ttl):]
        if due or len(alive) < len(stored):
            self.held.clear()
            rest = chain(alive, ((at, id_, None) for at, id_ in zip(later[::2], later[1::2])))
            while part := list(islice(rest, _PART)):
                self.held.appendList(part)
            if later:
                self.handle.registerTimer(min(later[::2]))

    def close(self) -> None:
        pass


class _PromptsByClock(StatefulProcessor):
    """Reads are answered at once; a stored value is forgotten `ttl` after it came."""

    def __init__(self, key: str, ttl_ms: int):
        self.made, self.ttl = Row(key, "id", "value"), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "at bigint, id bigint, value string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = tuple(self.stored.get()) if self.stored.exists() else None
        changed, reads = False, []
        for row in rows:  # of what comes together, stores go before reads
            if row["value"] is None:
                reads.append(row["id"])
            elif last is None or (row["at"], row["id"]) > last[:2]:
                last, changed = (row["at"], row["id"], row["value"]), True
        if changed:
            self.stored.update(last)
        for id_ in reads:
            yield self.made(*key, id_, last[2] if last else None)

    def close(self) -> None:
        pass


def _ms(interval: str) -> int:
    import pandas as pd

    return int(pd.Timedelta(interval).total_seconds() * 1000)


def prompt_states(requests: DataFrame, ttl: str = PROMPT_TTL, late: str | None = "1 day", key: str = "prompt_id") -> DataFrame:
    """key, id, value: for every read the prompt state that was stored last under its key, null once it has expired.

    requests: key, id, ts, value (null: a read). With `late`, time is the rows' own: a read finds what was stored at or
    before its time, in milliseconds, and less than `ttl` ago, whatever the order and the batches rows come in; it is
    answered when the watermark has passed it. Without, time is the clock's: a read is answered at once.
    """
    with_state_store(requests.sparkSession)
    out = T.StructType([requests.schema[key], T.StructField("id", T.LongType()), T.StructField("value", T.StringType())])
    rows = requests.select(key, "id", "ts", F.unix_millis("ts").alias("at"), "value")
    if late is None:
        return rows.groupBy(key).transformWithState(_PromptsByClock(key, _ms(ttl)), out, "Append", "ProcessingTime")
    return rows.withWatermark("ts", late).groupBy(key).transformWithState(_PromptsByEventTime(key, _ms(ttl)), out, "Append", "EventTime")
