"""Structured Streaming forms: change feed, idempotency, job leases, quota ledger, watch mode, windows.

Each stream folds to what the batch operator of the same name gives over all input, so tests run them with an
available-now trigger and compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..state.ledger import EXPIRY_HOURS, TRANSITIONS, idempotent_step

#: How long a month's usage is remembered after its last request: two months.
MONTHS_KEPT_MS = 62 * 24 * 3_600_000


def change_feed(spark: SparkSession, path: str, schema: T.StructType, visible: DataFrame, device_id: int) -> DataFrame:
    """New change rows that the device may see: the file source's offset is the cursor, visibility a static semi side."""
    changes = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
    seen = visible.select("asset_id").distinct().withColumn("seen", F.lit(True))
    rows = changes.join(seen, "asset_id", "left")
    return rows.filter(F.col("asset_id").isNull() | (F.col("device_id") == device_id) | F.coalesce("seen", F.lit(False))).drop("seen")


def replays_dropped(requests: DataFrame, *, delay: str = f"{EXPIRY_HOURS} hours") -> DataFrame:
    """First requests of each key within the watermark's span."""
    return requests.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["user_id", "idempotency_key", "request_sha256"])


def _in_order(rows: Iterator[pd.DataFrame], *order: str) -> Iterator:
    """A key's rows of one batch, from all its frames, in order; a batch's size is the source's to bound."""
    return pd.concat(list(rows)).sort_values(list(order)).itertuples()


class IdempotencyProcessor(StatefulProcessor):
    """Keeps the holder of a key and tells the outcomes apart; a holder older than the expiry is replaced, and with forget its state goes after twice the expiry."""

    def __init__(self, forget: bool):
        self._ttl = 2 * EXPIRY_HOURS * 3_600_000 if forget else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._holder = handle.getValueState("holder", "at timestamp, done timestamp, method string, route string, sha string", ttlDurationMs=self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        plain = lambda t: None if t is None or pd.isna(t) else pd.Timestamp(t).tz_localize(None)
        holder = None
        if self._holder.exists():
            at, done, *own = self._holder.get()
            holder = (plain(at), plain(done), *own)
        out = []
        for row in _in_order(rows, "arrived_at", "seq"):
            row = SimpleNamespace(user_id=key[0], idempotency_key=key[1], seq=row.seq, method=row.method, route=row.route, request_sha256=row.request_sha256, arrived_at=plain(row.arrived_at), answered_at=plain(row.answered_at))
            holder, said = idempotent_step(holder, row)
            out.append(said)
        self._holder.update((holder[0].to_pydatetime(), holder[1] and holder[1].to_pydatetime(), *holder[2:]))
        yield pd.DataFrame(out, columns=["user_id", "idempotency_key", "seq", "outcome"])

    def close(self) -> None:
        pass


def idempotency(requests: DataFrame, *, forget: bool = False) -> DataFrame:
    """Outcome of every request, keyed state in place of stored responses.

    With forget, state that was not touched for twice the expiry goes.  That is measured in processing time, for which Spark starts batches
    for as long as the query runs, so it is for queries that run on, not for available-now triggers.
    """
    return requests.groupBy("user_id", "idempotency_key").transformWithStateInPandas(
        IdempotencyProcessor(forget), "user_id long, idempotency_key string, seq long, outcome string", "Append", "ProcessingTime" if forget else "None",
    )


class JobProcessor(StatefulProcessor):
    """The job state machine: events that are no allowed transition are passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._status = handle.getValueState("status", "status string, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now, events = self._status.get() if self._status.exists() else (None, 0)
        for row in _in_order(rows, "seq"):
            events += 1
            if now is None or row.status in TRANSITIONS.get(now, []):
                now = row.status
        self._status.update((now, events))
        yield pd.DataFrame([(key[0], now, events)], columns=["job_id", "status", "events"])

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job that had events in the batch."""
    return events.groupBy("job_id").transformWithStateInPandas(JobProcessor(), "job_id long, status string, events long", "Update", "None")


class QuotaProcessor(StatefulProcessor):
    """Admits one unit a request until the month's limit; with forget, a month's state goes some time after its last request."""

    def __init__(self, limit: int, forget: bool):
        self._limit, self._ttl = limit, MONTHS_KEPT_MS if forget else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._used = handle.getValueState("used", "used long", ttlDurationMs=self._ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        used = self._used.get()[0] if self._used.exists() else 0
        out = []
        for row in _in_order(rows, "seq"):
            used += (fits := used < self._limit)
            out.append((row.seq, "Admitted" if fits else "DeferredQuota"))
        self._used.update((used,))
        yield pd.DataFrame(out, columns=["seq", "decision"])

    def close(self) -> None:
        pass


def quota(requests: DataFrame, limit: int, *, forget: bool = False) -> DataFrame:
    """Decisions in the order of seq; forget as for `idempotency`."""
    return requests.groupBy("user_id", "provider", "usage_month").transformWithStateInPandas(QuotaProcessor(limit, forget), "seq long, decision string", "Append", "ProcessingTime" if forget else "None")


def windowed(changes: DataFrame, time_col: str, size: str, *keys: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Counts by event-time window; an addition, as the reference processing has no event-time windows."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return changes.withWatermark(time_col, watermark).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(changes: DataFrame, time_col: str, gap: str, *keys: str, watermark: str = "1 hour") -> DataFrame:
    return changes.withWatermark(time_col, watermark).groupBy(F.session_window(time_col, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def watch(spark: SparkSession, root: str, *, pattern: str = "*") -> DataFrame:
    """Files as they appear below a folder, for a writer with a processing-time trigger; contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Feed everything available through ``sink(batch, id)`` and stop; the checkpoint lets a later run go on from there.

    The sink has to be idempotent by batch id, since a batch may come again after a failure.
    """
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def as_of(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
