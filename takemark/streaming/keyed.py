"""The keyed decisions of a site (rate limits, cached lookups, form steps) over streams.

The decisions are those of ``operators.site`` and ``operators.forms``; here a key's state lives in the state store, so that
a query continues where it stopped, on other executors or after a restart. Two clocks:

event time       a timer at the end of a state's life removes it once the watermark is past it; replays give the rows of the batch form
processing time  the state store drops a state when its time to live is over, counted from its last change

Rows of one micro-batch are decided in order of time and ``order``; micro-batches have to come in order of time per key, and
rows later than the watermark are left out by Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from takemark.operators.site import Decision
from takemark.storage import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Walk(StatefulProcessor):
    """Applies a decision along each key. The last entry of a state is when it ends."""

    def __init__(self, name: str, decide: Decision, state: str, columns: list[str], given: list[str], order: str, ttl_seconds: float | None):
        self.name, self.decide, self.kind, self.columns, self.given, self.order, self.ttl = name, decide, state, columns, given, order, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.kind, None if self.ttl is None else int(self.ttl * 1000))

    def _state(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else ()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = state = self._state()
        for r in sorted(rows, key=lambda r: (r["_t"], r[self.order])):
            value, state = self.decide(state, r["_t"], *(r[c] for c in self.given))
            yield Row(**{c: r[c] for c in self.columns}, **{self.name: value})
        if state == before:
            return
        self.state.update(state)
        if self.ttl is None:
            if before:
                self.handle.deleteTimer(_millis(before[-1]))
            self.handle.registerTimer(_millis(state[-1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A later change has another timer and took this one back.
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _millis(seconds: float) -> int:
    return int(seconds * 1000) + 1


def walked(events: DataFrame, key: str, at: str, order: str, name: str, kind: str, decide: Decision, state: str, given: dict[str, Column] | None = None, delay: str = "0 seconds", ttl_seconds: float | None = None) -> DataFrame:
    """The stream events with a column name, of type kind, as ``operators.site.walked`` has it; null keys are the caller's.

    state: DDL of the decision's state. delay: how late the watermark follows. With ttl_seconds the states end by processing time.
    """
    given = given or {}
    columns = events.columns
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000.0
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay) if ttl_seconds is None else rows
    rows = rows.select("*", seconds.alias("_t"), *(c.alias(f"_{n}") for n, c in given.items()))
    walk = Walk(name, decide, state, columns, [f"_{n}" for n in given], order, ttl_seconds)
    out = StructType([*events.schema.fields]).add(name, kind)
    return rows.groupBy(key).transformWithState(walk, out, "Append", "EventTime" if ttl_seconds is None else "ProcessingTime")


#: State of each decision.
LIMIT_STATE = "n long, until double"
CACHE_STATE = "until double"
FORM_STATE = "shown double, confirmed boolean, sent boolean, n long, until double, ends double"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, as this kind of state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def appended(stream: DataFrame, path: str, checkpoint: str, live: bool = False) -> StreamingQuery:
    """Starts a query that appends the stream to Parquet files at path; unless live, it ends when it has caught up with its source.

    States that end by processing time need a live query: one of those always has something to wait for.
    """
    with state_store(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer if live else writer.trigger(availableNow=True)).start()


def replayed(events: DataFrame, at: str, cuts: list, follow, label: str) -> DataFrame:
    """What the stream transformation follow makes of a table that arrives in parts, cut at the times cuts, with a restart after each.

    Each part is a file of the source; the query runs until it has caught up, stops, and is started anew from its checkpoint.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    when = F.col(at)
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = events.where((F.lit(True) if lo is None else when >= F.lit(lo)) & (F.lit(True) if hi is None else when < F.lit(hi)))
        part.write.mode("append").parquet(f"{base}/source")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/source")
        appended(follow(source), f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/sink")
