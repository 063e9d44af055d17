"""Connections assembled from captured events: in batch by windows, in streams by state a connection.

Events: conn_id, ts (timestamp), ord, kind (open, write, read, close), size, payload (text of the fragment), tls (whether the fragment
was taken from an encrypted stream; may be left out). A connection with a request is https if any of its writes and reads is tls, else
http; one without is tcp. An open starts a connection and
drops one that was open; a write starts one where none is open; a second request in a connection ends it and starts the
next; reads and closes without a connection are dropped; a close only stamps the end. What is open at the end counts.

A connection's events are ordered in one task, in both forms; a conn_id names one socket, so their number is bounded by what
one socket carries.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.keys import probed_host
from ..functions.wire import http_request, http_response

FIELDS = "conn_id long, started timestamp, ended timestamp, protocol string, method string, path string, host string, status int, bytes_sent long, bytes_received long, events long"


def mapped_file_ops(events: DataFrame) -> DataFrame:
    """Events of files as operations: an open counts as a read; closes and empty paths are dropped."""
    kept = events.where((F.coalesce("path", F.lit("")) != "") & F.col("kind").isin("open", "read", "write", "create"))
    return kept.withColumn("kind", F.when(F.col("kind") == "open", "read").otherwise(F.col("kind")))


def with_late_files(operations: DataFrame, found: DataFrame) -> DataFrame:
    """operations and a write by `post-trace-scan` for each file found after the trace."""
    late = found.withColumns({"kind": F.lit("write"), "process": F.lit("post-trace-scan")})
    return operations.unionByName(late, allowMissingColumns=True)


def without_tracer(events: DataFrame, pid: int | Column) -> DataFrame:
    return events.where(~F.col("pid").eqNullSafe(F.lit(pid) if isinstance(pid, int) else pid))


def file_summary(operations: DataFrame) -> DataFrame:
    """One row: operations, distinct paths, and counts by kind as text sorted by kind."""
    kinds = operations.groupBy("kind").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("by_kind"))
    return operations.agg(F.count("*").alias("total"), F.count_distinct("path").alias("unique_paths")).join(F.broadcast(kinds))


def trace_integrity(drops: DataFrame) -> DataFrame:
    """One row of loss counters over drops (counter, n); loss is whether any isn't zero."""
    sums = [F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("ring_overflows", "attach_failures", "events_dropped")]
    return drops.agg(*sums).withColumn("loss", F.greatest("ring_overflows", "attach_failures", "events_dropped") > 0)


def process_tree(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """pid, level of the roots and all processes below them (pid, ppid)."""
    from ..operators.graph import closure

    return closure(processes.select(F.col("ppid").alias("src"), F.col("pid").alias("dst")), roots.select(F.col("pid").alias("node"))).select(F.col("node").alias("pid"), "level")


def parsed(events: DataFrame) -> DataFrame:
    """events with request and response of writes and reads, and the host that a payload names."""
    return events.withColumns({
        "request": F.when(F.col("kind") == "write", http_request(F.col("payload"))), "response": F.when(F.col("kind") == "read", http_response(F.col("payload"))),
        "probed": F.when(F.col("kind").isin("write", "read"), probed_host(F.col("payload"))),
        "tls": F.col("kind").isin("write", "read") & F.coalesce(F.col("tls") if "tls" in events.columns else F.lit(False), F.lit(False)),
    })


def assembled(events: DataFrame) -> DataFrame:
    """FIELDS of every connection of a bounded table of events."""
    by = Window.partitionBy("conn_id").orderBy("ts", "ord")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parsed(events)
    rows = rows.withColumn("epoch", F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(so_far))
    inside = Window.partitionBy("conn_id", "epoch").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"nth": F.greatest(F.count("request").over(inside), F.lit(1)), "begun": (F.col("epoch") > 0) | (F.count(F.when(F.col("kind") == "write", 1)).over(inside) > 0)}).where("begun")
    rows = rows.withColumns({"last_nth": F.max("nth").over(Window.partitionBy("conn_id", "epoch")), "last_epoch": F.max("epoch").over(Window.partitionBy("conn_id"))})
    # an open drops the connection that was open before it
    rows = rows.where((F.col("epoch") == F.col("last_epoch")) | (F.col("nth") < F.col("last_nth")))
    at = F.struct("ts", "ord")
    first = lambda x, when: F.min_by(x, F.when(when, at))
    host = F.when(F.col("kind") == "write", F.coalesce("own_host", "probed")).when(F.col("kind") == "read", F.col("probed"))
    # the first request's host holds for all writes after it
    whole = Window.partitionBy("conn_id", "epoch", "nth").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("own_host", F.first("request.host", ignorenulls=True).over(whole)).withColumn("named", host)
    out = rows.groupBy("conn_id", "epoch", "nth").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max(F.when(F.col("request").isNotNull(), 1)).alias("has_request"), first(F.col("request.method"), F.col("request").isNotNull()).alias("method"),
        first(F.col("request.path"), F.col("request").isNotNull()).alias("path"), first(F.col("named"), F.col("named").isNotNull()).alias("host"), first(F.col("response.status"), F.col("response").isNotNull()).alias("status"),
        F.coalesce(F.sum(F.when(F.col("kind") == "write", F.col("size"))), F.lit(0)).alias("bytes_sent"), F.coalesce(F.sum(F.when(F.col("kind") == "read", F.col("size"))), F.lit(0)).alias("bytes_received"), F.count("*").alias("events"), F.bool_or("tls").alias("tls"),
    )
    return out.withColumn("protocol", F.when(F.col("has_request").isNull(), "tcp").when(F.col("tls"), "https").otherwise("http")).select(*(f.split()[0] for f in FIELDS.split(", ")))


#: A connection that is open, times in microseconds, and an event as it is held until the watermark has passed it.
_NOW = ("started", "ended", "method", "path", "own_host", "host", "status", "sent", "received", "events", "asked", "tls")
_NAMES = ("us", "ord", "kind", "size", "has_request", "method", "path", "own_host", "probed", "status", "tls")


class Assembler(StatefulProcessor):
    """One connection's events in order of ts and ord, whatever the batches in which they came: an event is held until the watermark
    has passed it. A gap of more than idle_ms ends a connection.

    What is kept of a key is one value: the open connection by _NOW and the events held by _NAMES, as JSON, and the time of its timer (0:
    none), so that a batch reads and writes it once. Each call to the state goes from the worker to the JVM and back.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "now string, held string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs(), [[r[n] for n in _NAMES] for r in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs(), [])

    def close(self) -> None:
        pass

    def advance(self, key, watermark: int, more: list[list]) -> Iterator[Row]:
        """Takes the held events that the watermark has passed, and sets the time at which to look again."""
        now, held, timer = self.kept.get() or ("null", "[]", 0)
        state, held = json.loads(now), sorted([*json.loads(held), *more], key=lambda e: e[:2])
        ready = sum(e[0] // 1000 <= watermark for e in held)
        for e in held[:ready]:
            if state and e[0] - state[1] > self.idle_ms * 1000:
                yield finished(key, state)
                state = None
            done, state = following(state, dict(zip(_NAMES, e, strict=True)))
            if done:
                yield finished(key, done)
        if state and state[1] // 1000 + self.idle_ms < watermark:
            yield finished(key, state)
            state = None
        look = max(held[ready][0] // 1000 + 1, watermark + 1) if ready < len(held) else max(state[1] // 1000 + self.idle_ms + 1, watermark + 1) if state else 0
        # a timer that comes earlier stays: it sets the next when it has come
        if look and not watermark < timer <= look:
            if timer > watermark:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(look)
            timer = look
        elif not look and timer > watermark:
            self.handle.deleteTimer(timer)
        if look:
            self.kept.update((json.dumps(state), json.dumps(held[ready:]), timer))
        else:
            self.kept.clear()


def following(state: tuple | None, e: dict) -> tuple[tuple | None, tuple | None]:
    """(a connection that the event ends, the state after the event)."""
    new = (e["us"], e["us"], None, None, None, None, None, 0, 0, 0, False, False)
    done = None
    if e["kind"] == "open":
        state = new
    elif e["kind"] == "write":
        if state and state[10] and e["has_request"]:
            done, state = state, None
        state = state or new
    elif state is None:
        return None, None
    started, _, method, path, own_host, host, status, sent, received, events, asked, tls = state
    if e["kind"] == "write":
        if e["has_request"]:
            method, path, own_host, asked = e["method"], e["path"], e["own_host"], True
        host, sent = host or own_host or e["probed"], sent + e["size"]
    elif e["kind"] == "read":
        host, received = host or e["probed"], received + e["size"]
        status = e["status"] if status is None else status
    return done, (started, e["us"], method, path, own_host, host, status, sent, received, events + 1, asked, tls or e["tls"])


def finished(key, s: tuple) -> Row:
    started, ended, method, path, _, host, status, sent, received, events, asked, tls = s
    return Row(conn_id=key[0], started=started, ended=ended, protocol=("https" if tls else "http") if asked else "tcp", method=method, path=path, host=host, status=status, bytes_sent=sent, bytes_received=received, events=events)


def assembled_stream(events: DataFrame, *, idle: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """FIELDS of connections of a stream of events: a connection is given out when a second request ends it or when no event of
    it came for `idle` of event time. Events may come out of order, across batches too, by up to `late`; those that are later are
    dropped, which Losses counts.

    The time limit is what bounds the state; a bounded trace has none, so that the last connections there come out only
    as later events move the watermark past them. The session's streams keep their state in RocksDB from here on.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = parsed(events).withWatermark("ts", late).select(
        "conn_id", "ts", F.unix_micros("ts").alias("us"), "ord", "kind", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("request").isNotNull().alias("has_request"), F.col("request.method").alias("method"), F.col("request.path").alias("path"),
        F.col("request.host").alias("own_host"), "probed", F.col("response.status").alias("status"), "tls",
    )
    out = rows.groupBy("conn_id").transformWithState(Assembler(idle_ms), FIELDS.replace("timestamp", "long"), "append", "eventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


class Losses(StreamingQueryListener):
    """What streams read and dropped as late, counted as their batches end; what is observed under `name` is added up as well."""

    def __init__(self, name: str = "events") -> None:
        self.name, self.rows, self.late, self.batches, self.seen = name, 0, 0, 0, {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.late += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        for k, v in (p.observedMetrics[self.name].asDict() if self.name in p.observedMetrics else {}).items():
            self.seen[k] = self.seen.get(k, 0) + (v or 0)

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))


def drained(stream: DataFrame, sink: str, checkpoint: str, losses: Losses | None = None) -> Losses:
    """Runs a stream over all that its source has now, in its bounded batches, into Parquet at sink; what was lost on the way."""
    losses, spark = losses or Losses(), stream.sparkSession
    spark.streams.addListener(losses)
    try:
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        until = time.time() + 30
        while str(q.runId) not in losses.ended and time.time() < until:  # the listener hears of it a little later
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(losses)
    return losses
