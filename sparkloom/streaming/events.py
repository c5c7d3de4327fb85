"""Streams: windows over events, running token accounts, incremental builds. Windows are an extension; accounts and builds are the streaming form of batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.ops import manifest_diff

STORE = "spark.sql.streaming.stateStore.providerClass"


def windowed(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n); on a stream events up to ``late`` behind are counted."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(session_window, user_id, n)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


class _Account(StatefulProcessor):
    """Counters of one agent in order of event time, whatever the order they arrive in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "last bigint, total bigint")
        # Rows that the watermark has not passed: an earlier one may still come.
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, counter bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of Spark's interface
        for b in rows:
            for at, i, counter in zip(b["at"].tolist(), b["id"].tolist(), b["counter"].tolist()):
                self.waiting.appendValue((at, i, counter))
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] <= until]
        if not ready:  # an earlier timer of this batch has taken them
            return iter(())
        last, total = self.done.get() if self.done.exists() else (0, 0)
        for _, _, counter in ready:
            total += max(0, counter - last)
            last = counter
        self.done.update((last, total))
        self.waiting.clear()
        if len(rows) > len(ready):
            self.waiting.put(rows[len(ready) :])
        return iter([pd.DataFrame({"agent": [key[0]], "tokens": [total]})])

    def close(self) -> None:
        pass


def running_tokens(usage: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(agent, tokens) as the watermark passes counters (agent, ts, id, counter) of a stream: rises are summed in order of ts and id, a fall starts anew.

    Rows wait in state until no earlier one can come, so the accounts are those of ``ops.token_usage`` over all
    rows that are at most ``late`` behind, in whatever order they arrive; later ones are left out. State is one pair of numbers an
    agent and what arrived within ``late``. Needs the RocksDB state store, which is set where another is not.
    """
    conf = usage.sparkSession.conf
    if "RocksDB" not in conf.get(STORE, ""):
        conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = usage.schema["agent"].dataType.simpleString()
    rows = usage.withWatermark("ts", late).select("agent", "ts", F.unix_millis("ts").alias("at"), F.col("id").cast("long").alias("id"), F.col("counter").cast("long").alias("counter"))
    return rows.groupBy("agent").transformWithStateInPandas(_Account(), f"agent {kind}, tokens bigint", "update", "eventTime")


def changed_only(current: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of documents (path, content_hash, ...) those added or modified since the manifest, and the paths that are gone: what an incremental build has to do."""
    state = manifest_diff(manifest, current)
    todo = current.join(state.filter("state in ('added', 'modified')").select("path"), "path", "left_semi")
    return todo, state.filter("state = 'deleted'").select("path")


def build_stream(documents: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls build(batch, epoch) for each batch of new documents of a file stream; epochs that come again after a failure must overwrite."""
    return documents.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
