"""What counts as having looked at an image: the same columns for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

c = F.col
LATE = "10 minutes"
#: After so long without an event of a reader the open segment ends.
QUIET_MS = 600_000


def rejection(min_dwell: float = 400.0, min_scale: float = 1.0, need_focus: bool = True) -> Column:
    """Why an event attests nothing, by the first rule that it breaks; null if it attests."""
    out = F.when((c("source") == "page") & c("page_path").isNull(), "no page path").when((c("source") != "page") & (F.coalesce(c("sop_uid"), F.lit("")) == ""), "no slice")
    out = out.when(c("dwell_ms") < min_dwell, "dwell too short").when(c("scale") < min_scale, "magnification too low")
    return out.when(~(c("focused") & c("visible")), "not focused and visible") if need_focus else out


def accepted(events: DataFrame) -> DataFrame:
    return events.where(rejection().isNull())


def attest_stream(events: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Appends accepted events and, aside, rejected ones with their reason. A batch that is replayed overwrites what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("rejection", rejection()).persist()
        rows.where("rejection is null").drop("rejection").write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
        rows.where("rejection is not null").write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        rows.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dwell_segments(events: DataFrame, gap_ms: float | None = None) -> DataFrame:
    """Consecutive events of a reader with the same image are a segment; a change of image or a loss of focus ends it. Its scale is the least."""
    w = Window.partitionBy("reader").orderBy("ts", "event_id")
    starts = (c("sop_uid") != F.lag("sop_uid").over(w)) | ~F.lag("focused").over(w)
    rows = events.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("segment", F.sum("starts").over(w))
    return rows.groupBy("reader", "segment").agg(F.first("sop_uid").alias("sop_uid"), F.count("*").alias("n"), F.sum("dwell_ms").alias("dwell_ms"), F.min("scale").alias("scale"), F.min("ts").alias("began"))


class Segments(StatefulProcessor):
    """The stream's form of dwell_segments(): the open segment of a reader is state; it ends when another begins, or after a quiet time.

    An event that is older than the last one of its reader's open segment came too late to say where it belongs, and is left out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sop_uid string, n long, dwell_ms double, scale double, began timestamp, focused boolean, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state, out = (self.open.get() if self.open.exists() else None), []
        for e in events.itertuples():
            if state and int(e.ts.timestamp() * 1000) < state[6]:
                continue
            if state and state[0] == e.sop_uid and state[5]:
                state = (*state[:1], state[1] + 1, state[2] + e.dwell_ms, min(state[3], e.scale), state[4], bool(e.focused), int(e.ts.timestamp() * 1000))
            else:
                if state:
                    out.append((key[0], *state[:5]))
                state = (e.sop_uid, 1, float(e.dwell_ms), float(e.scale), e.ts, bool(e.focused), int(e.ts.timestamp() * 1000))
        self.open.update(state)
        self.handle.registerTimer(state[6] + QUIET_MS)
        yield pd.DataFrame(out, columns=["reader", "sop_uid", "n", "dwell_ms", "scale", "began"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.open.get() if self.open.exists() else None
        if state and state[6] + QUIET_MS > expiredTimerInfo.getExpiryTimeInMs():
            state = None  # a later event has set a later timer
        else:
            self.open.clear()
        yield pd.DataFrame([(key[0], *state[:5])] if state else [], columns=["reader", "sop_uid", "n", "dwell_ms", "scale", "began"])

    def close(self) -> None:
        pass


def segment_stream(events: DataFrame) -> DataFrame:
    """Closed segments of a stream of events; needs the RocksDB state store."""
    rows = events.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", LATE)
    return rows.groupBy("reader").transformWithStateInPandas(Segments(), "reader string, sop_uid string, n long, dwell_ms double, scale double, began timestamp", "Append", "EventTime")


def dedup_reported(events: DataFrame) -> DataFrame:
    """One report for each image of a session: the first on a table, the first within the watermark on a stream."""
    if events.isStreaming:
        return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["session_id", "sop_uid"])
    w = Window.partitionBy("session_id", "sop_uid").orderBy("ts", "event_id")
    return events.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


class Seen(StatefulProcessor):
    """How many different slices of a series were seen: each is an entry of keyed state, in the state store and not in memory, and counts once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen, self.n = handle.getMapState("seen", "sop_uid string", "times long"), handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = n = self.n.get()[0] if self.n.exists() else 0
        for pdf in rows:
            for sop in pdf["sop_uid"].unique():
                if not self.seen.containsKey((sop,)):
                    self.seen.updateValue((sop,), (1,))
                    n += 1
        if n > before:
            self.n.update((n,))
        yield pd.DataFrame({"series_uid": [key[0]], "seen": [n]} if n > before else {"series_uid": [], "seen": []}).astype({"series_uid": object, "seen": "int64"})

    def close(self) -> None:
        pass


def live_coverage(attested: DataFrame, slices: DataFrame) -> DataFrame:
    """(series_uid, seen): slices seen of each series so far, exactly; joins a stream (or a table) with the static slices.

    A stream gives a series' count whenever it grows; the last one, the largest, holds. It needs the RocksDB state store.
    """
    own = accepted(attested).join(slices.select("sop_uid", "series_uid").distinct(), ["sop_uid", "series_uid"])
    if attested.isStreaming:
        return own.select("series_uid", "sop_uid").groupBy("series_uid").transformWithStateInPandas(Seen(), "series_uid string, seen long", "Update", "None")
    return own.groupBy("series_uid").agg(F.count_distinct("sop_uid").alias("seen"))


def display_gate(requests: DataFrame, responses: DataFrame, within: str = "180 seconds") -> DataFrame:
    """(request, status): satisfied, declined, or timed out; an outer interval join, on streams with watermarks on both sides."""
    if requests.isStreaming:
        requests, responses = requests.withWatermark("asked", LATE), responses.withWatermark("answered", LATE)
    rows = requests.join(responses, F.expr(f"request = to_request and answered >= asked and answered <= asked + interval {within}"), "left_outer")
    return rows.select("request", "asked", F.when(c("answered").isNull(), "timed out").when(c("declined"), "declined").otherwise("satisfied").alias("status"))


def reading_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of viewing of each reader, with totals; the same on tables and on streams with a watermark."""
    rows = events.withWatermark("ts", LATE) if events.isStreaming else events
    return rows.groupBy("reader", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("dwell_ms").alias("dwell_ms")).select("reader", c("w.start").alias("began"), c("w.end").alias("ended"), "n", "dwell_ms")


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """New files of a folder of events, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
