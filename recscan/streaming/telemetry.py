"""Live capture telemetry as Structured Streaming: sessions, stalls, rates, pending files."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recscan.sources.recording import open_uri
from recscan.sources.tables import read_jsonl
from recscan.sources.workspace import append_batch, sink_id


def split_sessions(stream: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", by: str = "device") -> DataFrame:
    """(by, start, end, frames, bytes): a new session after a gap of more than ``gap``."""
    w = F.session_window("ts", gap)
    found = stream.withWatermark("ts", late).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.sum("bytes").alias("bytes"), F.max("ts").alias("last"))
    return found.select(by, F.col("w.start").alias("start"), F.col("last").alias("end"), "frames", "bytes")


def _counters(frames: DataFrame) -> list[Column]:
    """captured, written, dropped and bytes of a group of frames."""
    stored = F.col("written") if "written" in frames.columns else F.lit(True)
    lost = F.col("dropped") if "dropped" in frames.columns else F.lit(0)
    return [
        F.count(F.lit(1)).alias("captured"), F.count(F.when(stored, 1)).alias("written"), F.coalesce(F.sum(lost), F.lit(0)).alias("dropped"),
        F.coalesce(F.sum(F.when(stored, F.col("bytes"))), F.lit(0)).alias("bytes"),
    ]


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _per_second(found: DataFrame, seconds: Column) -> DataFrame:
    rate = lambda c: F.when(seconds > 0, F.col(c) / seconds).otherwise(0.0)
    return found.withColumns({"capture_fps": rate("captured"), "write_fps": rate("written")})


def capture_rates(frames: DataFrame, every: str = "1 second", late: str = "10 seconds", by: str = "device") -> DataFrame:
    """(by, start, captured, written, dropped, bytes, capture_fps, write_fps) of each tumbling window.

    ``frames``, a stream or a table: by, ts, bytes and, where they are known, written (whether the frame
    was) and dropped (how many were lost before it); without, all are written and none is lost.
    """
    rows = frames.withWatermark("ts", late) if frames.isStreaming else frames
    found = rows.groupBy(by, F.window("ts", every).alias("w")).agg(*_counters(frames))
    length = (_micros(F.col("w.end")) - _micros(F.col("w.start"))) / 1e6
    return _per_second(found, length).select(by, F.col("w.start").alias("start"), "captured", "written", "dropped", "bytes", "capture_fps", "write_fps")


def recording_rates(frames: DataFrame, by: list[str]) -> DataFrame:
    """The counters of each recording from zero, its seconds from the first frame to the last, and rates."""
    length = ((_micros(F.max("ts")) - _micros(F.min("ts"))) / 1e6).alias("seconds")
    return _per_second(frames.groupBy(*by).agg(*_counters(frames), length), F.col("seconds"))


def stalls(stream: DataFrame, after_ms: int = 1000, late: str = "10 seconds", by: str = "device") -> DataFrame:
    """(by, last_ts, stalled_at): a device was silent for more than ``after_ms`` of event time.

    State is the last time of each device, and a timer ``after_ms`` behind it. A gap between two
    frames of a batch is reported at once, an open one when the watermark passes the timer.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[Any, pd.Timestamp, pd.Timestamp]] = []
        wait = pd.Timedelta(milliseconds=after_ms)
        if state.hasTimedOut:
            (last,) = state.get
            at = pd.Timestamp(last, unit="us")
            out.append((key[0], at, at + wait))
            state.remove()
        else:
            times = sorted(t for b in batches for t in b["ts"])
            last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
            for t in times:
                if last is not None and t - last > wait:
                    out.append((key[0], last, last + wait))
                last = t if last is None else max(last, t)
            if last is not None:
                state.update((int(last.value // 1000),))
                deadline = int(last.value // 1_000_000) + after_ms + 1
                if deadline > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(deadline)
                else:
                    out.append((key[0], last, last + wait))
                    state.remove()
        yield pd.DataFrame(out, columns=[by, "last_ts", "stalled_at"])

    kind = stream.schema[by].dataType.simpleString()
    return stream.withWatermark("ts", late).groupBy(by).applyInPandasWithState(watch, f"{by} {kind}, last_ts timestamp, stalled_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def pending_stream(listing: DataFrame, settle: str = "10 seconds", min_bytes: int = 1024, late: str = "0 seconds", forget: str = "1 day") -> DataFrame:
    """(key, size_bytes, mtime): each file once, when it has not changed for ``settle``.

    ``listing`` is a stream of listings: key, size_bytes, mtime and listed, the time of the listing. A file
    that is old enough in a listing is given at once, a younger one when the time of the listings
    passes its age, unless one of them shows that it has changed. Pruned and tiny files are left
    out. A file that was given is remembered, so that it is not repeated, for ``forget`` after the last listing that shows it:
    state is the open files, and those given that are still listed.
    """
    wait, keep = pd.Timedelta(settle), int(pd.Timedelta(forget).total_seconds() * 1000)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, changed, given = state.getOption or (0, 0, False)
        if state.hasTimedOut and given:
            state.remove()
            return
        ready = state.hasTimedOut
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("listed")
            newest = rows.iloc[-1]
            size, changed = int(newest["size_bytes"]), int(newest["mtime"].value // 1000)
            ready = not given and newest["listed"] - newest["mtime"] >= wait
        state.update((size, changed, bool(given or ready)))
        now = state.getCurrentWatermarkMs()
        if not given and not ready:
            due = changed // 1000 + int(wait.total_seconds() * 1000)
        else:
            due = (now if state.hasTimedOut else int(newest["listed"].value // 1_000_000)) + keep
        state.setTimeoutTimestamp(max(due, now + 1))
        yield pd.DataFrame([(key[0], size, pd.Timestamp(changed, unit="us"))] if ready else [], columns=["key", "size_bytes", "mtime"])

    ok = ~F.array_contains(F.split("key", "/"), ".pruned") & (F.col("size_bytes") >= min_bytes)
    rows = listing.filter(ok).withWatermark("listed", late).groupBy("key")
    return rows.applyInPandasWithState(watch, "key string, size_bytes long, mtime timestamp", "size long, changed long, given boolean", "append", GroupStateTimeout.EventTimeTimeout)


def append_results(stream: DataFrame, path: str, checkpoint: str):
    """A started query that adds each batch of results to JSON lines as it comes; readers bring them in order.

    The files of a batch bear its number and the name of this output, so that a batch that is run again replaces its own.
    """
    name = sink_id(stream.sparkSession, checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, f"{name}-{number:010d}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- uploads ------------------------------------------------------------------------------


class _Progress(StatefulProcessor):
    """Rates of an upload, from the first and the last report of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("progress", "first double, at double, bytes long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, at, sent = self.held.get() or (None, None, None)
        out = []
        for ts, done, total in sorted(pd.concat(list(rows))[["ts_s", "bytes", "total"]].itertuples(index=False, name=None), key=lambda r: r[:2]):
            first = ts if first is None else first
            rate = (done - sent) / (ts - at) if at is not None and ts > at else 0.0
            average = done / (ts - first) if ts > first else 0.0
            known = total is not None and not pd.isna(total)
            out.append((key[0], ts, int(done), rate, average, (done / total * 100 if total > 0 else 0.0) if known else None, ((total - done) / average if average > 0 else 0.0) if known else None))
            if at is None or ts >= at:
                at, sent = ts, int(done)
        self.held.update((first, at, sent))
        self.handle.registerTimer(int(at * 1000) + 1)
        yield pd.DataFrame(out, columns=["id", "ts_s", "bytes", "rate", "average_rate", "percent", "eta_s"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        if held and int(held[1] * 1000) + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def upload_progress(stream: DataFrame, forget: str = "1 day") -> DataFrame:
    """(id, ts_s, bytes, rate, average_rate, percent, eta_s) of a stream of reports: id, ts_s, bytes so far, total (may be null).

    What ``recscan.operators.catalog.upload_rates`` gives of the same reports. State is three numbers an upload, and ends
    when it has had no report for ``forget``, by the times of all reports; a report that is later than that is left out. One that
    comes in a later batch than a newer one has rate 0 and changes nothing.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seconds = F.col("ts_s").cast("double")
    rows = stream.select("id", seconds.alias("ts_s"), F.col("bytes").cast("long").alias("bytes"), F.col("total").cast("double").alias("total"), seconds.cast("timestamp").alias("_at"))
    kind = stream.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ts_s double, bytes long, rate double, average_rate double, percent double, eta_s double"
    return rows.withWatermark("_at", forget).groupBy("id").transformWithStateInPandas(_Progress(), schema, "Append", "EventTime")


# ---- a folder that is listed again and again ----------------------------------------------


@dataclass
class _Folder(InputPartition):
    """A folder to list, with all below it or its own files only, at a time."""

    uri: str
    deep: bool
    listed_us: int


class ListingReader(DataSourceStreamReader):
    """Each batch is one listing; its offset is the time of it."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"listed_us": 0}

    def latestOffset(self) -> dict:
        return {"listed_us": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[_Folder]:
        """The folder's own files, and each folder in it with all below: tasks list them."""
        system, base = open_uri(self.path)
        prefix = self.path[: len(self.path) - len(base)]
        folders = [f.path for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.Directory]
        return [_Folder(self.path, False, end["listed_us"]), *(_Folder(prefix + f, True, end["listed_us"]) for f in sorted(folders))]

    def read(self, part: _Folder) -> Iterator[tuple]:
        system, base = open_uri(part.uri)
        prefix, at = part.uri[: len(part.uri) - len(base)], datetime.fromtimestamp(part.listed_us / 1e6, UTC)
        for f in system.get_file_info(fs.FileSelector(base, recursive=part.deep, allow_not_found=True)):
            if f.type == fs.FileType.File:
                yield prefix + f.path, f.size, f.mtime, at


class ListingSource(DataSource):
    """Streaming source ``listing``: key, size_bytes, mtime and listed of all files below a path, once for each batch."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "key string, size_bytes long, mtime timestamp, listed timestamp"

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def settled_files(listing: DataFrame, log: str, checkpoint: str, settle: str = "10 seconds", min_bytes: int = 1024, trigger: dict | None = None):
    """A started query over whole listings that logs each file once, when it has not changed for ``settle``: key, size_bytes, mtime.

    Of each listing the files that are old enough, not pruned and not tiny are held against the log, and the new ones added to it in
    files that bear the batch's number; so a restart, or a batch that is run again, gives none twice. Nothing is kept but
    the log: a file that is still young is in the next listing again. ``listing`` is of source ``listing``, or alike.
    """
    spark = listing.sparkSession
    name = sink_id(spark, checkpoint)
    ok = ~F.array_contains(F.split("key", "/"), ".pruned") & (F.col("size_bytes") >= min_bytes) & (F.col("mtime") <= F.col("listed") - F.expr(f"INTERVAL {settle}"))

    def add(batch: DataFrame, number: int) -> None:
        mine = f"batch-{name}-{number:010d}"
        given = read_jsonl(spark, log, "key string").filter(~F.contains(F.input_file_name(), F.lit(mine))).select("key")
        new = batch.filter(ok).groupBy("key").agg(F.max_by("size_bytes", "listed").alias("size_bytes"), F.max("mtime").alias("mtime")).join(given, "key", "left_anti")
        append_batch(new, log, mine.removeprefix("batch-"))

    return listing.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
