"""Streams of samples: windows with a watermark, interval joins, deduplication, and keyed state machines.

Event time is the sample's own; the watermark is ten minutes, and later rows are dropped. Streams end when what is
there has been read (availableNow) and land in a Parquet table in the shared folder.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir

WATERMARK = "10 minutes"
#: Rows of a key's micro-batch that are sorted in memory, and those that are read back or sent on at a time.
ROWS_SORTED, ROWS_AT_ONCE = 200_000, 10_000


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The table that the stream leaves when all input has been read."""
    folder = shared_dir(stream.sparkSession, name)
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed(samples: DataFrame, key: str, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, mean and failures per key and window; a window comes out when the watermark has passed it."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = samples.withWatermark("ts", WATERMARK).groupBy(w, key).agg(F.count("*").alias("samples"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("window.start").alias("start"), key, "samples", "mean", "errors")


def sessions(samples: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    out = samples.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("samples"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "samples")


def within(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Pairs of left and right rows of a key where right comes up to `seconds` after left."""
    a = left.select(F.col(key), F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts")).withWatermark("left_ts", WATERMARK)
    b = right.select(F.col(key).alias("_k"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts")).withWatermark("right_ts", WATERMARK)
    on = F.expr(f"{key} = _k AND right_ts >= left_ts AND right_ts <= left_ts + INTERVAL {seconds} SECONDS")
    return a.join(b, on).select(key, "left_id", "right_id")


def first_within_watermark(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(keys)


def in_order(pdfs: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> Iterator[tuple]:
    """Rows (columns) of a key's micro-batch sorted by `order`, missing values last; beyond ROWS_SORTED they wait as sorted
    runs in temporary files and are merged, so a key of any size takes as much memory.
    """
    places = [columns.index(c) for c in order]

    def place(row: tuple) -> list[tuple]:
        return [(1, 0) if row[i] is None or row[i] != row[i] else (0, row[i]) for i in places]

    def rows(run) -> Iterator[tuple]:
        with run:
            while chunk := pickle.load(run):
                yield from chunk

    def saved(held: pd.DataFrame):
        run = tempfile.TemporaryFile()
        for at in range(0, len(held), ROWS_AT_ONCE):
            pickle.dump(list(held.iloc[at : at + ROWS_AT_ONCE].itertuples(index=False, name=None)), run)
        pickle.dump(None, run)
        run.seek(0)
        return run

    runs, held, n = [], [], 0

    def whole() -> pd.DataFrame:
        return (pd.concat(held) if len(held) > 1 else held[0]).sort_values(order)

    for pdf in pdfs:
        held.append(pdf[columns])
        n += len(pdf)
        if n >= ROWS_SORTED:
            runs.append(saved(whole()))
            held, n = [], 0
    last = whole().itertuples(index=False, name=None) if held else iter(())
    yield from heapq.merge(*map(rows, runs), last, key=place) if runs else last


def _in_chunks(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) >= ROWS_AT_ONCE:
            yield pd.DataFrame(chunk, columns=columns)
            chunk = []
    yield pd.DataFrame(chunk, columns=columns)


# Congestion control -------------------------------------------------------------------------------------------------

FSM_STATE = "phase string, window int, threshold int, bandwidth double, last_event double"
FSM_START = ("slow_start", 4, 32, 10.0, 0.0)
FSM_OUT = "link long, sample_id long, phase string, window int, threshold int, bandwidth double"


def congestion_step(state: tuple, at: float, throughput: float, latency_ms: float, error_rate: float) -> tuple:
    """State of a link after a sample.

    Slow start grows the window by half up to the threshold, avoidance by one, recovery by a tenth and back to
    avoidance after a quiet minute; errors over 1 % (2 % in recovery) halve it. Latency over a second then quarters it,
    throughput under half of the allocated bandwidth takes a third; both may happen at one sample.
    """
    phase, window, threshold, bandwidth, last_event = state
    congested = False
    if phase == "recovery":
        if error_rate < 0.005:
            window, bandwidth = int(window * 1.1), bandwidth * 1.02
            if at - last_event > 60:
                phase = "avoidance"
        elif error_rate > 0.02:
            congested = True
    elif error_rate >= 0.01:
        congested = True
    elif phase == "avoidance":
        window, bandwidth = window + 1, bandwidth * 1.05
    else:
        window, bandwidth = int(min(window * 1.5, threshold)), bandwidth * 1.2
        if window >= threshold:
            phase = "avoidance"
    if congested:
        threshold = max(window // 2, 2)
        phase, window, bandwidth, last_event = "recovery", threshold, bandwidth * 0.7, at
    if latency_ms > 1000:
        phase, window, bandwidth = "recovery", max(window // 4, 1), bandwidth * 0.5
    if throughput < bandwidth * 0.5:
        window, bandwidth = max(window * 2 // 3, 1), bandwidth * 0.8
    return phase, window, threshold, bandwidth, last_event


def _runs(pdf: pd.DataFrame, state: tuple, step: Callable[[tuple, float, float, float, float], tuple]) -> tuple[list, tuple]:
    rows = []
    for sample_id, at, bandwidth, latency, loss in zip(pdf["sample_id"], pdf["at"], pdf["bandwidth"], pdf["latency_ms"], pdf["loss"], strict=True):
        state = step(state, at, bandwidth, latency, loss)
        rows.append((int(sample_id), *state[:4]))
    return rows, state


def congestion_stream(samples: DataFrame) -> DataFrame:
    """FSM_OUT for every sample (link, sample_id, at, bandwidth, latency_ms, loss), state kept per link.

    Within a micro-batch a link's samples are taken in order of time, by `in_order`; memory is bound whatever their number.
    """

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            now = state.get if state.exists else FSM_START
            for sample_id, at, bandwidth, latency, loss in in_order(pdfs, ["sample_id", "at", "bandwidth", "latency_ms", "loss"], ["at", "sample_id"]):
                now = congestion_step(now, at, bandwidth, latency, loss)
                yield (key[0], int(sample_id), *now[:4])
            state.update(now)

        yield from _in_chunks(rows(), ["link", "sample_id", "phase", "window", "threshold", "bandwidth"])

    return samples.groupBy("link").applyInPandasWithState(run, FSM_OUT, FSM_STATE, "append", GroupStateTimeout.NoTimeout)


def congestion_batch(samples: DataFrame) -> DataFrame:
    """The same over a table: each link's samples are one sorted stream."""
    ordered = samples.repartition("link").sortWithinPartitions("link", "at", "sample_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, state = None, FSM_START
        for batch in batches:
            rows = []
            for link, part in batch.groupby("link", sort=False):
                if link != of:
                    of, state = link, FSM_START
                found, state = _runs(part, state, congestion_step)
                rows += [(link, *r) for r in found]
            yield pd.DataFrame(rows, columns=["link", "sample_id", "phase", "window", "threshold", "bandwidth"])

    return ordered.mapInPandas(run, FSM_OUT)


# Failover -----------------------------------------------------------------------------------------------------------


def failover_stream(samples: DataFrame, attempts: int = 3) -> DataFrame:
    """Transitions (link, sample_id, event, failures): failover after `attempts` failures in a row, recovered at the next success."""

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            failures, down = state.get if state.exists else (0, False)
            for sample_id, _, success in in_order(pdfs, ["sample_id", "at", "success"], ["at", "sample_id"]):
                failures = 0 if success else failures + 1
                if failures >= attempts and not down:
                    down = True
                    yield key[0], sample_id, "failover", failures
                elif success and down:
                    down = False
                    yield key[0], sample_id, "recovered", 0
            state.update((failures, down))

        yield from _in_chunks(rows(), ["link", "sample_id", "event", "failures"])

    return samples.groupBy("link").applyInPandasWithState(run, "link long, sample_id long, event string, failures int", "failures int, down boolean", "append", GroupStateTimeout.NoTimeout)


# Sticky routing ------------------------------------------------------------------------------------------------------


def sticky_stream(requests: DataFrame, ttl_seconds: float) -> DataFrame:
    """Region of the session that each request (key, at, id, region) falls into. A session lives `ttl_seconds` from its
    first request; when the watermark on ts has passed that, its state is dropped.
    """

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return

        def rows() -> Iterator[tuple]:
            session = state.get if state.exists else None
            for i, at, region in in_order(pdfs, ["id", "at", "region"], ["at", "id"]):
                if session is None or at - session[0] > ttl_seconds:
                    session = (at, region)
                yield (key[0], i, *session)
            state.update(session)
            state.setTimeoutTimestamp(max(int((session[0] + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))

        yield from _in_chunks(rows(), ["key", "id", "start", "region"])

    marked = requests.withWatermark("ts", WATERMARK)
    return marked.groupBy("key").applyInPandasWithState(run, "key long, id long, start double, region string", "start double, region string", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_latest(stream: DataFrame, keys: list[str], order: str, folder: str):
    """foreachBatch sink: a Parquet table per batch of the latest row of each key; read the table with latest()."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fields = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("v")).select(*keys, "v.*")
        newest.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, keys: list[str], order: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(order, "batch")).alias("v")).select(*keys, "v.*")


class ProgressLog(StreamingQueryListener):
    """Calls `tell(rows, rows per second)` for each progress report of any stream."""

    def __init__(self, tell: Callable[[int, float], None]):
        self.tell = tell

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.tell(event.progress.numInputRows, event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
