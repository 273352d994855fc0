"""Streams over the same expressions: continuous recording, a stateful frame sampler, playback and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series import kept_frames


def playback(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stored series as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def record(states: DataFrame, path: str, checkpoint: str, step: str = "state_nr", x: int = 1):
    """Starts a query that writes every x-th state of a stream."""
    kept = states.where(F.col(step) % x == 0)
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def sampled(frames: DataFrame, key: str, time: str, fps: float) -> DataFrame:
    """key, t, frame of the frames that a sampler with reset keeps; what it remembers of a key is its last kept time and count.

    Frames of a key are taken in order of time within a micro-batch; batches must arrive in order.
    """

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        times = np.sort(np.concatenate([batch["t"].to_numpy() for batch in batches]))
        kept, last = kept_frames(times, last, fps)
        times = times[kept]
        if last is not None:
            state.update((last, n + len(times)))
        yield pd.DataFrame({"key": np.full(len(times), k[0]), "t": times, "frame": np.arange(n + 1, n + 1 + len(times))})

    rows = frames.select(F.col(key).cast("long").alias("key"), F.col(time).cast("double").alias("t"))
    return rows.groupBy("key").applyInPandasWithState(keep, "key long, t double, frame long", "last double, n long", "append", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Counts and sums of ``value`` per event window; rows later than ``late`` are dropped by the watermark. Takes batches and streams."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


#: The state store that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _windowed(width: int):
    """A processor of rows (t in microseconds, value) of a key: sums by window of ``width``, and late rows as they come."""
    from pyspark.sql.streaming import StatefulProcessor

    class Windowed(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.open = handle, handle.getMapState("open", "start long", "n long, total double")

        def handleInputRows(self, key, rows, timerValues):
            watermark = timerValues.getCurrentWatermarkInMs() * 1000
            late, sums = [], {}
            for batch in rows:
                start = batch["t"].to_numpy() // width * width
                behind = start + width <= watermark
                late.append(batch[behind])
                for s, own in batch[~behind].groupby(start[~behind])["value"]:
                    n, total = sums.get(s, (0, 0.0))
                    sums[s] = (n + len(own), total + float(own.sum()))
            for s, (n, total) in sums.items():
                at = (int(s),)
                if self.open.containsKey(at):
                    old = self.open.getValue(at)
                    n, total = n + old[0], total + old[1]
                else:
                    self.handle.registerTimer((int(s) + width) // 1000)
                self.open.updateValue(at, (n, total))
            found = pd.concat(late) if late else pd.DataFrame({"t": [], "value": []})
            yield _rows(key, "late", found["t"], 1, found["value"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - width,)
            n, total = self.open.getValue(at)
            self.open.removeKey(at)
            yield _rows(key, "window", [at[0]], n, [total])

        def close(self) -> None:
            pass

    def _rows(key, kind, t, n, total) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "kind": kind, "t": np.asarray(t, "int64"), "n": np.full(len(t), n, "int64"), "total": np.asarray(total, float)})

    return Windowed()


def windows_with_late_rows(events: DataFrame, time: str, value: str, key: str, width: int, delay: str) -> DataFrame:
    """Of a stream: key, kind, t (microseconds), n, total.

    A row of kind ``window`` comes once the watermark, ``delay`` behind the latest time seen before the batch, has reached
    the end of a window of ``width`` microseconds that starts at ``t``. A row whose window was over when it came is handed
    on as ``late``, where Spark's own windows drop it. Start it with ``with_timers``.
    """
    seen = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    # Without the time itself, as rows behind the watermark would be left out before the processor sees them.
    rows = seen.select(F.col(key).cast("long").alias("key"), F.unix_micros("_time").alias("t"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(_windowed(width), "key long, kind string, t long, n long, total double", "append", "eventtime")


def play(rows: DataFrame, batch: str, folder: str, start) -> None:
    """Feeds ``rows`` to a stream in the order of ``batch``: each batch arrives as files, and is worked off, with what its
    watermark sets free, before the next comes. ``start(stream)`` gives a writer with its checkpoint."""
    spark = rows.sparkSession
    numbers = [r[0] for r in rows.select(batch).distinct().orderBy(batch).collect()]  # one for each batch
    arriving = rows.drop(batch)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKS)
    try:
        for k in numbers:
            rows.where(F.col(batch) == k).drop(batch).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(arriving.schema).parquet(folder)
            start(stream).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
