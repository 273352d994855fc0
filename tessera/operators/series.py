"""Time series of states: sampling, previous values, resampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def every(rows: DataFrame, step: str, x: int) -> DataFrame:
    """Rows whose step number is a multiple of ``x``."""
    if x < 1:
        raise ValueError("the interval must be at least 1")
    return rows.where(F.col(step) % x == 0)


def recorded(rows: DataFrame, mode: str, step: str, x: int = 1) -> DataFrame:
    """Rows that a recorder in ``mode`` (every_step, every_x, nothing) keeps."""
    return {"every_step": lambda: rows, "every_x": lambda: every(rows, step, x), "nothing": lambda: rows.where(F.lit(False))}[mode]()


def between(rows: DataFrame, time: str, start: float, end: float) -> DataFrame:
    return rows.where(F.col(time).between(start, end))


def previous(rows: DataFrame, value: str, key: list[str], order: list[str]) -> DataFrame:
    """Adds the value of the row before, and the first value of the key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({f"{value}_prev": F.lag(value).over(w), f"{value}_begin": F.first(value).over(w)})


def kept_frames(times: np.ndarray, last: float | None, fps: float) -> tuple[np.ndarray, float | None]:
    """Which of the sorted ``times`` a sampler with reset keeps whose last kept one was ``last``; and the new last one.

    The first is kept, then each at which the time since the last kept one is a frame or more, and each at the very time
    of the last kept one. What exceeds a frame is discarded, so that kept frames drift.
    """
    kept = np.zeros(len(times), bool)
    at = 0
    while at < len(times):
        if last is not None:
            same = int(np.searchsorted(times, last, "right"))
            kept[at:same] = times[at:same] == last
            # Near the bound rounding decides, so the first that fits is looked for around it.
            near = max(int(np.searchsorted(times, last + 1 / fps)) - 2, at, same)
            while near < len(times) and not (times[near] - last) * fps >= 1:
                near += 1
            at = near
            if at == len(times):
                break
        last = float(times[at])
        kept[at] = True
        at += 1
    return kept, last


def frame_sampler(rows: DataFrame, key: str, time: str, fps: float) -> DataFrame:
    """key, t, frame (from 1) of the frames that ``kept_frames`` keeps of each key.

    Sorted rows stream past, and what is remembered of a key is its last kept time and count, whatever its length.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, frames = object(), None, 0
        for batch in batches:
            codes, times = batch.column(0).dictionary_encode("encode").indices.to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if (own := batch.column(0)[low].as_py()) != now:
                    now, last, frames = own, None, 0
                kept, last = kept_frames(times[low:high], last, fps)
                at = low + np.flatnonzero(kept)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(times[at]), pa.array(np.arange(frames + 1, frames + 1 + len(at)))], [key, "t", "frame"])
                frames += len(at)

    timed = rows.select(key, F.col(time).cast("double").alias("t")).where("t is not null")
    return timed.repartition(key).sortWithinPartitions(key, "t").mapInArrow(run, f"{key} {kind}, t double, frame long")


def last_known(rows: DataFrame, key: list[str], time: str, order: list[str], values: dict[str, Column], ahead: bool = False, strictly: bool = False) -> DataFrame:
    """Adds for each of ``values`` its last one that isn't null, at or before the row (``strictly``: before it) in order of
    ``time`` and ``order``; with ``ahead`` the first one from the row on, in order of descending time.

    Rows are dealt by ranges of key and time, so that one key spreads over as many tasks as it needs. Windows run inside
    the ranges. What a range leaves to the next one of the same key is carried over in a table of two rows a range at most,
    as only the first and the last key of a range reach beyond it.
    """
    # From a checkpoint: ranges are drawn from a sample, and named in two places, which must mean the same ones.
    placed = cut(rows.withColumns({f"_at_{n}": c for n, c in values.items()}).repartitionByRange(*key, time).withColumn("_part", F.spark_partition_id()))
    turn = (lambda c: F.col(c).desc()) if ahead else F.col
    inside = Window.partitionBy("_part", *key).orderBy(turn(time), *order).rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    best = F.min if ahead else F.max
    edge = lambda n: best(F.when(F.col(f"_at_{n}").isNotNull(), F.struct(time, *([] if ahead else order), f"_at_{n}")))[f"_at_{n}"]
    ends = placed.groupBy("_part", *key).agg(*(edge(n).alias(f"_end_{n}") for n in values))
    parts = Window.partitionBy(*key)
    before = parts.orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_parts", F.count(F.lit(1)).over(parts)).where("_parts > 1")
    carried = carried.select(F.col("_part").alias("_of"), *(F.col(k).alias(f"_of_{i}") for i, k in enumerate(key)), *(F.last(f"_end_{n}", True).over(before).alias(f"_carried_{n}") for n in values))
    same = [placed["_part"] == F.col("_of"), *(placed[k].eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(key))]
    out = placed.withColumns({n: F.last(f"_at_{n}", True).over(inside) for n in values}).join(F.broadcast(carried), same, "left")
    return out.withColumns({n: F.coalesce(n, f"_carried_{n}") for n in values}).select(*rows.columns, *(n for n in values if n not in rows.columns))


def resample(rows: DataFrame, key: str, time: str, value: str, start: float, end: float, step: float, linear: bool = True) -> DataFrame:
    """The series at start, start + step, ..., end: linear between samples, else the last one before; null where there is none.

    Grid points join the samples as rows of one ordered whole, which ``last_known`` deals out, so that no range join is needed.
    """
    points = rows.select(key).distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(int((end - start) / step)))))
    points = points.select(key, (F.lit(start) + F.col("n") * step).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked"))
    samples = rows.select(key, F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"), F.lit(False).alias("asked"))
    at = F.when(~F.col("asked"), F.struct("t", "v"))
    both = last_known(samples.unionByName(points), [key], "t", ["asked"], {"low": at})
    if linear:
        both = last_known(both, [key], "t", ["asked"], {"high": at}, ahead=True)
    both = both.where("asked")
    low = F.col("low")
    if not linear:
        return both.select(key, "t", low["v"].alias(value))
    high = F.col("high")
    share = F.try_divide(F.col("t") - low["t"], high["t"] - low["t"])
    return both.select(key, "t", F.when(high["t"] == low["t"], low["v"]).otherwise(low["v"] + share * (high["v"] - low["v"])).alias(value))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Adds to each left row the latest ``value`` of ``right`` at or before its time: one union, dealt out by key and time."""
    columns = left.columns
    both = left.withColumn("_v", F.lit(None).cast("double")).withColumn("_side", F.lit(1)).unionByName(
        right.select(key, time, F.col(value).cast("double").alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    return last_known(both, [key], time, ["_side"], {value: F.col("_v")}).where("_side = 1").select(*columns, value)


def changes(rows: DataFrame, key: list[str], time: str, value: str, order: list[str] = ()) -> DataFrame:
    """Adds ``new``: whether a row's value differs from the row before it (null is a value; the first one is new)."""
    found = last_known(rows, key, time, list(order), {"_before": F.struct(F.col(value).alias("v"))}, strictly=True)
    return found.withColumn("new", F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))).drop("_before")


def without_repeats(values: Column) -> Column:
    """Values of an ordered array that differ from the last one kept: from the one before, as what was left out equals the last one kept."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))


def moved_back(values: Column, goes: Callable[[Column], Column]) -> Column:
    """Values for which ``goes`` doesn't hold, then the others, both in their order; null counts as not holding."""
    holds = lambda x: F.coalesce(goes(x), F.lit(False))
    return F.concat(F.filter(values, lambda x: ~holds(x)), F.filter(values, holds))
