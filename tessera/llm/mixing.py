"""Mixing sources to target weights by balanced sampling with the cube method (after Deville and Tillé, 2004).

A source that must give ``target`` words of its ``source_size`` takes each of its documents floor(target / source_size)
times, and once more with the probability that is left. These probabilities are a point in a cube. The flight moves it
through the null space of the constraints, in which the expected words and documents stay as they are: of any three
documents that are still undecided, one direction keeps both totals; the point goes along it, one way or the other by
chance, until one of the three is in or out. Blocks of a source fly independently and leave two documents each, which
fly on together in the next round, until a source is one block. There a few documents of all sizes are held back, and
the landing tries all ways to decide the few that are left, 16 at most: of those that come nearest to the target in words, to within
``NEAR`` of it, the one nearest in documents stays.

So all but 16 documents of a source are drawn without bias, and chance is a function of ids, sizes and sources:
neither the order of the rows nor their partitions matter. No task holds more than a block.

Defined cases: a null text has size 0, and what has size 0 takes nothing; a null source is a source, behind all others;
rows that repeat an id and its size in one source are one unit, whose copies are taken equally often but for one more in
some of them; null ids are told apart by size only; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytescan
from .common import materialise, partitions

#: Weights of the sources in the order of their names, repeating; no document is taken more often than ``MOST``.
WEIGHTS, MOST = (5, 2, 1), 3
#: Units of a source that fly together, and those that wait for the landing.
BLOCK, HELD = 1024, 14
#: Shares of a target that the landing doesn't tell apart.
NEAR = 0.0005
#: Rows that one unit may give at once.
CHUNK = 1 << 16

_KEY = ["no_source", "name"]


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, no_source, name (the source, null as empty) and size in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = bytescan.count(*bytescan.texts(batch.column(3)))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.int64())], ["doc_id", *_KEY, "size"])

    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("name"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, no_source boolean, name string, size long")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number``, from 0 in the order given. Ranges are sorted apart; their counts, one a partition, give where each begins."""
    placed = materialise(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("number", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (no_source, name, source_size) with ``number`` and ``target``: all words shared by weight, none above ``most`` times its own.

    What sources at the bound give up is shared by the others, until none is above: a few rounds of two sums.
    """
    cycle = F.array(*map(F.lit, weights))
    rows = materialise(numbered(sources, *_KEY).withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")).cast("long")), "sources")
    total, left = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rate, full = total / max(left, 1), 0
    while True:
        above = most * F.col("source_size") < F.lit(rate) * F.col("weight")
        n, bound, left = rows.agg(*(F.coalesce(F.sum(F.when(c, x)), F.lit(0)) for c, x in ((above, 1), (above, most * F.col("source_size")), (~above, F.col("weight"))))).first()
        if n == full:
            return rows.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.lit(rate) * F.col("weight")))
        rate, full = (total - bound) / max(left, 1), n


def flight(size: list[int], p: list[float], rng: random.Random) -> list[int]:
    """Moves ``p`` until at most two places are neither 0 nor 1, which are returned; sums of p and of size * p stay."""
    open_: list[int] = []
    for i in range(len(p)):
        if 0.0 < p[i] < 1.0:
            open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1, -1, 0)
        moves = [(x, du) for x, du in zip(open_, u) if du]
        ahead, first = min(((1.0 - p[x]) / du if du > 0 else p[x] / -du, x) for x, du in moves)
        back, last = min((p[x] / du if du > 0 else (1.0 - p[x]) / -du, x) for x, du in moves)
        forward = rng.random() * (ahead + back) < back
        step, hit = (ahead, first) if forward else (-back, last)
        for x, du in moves:
            p[x] = min(max(p[x] + step * du, 0.0), 1.0)
            if x == hit:
                p[x] = 1.0 if step * du > 0 else 0.0
        open_ = [x for x in open_ if 0.0 < p[x] < 1.0]
    return open_


def landing(size: list[int], p: list[float], rest: list[int], near: float) -> None:
    """Decides the places ``rest`` so that the sum of size * p changes least, in steps of ``near``, then that of p."""
    if not rest:
        return
    ways = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    moved = ways - np.array([p[i] for i in rest])
    words, documents = np.abs(moved @ np.array([size[i] for i in rest], float)), np.abs(moved.sum(axis=1))
    best = ways[np.lexsort((words.round(6), documents.round(6), np.floor(words / near)))[0]]
    for i, x in zip(rest, best.tolist()):
        p[i] = float(x)


def _fly(held: int):
    """Units of a block with ``x``, whether they are in: 1, 0 or null (undecided, with the probability ``p``)."""

    def run(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_pylist() for c in ("number", "block", "blocks", "place", "doc_id", "size", "p", "target")}
        last = rows["blocks"][0] == 1
        size, p = rows["size"], rows["p"]
        order = sorted(range(len(p)), key=lambda i: (rows["place"][i], rows["doc_id"][i] or 0, rows["doc_id"][i] is None, size[i]))
        n = len(p)
        if last:
            by_size = sorted(order, key=lambda i: size[i])
            waits = {by_size[k * (n - 1) // max(held - 1, 1)] for k in range(held)} if n > held else set(order)
            order = [i for i in order if i not in waits] + [i for i in order if i in waits]
            n -= len(waits)
        size, p = [size[i] for i in order], [p[i] for i in order]
        rest = flight(size[:n], moved := p[:n], random.Random(f"{rows['number'][0]} {rows['block'][0]} {len(p)}"))
        p[:n] = moved
        if last:
            landing(size, p, [*rest, *range(n, len(p))], NEAR * rows["target"][0])
        decided = [None if 0.0 < v < 1.0 else int(v) for v in p]
        out = table.take(pa.array(order))
        out = out.set_column(out.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
        return out.set_column(out.schema.get_field_index("x"), "x", pa.array(decided, pa.int32())).drop_columns(["block", "blocks", "place"])

    return run


def _decided(units: DataFrame) -> DataFrame:
    """``units`` with ``x`` for all: rounds of flights, each on what the one before left, two a block."""
    schema = units.schema
    done, left, turn = [], materialise(units, "units"), 0
    while not left.isEmpty():
        counts = left.groupBy("number").agg(F.count(F.lit(1)).alias("n"))
        place = F.xxhash64("doc_id", "size", "number", F.lit(turn))
        dealt = (
            left.join(counts, "number").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).drop("n")
            .withColumn("place", place).withColumn("block", F.pmod(F.xxhash64("place"), "blocks"))
        )
        flown = materialise(dealt.groupBy("number", "block").applyInArrow(_fly(HELD), schema), "flown")
        done.append(flown.where("x is not null"))
        left, turn = flown.where("x is null"), turn + 1
    out = units.limit(0)
    for rows in done:
        out = out.unionByName(rows)
    return out


def _rows_of(units: DataFrame, taken: Column) -> DataFrame:
    """Each unit as often as it has rows; those with many are dealt to all tasks."""
    few = units.where(F.col("rows") <= CHUNK).withColumn("start", F.lit(0).cast("long"))
    many = units.where(F.col("rows") > CHUNK).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(CHUNK).cast("long")))).repartition(partitions(units.sparkSession))
    each = few.unionByName(many).withColumn("k", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + CHUNK, F.col("rows")))))
    return each.withColumn("taken", taken)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target (of its source), taken (words, repeats counted), source, copies (taken / size)."""
    units = materialise(sizes(docs, id_col, text_col, source_col).groupBy(*_KEY, "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    sources = materialise(targets(units.groupBy(*_KEY).agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most).drop("weight"), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(share), F.lit(most))
    expected = F.col("rows") * F.when(F.col("base") < most, share - F.col("base")).otherwise(0.0)
    units = (
        units.join(sources, _KEY).withColumn("base", base.cast("int"))
        .withColumn("more", F.floor(expected)).withColumn("p", expected - F.col("more")).withColumn("x", F.lit(None).cast("int"))
    )
    drawn = (F.col("size") > 0) & (F.col("p") > 0)
    units = _decided(units.where(drawn)).unionByName(units.where(~drawn).withColumn("x", F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("k") <= F.col("more") + F.col("x")).cast("int")).otherwise(0)
    source = F.when(~F.col("no_source"), F.col("name"))
    return _rows_of(units, F.col("size") * copies).select("doc_id", "size", "source_size", "target", "taken", source.alias("source"), copies.cast("int").alias("copies"))
