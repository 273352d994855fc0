"""Exact quantiles of groups of any size, by narrowing brackets.

A sketch of bounded error brackets the wanted ranks of each group; counting tells how many values lie below, and how few
inside. The values inside are bracketed anew, until few enough are left to be sorted, or all are one value. A pass is two
aggregations with partial results, and leaves about one value in ``ACCURACY`` / 4: no task holds a group, nor is one sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Accuracy of a sketch (its error is a share of 1 / ``ACCURACY`` of the ranks), and values that are sorted in one task.
ACCURACY, FEW = 1000, 1 << 16


def quantiles(rows: DataFrame, group: list[str], value: str, fractions: list[float]) -> DataFrame:
    """group columns, and ``quantiles``: the values at ``fractions`` of each group, between neighbours in proportion.

    Nulls don't count; a group without values is left out; NaN is the largest value.
    """
    v = rows.select(*group, F.col(value).cast("double").alias("_v")).where("_v is not null")
    place = F.col("_f") * (F.col("_n") - 1)
    wanted = v.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_f", F.explode(F.array(*map(F.lit, map(float, fractions)))))
    wanted = wanted.where("_n > 0").dropDuplicates([*group, "_f"]).select(*group, "_f", F.floor(place).alias("_rank"), (place - F.floor(place)).alias("_part"), F.col("_n").alias("_inside"))
    keys = [*group, "_f"]
    # ``_next``: the least value above the bracket, where the upper neighbour may be.
    open_ = cut(wanted.withColumns({"_low": F.lit(None).cast("double"), "_high": F.lit(None).cast("double"), "_next": F.lit(None).cast("double")}))
    done: list[DataFrame] = []
    while True:
        # NULL bounds are open ones. NaN compares as the largest value.
        within = (F.col("_low").isNull() | (F.col("_v") >= F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
        few, one = F.col("_inside") <= FEW, F.coalesce(F.col("_low") == F.col("_high"), F.lit(False))
        done.append(_sorted(v, open_.where(few & ~one), within, group, keys))
        done.append(open_.where(one).select(*keys, "_part", F.col("_low").alias("_a"), F.when(F.col("_rank") + 1 < F.col("_inside"), F.col("_low")).otherwise(F.col("_next")).alias("_b")))
        left = open_.where(~few & ~one)
        if left.isEmpty():
            break
        inside = _joined(v, left, group).where(within)
        # One sketch a key, read at all ranks that it tells apart; the bracket is two of them away on either side.
        grid = [i / ACCURACY for i in range(ACCURACY + 1)]
        sketch = inside.groupBy(*keys).agg(F.percentile_approx("_v", grid, 2 * ACCURACY).alias("_grid"))
        step = lambda x: F.element_at("_grid", (F.greatest(F.lit(0), F.least(F.lit(ACCURACY), x)) + 1).cast("int"))
        share = lambda r: r * ACCURACY / F.col("_inside")
        bounds = _joined(left, sketch, keys).select(
            *keys, "_rank", "_part", F.col("_low").alias("_old_low"), F.col("_high").alias("_old_high"), F.col("_next").alias("_old_next"),
            step(F.floor(share(F.col("_rank"))) - 2).alias("_low"), step(F.ceil(share(F.col("_rank") + 2)) + 2).alias("_high"),
        )
        bounds = cut(bounds)
        old = (F.col("_old_low").isNull() | (F.col("_v") >= F.col("_old_low"))) & (F.col("_old_high").isNull() | (F.col("_v") <= F.col("_old_high")))
        counted = _joined(v, bounds, group).where(old).groupBy(*keys).agg(
            F.sum((F.col("_v") < F.col("_low")).cast("long")).alias("_below"), F.sum(((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))).cast("long")).alias("_inside"),
            F.min(F.when(F.col("_v") > F.col("_high"), F.col("_v"))).alias("_above"),
        )
        open_ = cut(
            _joined(bounds, counted, keys).select(
                *group, "_f", F.when((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_inside")), F.col("_rank") - F.col("_below"))
                .otherwise(F.raise_error(F.lit("a sketch missed its rank")).cast("long")).alias("_rank"),
                "_part", "_inside", "_low", "_high", F.coalesce("_above", "_old_next").alias("_next"),
            )
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    at = F.when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
    found = out.select(*keys, at.alias("_q")).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_f", "_q"))).alias("_m"))
    return found.where(F.size("_m") > 0).select(*group, F.array(*(F.element_at("_m", F.lit(float(f))) for f in fractions)).alias("quantiles"))


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    if not keys:
        return a.join(F.broadcast(b))  # without groups there is one row for each fraction
    named = b.withColumnsRenamed({k: f"_right{k}" for k in keys})
    return a.join(named, [a[k].eqNullSafe(named[f"_right{k}"]) for k in keys]).drop(*(f"_right{k}" for k in keys))


def _sorted(v: DataFrame, open_: DataFrame, within: Column, group: list[str], keys: list[str]) -> DataFrame:
    """The values at ``_rank`` and behind it, of brackets with few values."""
    gathered = _joined(v, open_, group).where(within).groupBy(*keys, "_rank", "_part", "_next").agg(F.array_sort(F.collect_list("_v")).alias("_all"))
    behind = F.when(F.col("_rank") + 1 < F.size("_all"), F.get("_all", (F.col("_rank") + 1).cast("int"))).otherwise(F.col("_next"))
    return gathered.select(*keys, "_part", F.get("_all", F.col("_rank").cast("int")).alias("_a"), behind.alias("_b"))
