"""Sequence analytics over ordered rows: previous and next, odometer, sessions, fills, smoothing, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_of(keys: Sequence[str], order: Sequence[str]) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str) -> DataFrame:
    """Seconds to the previous and to the next row of the same key."""
    w = order_of(keys, order)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    t = seconds(F.col(ts))
    return df.withColumns({"p_before": t - seconds(F.lag(ts).over(w)), "p_after": seconds(F.lead(ts).over(w)) - t})


def odometer(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Planar step from the row before and the distance so far."""
    w = order_of(keys, order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("step", step).withColumn("travelled", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str = "session") -> DataFrame:
    """Numbers the sessions of a key from 1: a row where `starts` holds begins one (a null doesn't), as does the first."""
    w = order_of(keys, order)
    flag = F.when((F.row_number().over(w) == 1) | F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return df.withColumn("__new", flag).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def forward_fill(df: DataFrame, keys: Sequence[str], slot: str, value: str, first: int, last: int, step: int) -> DataFrame:
    """Every slot of each key from first to last, with the last value known so far."""
    every = df.select(*keys).distinct().withColumn(slot, F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))
    return every.join(df, [*keys, slot], "left").select(*keys, slot, F.last(value, True).over(order_of(keys, [slot])).alias(value))


def interpolate(df: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Nulls between two values by the line between them, at an end by the nearest value."""
    w = order_of(keys, [at])
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    a0, a1 = F.last(known, True).over(back), F.first(known, True).over(ahead)
    line = v0 + (v1 - v0) * F.try_divide(F.col(at) - a0, a1 - a0)
    return df.withColumn(value, F.coalesce(value, line, v0, v1))


def drop_repeats(values: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(values, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(values, i - 1)))


def smoothed(values: Column, keep: float = 0.9) -> Column:
    """Last value of the recursion s = keep * s + (1 - keep) * v over an array, from its first element."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda s, v: s * keep + v * (1 - keep))


def rounded_with_rest(values: Column) -> Column:
    """Whole numbers of an array of demands, each rounding's rest carried to the next (0.5 is rounded down)."""
    zero = F.struct(F.lit(0.0).alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        now = v + acc["rest"]
        whole = F.ceil(now - 0.5).cast("bigint")
        return F.struct((now - whole).alias("rest"), F.concat(acc["out"], F.array(whole)).alias("out"))

    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "k") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def within_box(df: DataFrame, keys: Sequence[str], columns: Sequence[str], low: float = 0.05, high: float = 0.95, reach: float = 1.5) -> DataFrame:
    """Rows whose columns lie within reach times the low-high percentile span around that span, per key.

    Percentiles are exact aggregates with map-side partials, joined back, so a hot key isn't sorted in one task.
    """
    box = df.groupBy(*keys).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"__{c}") for c in columns])
    j = df.join(box, list(keys))
    for c in columns:
        lo, hi = F.col(f"__{c}")[0], F.col(f"__{c}")[1]
        j = j.where((F.col(c) >= lo - reach * (hi - lo)) & (F.col(c) <= hi + reach * (hi - lo)))
    return j.drop(*[f"__{c}" for c in columns])


def repetitions(paths: DataFrame, keys: Sequence[str], links: str, order: Sequence[str]) -> DataFrame:
    """Adds `repetition`: of rows with the same keys and links the first has 0, the next 1, and so on, in `order`."""
    return paths.withColumn("repetition", F.row_number().over(W.partitionBy(*keys, links).orderBy(*order)) - 1)


def _of_block(rows: DataFrame, ends: DataFrame, of: Sequence[str]) -> DataFrame:
    """Rows with their block's summary; equal nulls belong together, as they do in a window."""
    named = ends.withColumnsRenamed({c: f"__of_{c}" for c in of})
    on = [rows[c].eqNullSafe(named[f"__of_{c}"]) for c in of]
    return rows.join(named, on).drop(*[f"__of_{c}" for c in of])


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], block: Column) -> DataFrame:
    """Adds previous_c and next_c of the columns: the values in the row before and after of the same key.

    A key's rows are cut into blocks (`block` must not fall along the order), so a hot key is spread over tasks; over
    the blocks' edges one summary row a block gives the neighbour. Nulls at a key's ends.
    """
    of = [*keys, "__block"]
    rows = df.withColumn("__block", block)
    w, both = W.partitionBy(*of).orderBy(*order), F.struct(*columns)
    ends = rows.groupBy(*of).agg(F.min_by(both, F.struct(*order)).alias("__a"), F.max_by(both, F.struct(*order)).alias("__z"))
    along = W.partitionBy(*keys).orderBy("__block")  # one row a block
    ends = ends.select(*of, F.lag("__z").over(along).alias("__before"), F.lead("__a").over(along).alias("__after"))
    near = rows.withColumns({"__p": F.lag(both).over(w), "__n": F.lead(both).over(w)})
    near = _of_block(near, ends, of)
    found = {f"previous_{c}": F.coalesce("__p", "__before")[c] for c in columns} | {f"next_{c}": F.coalesce("__n", "__after")[c] for c in columns}
    return near.withColumns(found).drop("__p", "__n", "__before", "__after", "__block")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, block: Column, name: str = "session") -> DataFrame:
    """Numbers the sessions of a key from 1, as `sessions` does, but by blocks: a running count within each, and on top
    of it the starts of the blocks before, from one summary row a block. `starts` must hold in a key's first row."""
    of = [*keys, "__block"]
    rows = df.withColumns({"__block": block, "__new": F.coalesce(starts, F.lit(False)).cast("int")})
    so_far = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy(*of).agg(F.sum("__new").alias("__n")).select(*of, F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__base"))
    own = F.sum("__new").over(W.partitionBy(*of).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__own", own)
    return _of_block(rows, base, of).withColumn(name, F.col("__base") + F.col("__own")).drop("__own", "__base", "__new", "__block")
