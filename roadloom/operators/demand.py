"""Origin-destination demand in long form (t, o, d, value): binning, shares, sums, algebra."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("t", "o", "d")


def slice_of(minute: Column, start: int, step: int, count: int) -> Column:
    """Index of the right-open slice of a minute; the last slice is open to the right, earlier minutes have none."""
    k = F.floor((minute - start) / step).cast("int")
    return F.when(k >= 0, F.least(k, F.lit(count - 1)))


def binned(df: DataFrame, minute: Column, start: int, step: int, count: int, keys: Sequence[str] = ("o", "d"), value: str = "value") -> DataFrame:
    """Sum of value by keys and slice t; the diagonal is no demand."""
    df = df.withColumn("t", slice_of(minute, start, step, count)).where("t is not null and o <> d")
    return df.groupBy(*keys, "t").agg(F.sum(value).alias(value))


def shares(df: DataFrame, mode: str = "mode", value: str = "value") -> DataFrame:
    """Adds each mode's share of its (t, o, d) total, 0 where that is 0."""
    total = F.sum(value).over(W.partitionBy(*KEYS))
    return df.withColumn("share", F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0)))


def grid(df: DataFrame, zones: DataFrame, times: DataFrame) -> DataFrame:
    """The complete matrix over zones (a bounded table) and times, 0 where df has nothing and on the diagonal."""
    o, d = zones.select(F.col("zone").alias("o")), zones.select(F.col("zone").alias("d"))
    full = times.select("t").crossJoin(o).crossJoin(d)
    return full.join(df, list(KEYS), "left").select(*KEYS, F.when(F.col("o") == F.col("d"), 0.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("value"))


def axis_sums(df: DataFrame) -> DataFrame:
    """Totals over everything, by o, by d and by t, in one pass: (axis, key, value)."""
    g = df.groupingSets([[], ["o"], ["d"], ["t"]], "o", "d", "t").agg(F.sum("value").alias("value"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "o").when(F.col("g") == 5, "d").otherwise("t")
    return g.select(axis.alias("axis"), F.coalesce(F.col("o").cast("bigint"), F.col("d").cast("bigint"), F.col("t").cast("bigint")).alias("key"), "value")


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """a + b, a - b, a * b, a / b cell by cell, missing cells 0 (x / 0 is null), or merge: b's cells override a's."""
    j = a.select(*KEYS, F.col("value").alias("l")).join(b.select(*KEYS, F.col("value").alias("r")), list(KEYS), "full")
    x, y = F.coalesce("l", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "merge": F.coalesce("r", "l")}[op]
    return j.select(*KEYS, value.alias("value"))


def scaled(df: DataFrame, op: str, scalar: float) -> DataFrame:
    v = F.col("value")
    return df.withColumn("value", {"+": v + scalar, "-": v - scalar, "*": v * scalar, "/": F.try_divide(v, F.lit(scalar))}[op])


def transposed(df: DataFrame) -> DataFrame:
    return df.select("t", F.col("d").alias("o"), F.col("o").alias("d"), "value")


def inverted(df: DataFrame) -> DataFrame:
    """Inverse matrix of each slice; a slice that has none gives no rows. A slice has as many rows as pairs of zones."""

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="o", columns="d", values="value", aggfunc="last", fill_value=0.0)
        labels = sorted({*m.index, *m.columns})
        m = m.reindex(index=labels, columns=labels, fill_value=0.0)
        try:
            inv = np.linalg.inv(m.to_numpy())
        except np.linalg.LinAlgError:
            return pd.DataFrame({"t": [], "o": [], "d": [], "value": []})
        o, d = np.meshgrid(labels, labels, indexing="ij")
        return pd.DataFrame({"t": pdf["t"].iloc[0], "o": o.ravel(), "d": d.ravel(), "value": inv.ravel()})

    return df.groupBy("t").applyInPandas(invert, "t int, o bigint, d bigint, value double")


def times_vector(m: DataFrame, g: DataFrame, row: Sequence[str], col: Sequence[str], value: str = "value") -> DataFrame:
    """Sparse M g: rows (row, sum of share * value over col)."""
    return m.join(g, list(col)).groupBy(*row).agg(F.sum(F.col("share") * F.col(value)).alias(value))


def weighted_counts(counts: DataFrame, modes: DataFrame) -> DataFrame:
    """Counts in equivalent vehicles by detector and time: a mode's factor, 1 for null, 'all' and unknown modes."""
    j = counts.join(modes.select(F.col("code").alias("mode"), "eq_factor"), "mode", "left")
    return j.groupBy("id", "timestamp").agg(F.sum(F.col("counts") * F.coalesce("eq_factor", F.lit(1.0))).alias("eq_counts"))


def overlay(layers: Sequence[DataFrame], key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Layers of one table by key: of each cell the first that isn't null, earlier layers first."""
    out = layers[0].select(*key, *columns)
    for more in layers[1:]:
        right = more.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
        out = out.join(right, list(key), "full").select(*key, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in columns])
    return out
