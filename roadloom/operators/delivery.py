"""Exactly one copy of each message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.geo import number_id, with_place


#: Microseconds that stand for an unknown time of delivery, after every known one, and the ties told apart.
_LATEST, _TIES = 2**62, 10**18
#: Types whose values an aggregation buffer can hold in place, so that Spark aggregates them by hashing.
_FIXED = (T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def first_delivery(df: DataFrame, key: Column, received: str, keep: Sequence[str], key_name: str = "key", count_name: str = "n_deliveries") -> DataFrame:
    """One row per key: the columns `keep` of its first-received copy, and how often it was delivered.

    Aggregation by key with min_by over delivery time and tie-break, so partial aggregation on the map side leaves one
    row per key and task, and a key holding a third of all rows is never gathered. Where all of `keep` have a fixed
    width, time and tie-break (the values' hash) are packed into one number: no buffer varies in size, and Spark hashes
    instead of sorting. With text among them the copy is its own tie-break: the least struct of time and values.
    received is a timestamp or whole number; a null in it comes last. Of copies with one time always the same is
    kept, whatever the order of the rows. Rows with a null key are left aside. Names of df's other columns don't
    matter: the result has only key_name, keep and count_name.
    """
    time = F.col(received)
    if isinstance(df.schema[received].dataType, (T.TimestampType, T.TimestampNTZType)):
        time = F.unix_micros(time.cast("timestamp"))
    at, tie = F.coalesce(time.cast("bigint"), F.lit(_LATEST)), F.pmod(F.xxhash64(*keep), F.lit(_TIES))
    fixed = all(isinstance(df.schema[c].dataType, _FIXED) for c in keep)
    if fixed:
        order = at.cast("decimal(19,0)") * F.lit(_TIES).cast("decimal(19,0)") + tie.cast("decimal(18,0)")
        rows = df.select(key.alias("__key"), order.alias("__order"), at.alias("__v"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(keep)])
        chosen = [F.min_by(c, "__order").alias(c) for c in rows.columns if c.startswith("__v")]
    else:
        rows = df.select(key.alias("__key"), F.struct(at.alias("__at"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(keep)]).alias("__v"))
        chosen = [F.min("__v").alias("__v")]
    rows = rows.where("__key is not null")
    agg = rows.groupBy("__key").agg(*chosen, F.count(F.lit(1)).alias("__n"))
    agg = agg.where("__v is not null")  # keeps the choice of the copy in the plan even where only keys are asked for
    kept = [F.col(f"__v{i}") if fixed else F.col("__v")[f"__v{i}"] for i in range(len(keep))]
    return agg.select(F.col("__key").alias(key_name), *[v.alias(c) for v, c in zip(kept, keep, strict=True)], F.col("__n").alias(count_name))


def first_pings(fcd: DataFrame, also: Sequence[str] = ("engine",)) -> DataFrame:
    """(id, id_veh, ts, x, y) and the columns `also` of the first-received copy of each id_fcd that has a time and a place.

    id_fcd counts as a number; the copy is chosen before rows without time or place are left aside. The place is
    parsed before the shuffle, which so carries no text but id_veh. Columns of df other than these don't matter.
    """
    slim = with_place(fcd.select("geometry", "x", "y", number_id(F.col("id_fcd")).alias("id"), "id_veh", "ts", *also, "received_at"))
    one = first_delivery(slim, F.col("id"), "received_at", ["id_veh", "ts", *also, "x", "y"], "id")
    return one.where("ts is not null and x is not null and id_veh is not null").drop("n_deliveries")
