"""Continuous periods and gaps of overlapping, nested and touching intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 1440
TIME_OF_DAY = "^[\\s\\u00a0]*([01]?\\d|2[0-3])[:.hH]?([0-5]\\d)(?:[:.][0-5]\\d)?[\\s\\u00a0]*$"
END_OF_DAY = "^[\\s\\u00a0]*24[:.hH]?00(?:[:.]00)?[\\s\\u00a0]*$"


def minute_of_day(c: Column, end: bool = False) -> Column:
    """Minutes from midnight of a time of day ('07:05', '7.05', '7h05', '0705', ' 07:05:30 '), else null.

    24:00 is a time only as an end. Seconds are cut off, but must be possible.
    """
    m = F.regexp_extract(c, TIME_OF_DAY, 1).try_cast("int") * 60 + F.regexp_extract(c, TIME_OF_DAY, 2).try_cast("int")
    return F.coalesce(m, F.when(c.rlike(END_OF_DAY), DAY)) if end else m


def periods_and_gaps(df: DataFrame, entity: Column, start: Column, stop: Column, block: int = DAY) -> DataFrame:
    """(kind, entity, from, to): each maximal continuous period of an entity, and each gap between two of them.

    start, stop are whole numbers; a row with a null in either or in the entity, or with stop <= start, is no interval.
    Touching intervals are continuous. Per entity and block of time, intervals with one start become the longest of
    them (partial aggregation), then the blocks' islands by a running maximum of the ends so far, then the same over
    the islands of all blocks: an entity holding a third of all rows is spread over its blocks, and its last window
    has at most block / 2 islands a block, whatever the number of rows.
    """
    rows = df.select(entity.alias("entity"), start.cast("bigint").alias("a"), stop.cast("bigint").alias("z")).where("entity is not null and a < z")
    rows = rows.groupBy("entity", F.floor(F.col("a") / block).alias("block"), "a").agg(F.max("z").alias("z"))

    def islands(d: DataFrame, *keys: str) -> DataFrame:
        order = W.partitionBy(*keys).orderBy("a", "z")
        reached = F.max("z").over(order.rowsBetween(W.unboundedPreceding, -1))
        d = d.withColumn("new", F.when(F.col("a") <= reached, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
        return d.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("z").alias("z"))

    periods = islands(islands(rows, "entity", "block").select("entity", "a", "z"), "entity")
    after = F.lead("a").over(W.partitionBy("entity").orderBy("a"))
    both = periods.withColumn("next", after).select("entity", F.explode(F.array(F.struct(F.lit("period").alias("kind"), F.col("a").alias("from"), F.col("z").alias("to")), F.struct(F.lit("gap").alias("kind"), F.col("z").alias("from"), F.col("next").alias("to")))).alias("p"))
    return both.where("p.to is not null").select("p.kind", "entity", "p.from", "p.to")


def set_name(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(c, "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")))


def p1_found(events: DataFrame) -> DataFrame:
    """Periods and gaps of link_events; an end before the start is on the next day, equal times are no interval."""
    day = F.datediff(F.col("event_day"), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY
    rows = events.select(set_name(F.col("id_link_set")).alias("name"), day.alias("day"), minute_of_day(F.col("start_hm")).alias("a"), minute_of_day(F.col("end_hm"), True).alias("z"))
    stop = F.when(F.col("a") != F.col("z"), F.col("day") + F.col("z") + F.when(F.col("z") < F.col("a"), DAY).otherwise(0))
    found = periods_and_gaps(rows.where("name != ''"), F.col("name"), F.col("day") + F.col("a"), stop)
    return found.select("kind", F.col("entity").alias("id_link_set"), F.col("from").alias("from_min"), F.col("to").alias("to_min"))
