"""Skewed, empty and odd inputs of the general problems' queries."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators.delivery import first_delivery
from roadloom.operators.intervals import p1_found
from roadloom.operators.sequences import spans
from roadloom.operators.spikes import flagged_readings, p4_found
from roadloom.operators.timestamps import p7_found
from roadloom.operators.trips import stops_and_trips

T0 = datetime(2024, 1, 1)
FCD = "id_fcd string, id_veh string, ts timestamp_ntz, engine tinyint, x double, y double, geometry string, batch bigint, received_at timestamp_ntz"


def test_a_key_with_a_third_of_all_rows(spark):
    n = 6000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("k"), F.timestamp_seconds(F.col("id")).alias("rec"), F.col("id").alias("v"))
    got = first_delivery(df, F.col("k"), "rec", ["v"], "k").where("n_deliveries > 1").collect()
    assert [(r.k, r.v, r.n_deliveries) for r in got] == [(7, 0, n // 3)]
    plan = first_delivery(df, F.col("k"), "rec", ["v"], "k")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_one_set_with_many_intervals(spark):
    e = spark.range(3000).select(F.lit(" ls1 ").alias("id_link_set"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("event_day"), F.format_string("%02d:00", F.col("id") % 23).alias("start_hm"), F.format_string("%02d:30", F.col("id") % 23).alias("end_hm"))
    got = p1_found(e)
    assert got.where("kind = 'period'").count() == 30 * 23 and got.where("kind = 'gap'").count() == 30 * 23 - 1


def test_empty_tables_and_null_columns(spark):
    empty = spark.createDataFrame([], FCD)
    nulls = spark.createDataFrame([(None,) * 9] * 3, FCD).withColumn("group", F.lit(1)).withColumn("block", F.lit(2))
    agg = "id_res bigint, slot_ts timestamp_ntz, id_link bigint, avg_speed double, published_at timestamp_ntz"
    for f in (empty, nulls):
        assert stops_and_trips(f).count() == 0
        assert p4_found(f, spark.createDataFrame([(None,) * 5], agg)).count() == 0
    assert flagged_readings(spark.createDataFrame([], agg)).count() == 0
    raw = "id_fcd string, ts_text string, tz_data string"
    assert p7_found(spark.createDataFrame([("a", None, None)], raw)).count() == 0
    assert p7_found(spark.createDataFrame([("a", "x" * 100_000, None), ("b", "1704110400", None)], raw)).count() == 1
    assert p1_found(spark.createDataFrame([(None, None, None, None)], "id_link_set string, event_day date, start_hm string, end_hm string")).count() == 0


def test_repeated_rows_and_equal_times(spark):
    rows = [(str(i), "v", T0 + timedelta(seconds=60 * (i // 2)), 1, 630_000.0, 4_850_000.0, None, 1, T0) for i in range(40)]
    df = spark.createDataFrame(rows + rows, FCD)
    got = [(r.kind, r.id_fcd_first, r.id_fcd_last, r.n_pings) for r in stops_and_trips(df).collect()]
    assert got == [("stop", 0, 39, 40)]
    readings = spark.createDataFrame([(i, T0 + timedelta(minutes=15 * i), 1, 50.0 + (i == 5) * 60 + i % 2, T0) for i in range(10)] * 2, "id_res bigint, slot_ts timestamp_ntz, id_link bigint, avg_speed double, published_at timestamp_ntz")
    assert [(r.id_res, r.kind) for r in flagged_readings(readings).where("kind <> ''").collect()] == [(5, "spike")]


@pytest.mark.parametrize("partitions", [1, 8, 64, 200])
def test_kernel_calls_left_without_rows(spark, partitions):
    """Around midnight a block may hold nothing but halo rows, and a partition nothing but such a block."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        starts = (T0, T0 + timedelta(hours=12), T0 - timedelta(minutes=10))
        rows = [(str(100 * v + i), f"v{v}", start + timedelta(seconds=60 * i), 1, 630_000.0, 4_850_000.0, None, 1, T0) for v, start in enumerate(starts) for i in range(20)]
        rows.append(("999", "out", T0, 1, 0.0, 0.0, None, 1, T0))  # a vehicle of which nothing is plausible
        df = spark.createDataFrame(rows, FCD)
        got = sorted((r.kind, r.id_veh, r.id_fcd_first, r.id_fcd_last) for r in stops_and_trips(df).collect())
        assert got == [("stop", f"v{v}", 100 * v, 100 * v + 19) for v in range(3)]
        assert [r.id for r in p4_found(df, spark.createDataFrame([], "id_res bigint, slot_ts timestamp_ntz, id_link bigint, avg_speed double, published_at timestamp_ntz")).collect()] == [999]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_no_rows_have_no_spans():
    assert spans(np.zeros(0, int), 0) == [] and spans(np.array([0, 3]), 5) == [(0, 3), (3, 5)]
