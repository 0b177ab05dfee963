from datetime import datetime, timedelta

from pyspark.sql import functions as F

from roadloom.functions.geo import first_coordinates, number_id
from roadloom.operators.delivery import first_delivery, first_pings

T = datetime(2024, 1, 1)


def at(m):
    return None if m is None else T + timedelta(minutes=m)


def test_first_copy_nulls_and_ties(spark):
    rows = [("1", 5, "b"), (" 1", 2, "a"), ("1.0", None, "c"), (None, 1, "x"), ("2", None, "z"), ("3", 1, "p"), ("3", 1, "q"), ("word", 1, "w")]
    df = spark.createDataFrame([(k, at(m), v) for k, m, v in rows], "key string, rec timestamp, v string").withColumn("n_deliveries", F.lit(0))
    got = {r.id: (r.v, r.n_deliveries) for r in first_delivery(df, number_id(F.col("key")), "rec", ["v"], "id").collect()}
    assert got[1] == ("a", 3) and got[2] == ("z", 1) and got[3][1] == 2 and set(got) == {1, 2, 3}
    again = {r.id: (r.v, r.n_deliveries) for r in first_delivery(df.orderBy(F.desc("v")).repartition(3), number_id(F.col("key")), "rec", ["v"], "id").collect()}
    assert got == again


def test_points(spark):
    texts = ["POINT (1.5 -2)", "point(1.5  -2)", "SRID=6875;POINT(1.5 -2)", "POINT Z (1.5 -2 7)", '{"type": "Point", "coordinates": [1.5, -2]}', "POINT EMPTY", "nonsense", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "g string")
    got = [tuple(r) for r in df.select(*first_coordinates(F.col("g"))).collect()]
    assert got == [(1.5, -2.0)] * 5 + [(None, None)] * 4


def test_first_pings(spark):
    schema = "id_fcd string, id_veh string, ts timestamp_ntz, engine tinyint, x double, y double, geometry string, batch bigint, received_at timestamp_ntz"
    rows = [("7", "v", at(0), 1, 1.0, 2.0, None, 1, at(1)), ("7.0", "v", at(0), 0, 9.0, 9.0, None, 1, at(3)), ("8", "v", None, 1, 1.0, 2.0, None, 1, at(1)), ("8", "v", at(2), 1, 1.0, 2.0, None, 1, at(2)), ("9", "v", at(1), None, None, 2.0, None, 1, at(1)), (None, "v", at(1), 1, 1.0, 1.0, None, 1, at(1)), ("10", "v", at(1), 1, None, None, "POINT (3 4)", 1, at(1)), ("11", "v", at(1), 1, float("nan"), 1.0, None, 1, at(1))]
    got = sorted((r.id, r.x, r.y, r.engine) for r in first_pings(spark.createDataFrame(rows, schema)).collect())
    assert got == [(7, 1.0, 2.0, 1), (10, 3.0, 4.0, 1)]
