from pyspark.sql import functions as F

from roadloom.functions import scalars as X
from roadloom.operators import attributes as T
from roadloom.operators import network as N
from roadloom.operators.series import repetitions


def test_time_attributes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [10.0, 0.0]), ([5.0], [])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(T.value_at(a, F.lit(31), 15), T.value_at(a, F.lit(999), 15), T.value_at(b, F.lit(0), 15), T.combined(a, b, "+"), T.combined(a, b, "/"), T.combined(b, b, "*"), T.scaled(a, "**", 2.0), T.scaled_at(a, "-", 1.0, 15, 15), T.with_value(a, 15, 15, F.lit(9.0)), T.with_value(a, 75, 15, F.lit(9.0)), T.resized(a, 15, 45, 30, 15)).collect()
    assert tuple(got[0]) == (4.0, 4.0, 10.0, [11.0, 2.0, 4.0], [0.1, None, None], [100.0, 0.0], [1.0, 4.0, 16.0], [1.0, 1.0, 4.0], [1.0, 9.0, 4.0], [1.0, 2.0, 4.0, 4.0, 4.0, 9.0], [2.0, 4.0])
    assert got[1][2] is None and got[1][3] == [None] and got[1][5] == [] and got[1][9] == [5.0] * 5 + [9.0]


def test_lengths_of_time(spark):
    texts = {"8:30": 30_600, "08:30:15": 30_615, "90": 5400, "1.5": 90, "1h 30m": 5400, "PT1H30M": 5400, "2 d": 172_800, "45s": 45, "1 hour 5 min": 3900, "x": None, "": None, "8:3": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.duration_seconds(F.col("t"))).collect()] == list(texts.values())


def test_series_and_their_ends(spark):
    got = spark.range(1).select(*[X.series(F.lit(0), F.lit(6), F.lit(3), k) for k in ("both", "left", "right", "neither")], X.series(F.lit(0), F.lit(7), F.lit(3), "left"), X.series_of(F.lit(0), F.lit(1), 5)).first()
    assert tuple(got) == ([0, 3, 6], [0, 3], [3, 6], [3], [0, 3, 6], [0.0, 0.25, 0.5, 0.75, 1.0])


def test_repetitions_and_checks(spark):
    p = spark.createDataFrame([(1, 1, [1, 2]), (2, 1, [1, 2]), (3, 1, [2]), (4, 2, [1, 2]), (5, 1, None), (6, 1, None)], "path int, source int, links array<int>")
    assert {r.path: r.repetition for r in repetitions(p, ["source"], "links", ["path"]).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
    links = spark.createDataFrame([(1, 10, 11, 0.0)], "id int, from_node int, to_node int, capacity double")
    turns = spark.createDataFrame([(10, 11, 10), (10, 11, 12), (None, 11, 10)], "from_node int, via_node int, to_node int")
    zones = spark.createDataFrame([(10,), (99,)], "id int")
    assert {r.check: r.n for r in N.turn_checks(turns, links, zones).collect()} == {"turn_nodes": 2, "zones_without_node": 1}
    r = spark.createDataFrame([(1, 5.0, 0.0), (1, None, None)], "id_link int, flow double, avg_speed double")
    assert [(x.flow, x.density, x.saturation) for x in N.static_results(r, links, ["id_link"]).collect()] == [(5.0, None, None)]


def test_nodes_take_their_minutes(spark):
    t = spark.createDataFrame([(1, 2, 7, 0.5), (2, 3, 8, 0.0)], "in_link int, out_link int, via int, penalty double")
    n = spark.createDataFrame([(7, 2.0)], "id int, minutes double")
    assert {r.in_link: r.penalty for r in N.with_node_minutes(t, n).collect()} == {1: 2.5, 2: 0.0}
