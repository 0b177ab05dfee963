import json
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from roadloom.operators import spatial
from roadloom.operators.spatial import contains, great_circle, near_pairs, p3_found, planar, radius_pairs, region_of, rings


def test_radius_pairs_equal_brute_force():
    rng = np.random.default_rng(5)
    for metric, scale in ((planar, 1000.0), (great_circle, 0.02)):
        q, c = rng.uniform(0, scale, (2, 300)), np.hstack([rng.uniform(0, scale, (2, 700)), np.full((2, 200), scale / 2)])
        r = rng.uniform(0, 60 if metric is planar else 80, 900)
        i, k = radius_pairs(*q, *c, r, metric)
        near = metric(q[0][:, None], q[1][:, None], c[0][None], c[1][None]) <= r[None]
        assert sorted(zip(i.tolist(), k.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(near))))


def test_rings_and_holes():
    square = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    spellings = [square, square.lower().replace(", ", ","), "SRID=6875;" + square, json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}), "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4)), ((20 0, 30 0, 30 10, 20 0)))"]
    for s in spellings:
        found = rings(s)
        p = np.concatenate(found)
        inside = contains(np.array([1.0, 5, 11, 10, 0]), np.array([1.0, 5, 5, 5, 5]), p[:, 0], p[:, 1], np.cumsum([len(f) for f in found]))
        assert inside[:3].tolist() == [True, False, False] and inside[3] != inside[4]
    assert rings(None) == [] and rings("") == [] and rings("{bad") == []


def test_near_pairs_in_cells_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 400
    x, y = rng.uniform(0, 2000, n), rng.uniform(0, 2000, n)
    x[:120], y[:120] = 700 + rng.uniform(0, 80, 120), 700.0  # a dense place
    grp, ent = rng.integers(0, 2, n), rng.integers(0, 30, n)
    df = spark.createDataFrame([(int(g), i, f"v{e}", float(a), float(b), 1) for i, (g, e, a, b) in enumerate(zip(grp, ent, x, y))] + [(0, 9999, None, 1.0, 1.0, 1), (0, 9998, "v", None, 1.0, 1)], "grp int, id bigint, entity string, x double, y double, cell int").drop("cell")
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if grp[i] == grp[j] and ent[i] != ent[j] and np.hypot(x[i] - x[j], y[i] - y[j]) <= 50}
    for hot in (50_000, 20):
        monkeypatch.setattr(spatial, "HOT", hot)
        assert sorted(map(tuple, near_pairs(df, 50.0, pivots=16).collect())) == sorted(want)
    assert near_pairs(df.limit(0), 50.0).count() == 0


def test_p3_found(spark):
    day = datetime(2024, 1, 1, 12)
    fcd = spark.createDataFrame([(str(i), v, day, e, None, None, f"POINT ({x} 5)", 1, day) for i, (v, e, x) in enumerate([("a", 0, 1), ("b", 0, 40), ("a", 0, 3), ("c", 1, 2), ("d", 0, 500)], 1)], "id_fcd string, id_veh string, ts timestamp_ntz, engine tinyint, x double, y double, geometry string, batch bigint, received_at timestamp_ntz")
    zones = spark.createDataFrame([(10, "POLYGON ((0 0, 20 0, 20 10, 0 10, 0 0))"), (11, "polygon((20 0,60 0,60 10,20 10,20 0))"), (12, None), (None, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "id bigint, geometry string")
    trips = spark.createDataFrame([(1, None, 10, "LINESTRING (1 1, 30 5, 2 2)", day), (1, None, 10, "LINESTRING (1 1, 30 5, 2 2)", day), (2, 11, 10, '{"type": "LineString", "coordinates": [[1, 1], [30, 5]]}', day), (3, 10, None, "SRID=1;LINESTRING(1 1, 900 5)", day)], "id_trip bigint, id_zone_o bigint, id_zone_d bigint, geometry string, loaded_at timestamp_ntz")
    got = sorted(map(tuple, p3_found(fcd, trips, zones).collect()))
    assert got == [("ping_near", 1, 2), ("ping_near", 2, 3), ("ping_zone", 1, 10), ("ping_zone", 2, 11), ("ping_zone", 3, 10), ("trip_d", 2, 11), ("trip_o", 1, 10), ("trip_o", 2, 10)]
    assert p3_found(fcd.limit(0), trips.limit(0), zones).count() == 0
    assert region_of(spark.createDataFrame([("t", 1, 1.0, 1.0)], "tag string, qid bigint, x double, y double"), zones.limit(0)).count() == 0


def test_hot_partition_is_copied_whole(spark):
    q = spark.range(30).select(F.lit(1).alias("cell"), F.col("id").alias("qid"))
    c = spark.createDataFrame([(1, 7)], "cell int, cid int")
    spatial_hot, spatial.HOT = spatial.HOT, 10
    try:
        a, b = spatial._split(q, c, ["cell"])
        assert b.count() == 3 and a.count() == 30 and a.select("part").distinct().count() > 1
    finally:
        spatial.HOT = spatial_hot


def test_hot_cells_are_divided_by_their_own_pivots(spark, monkeypatch):
    """Points of one town, in degrees, within one cell: groups of queries become small, and no pair is lost."""
    rng = np.random.default_rng(2)
    n = 500
    lon, lat = 11.0 + rng.uniform(0, 0.05, n), 43.0 + rng.uniform(0, 0.05, n)
    df = spark.createDataFrame([(1, i, f"v{i % 40}", float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))], "grp int, id bigint, entity string, x double, y double")
    d = great_circle(lon[:, None], lat[:, None], lon[None], lat[None])
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if i % 40 != j % 40 and d[i, j] <= 150}
    monkeypatch.setattr(spatial, "HOT", 60)
    assert {tuple(r) for r in near_pairs(df, 150.0, great_circle, pivots=2).collect()} == want and want
    cells = spatial.in_cells(df.withColumn("r", F.lit(150.0)), "x", "y", "r", np.array([[0.0, 0.0]]), great_circle)
    hot = spatial._hot_pivots(cells, ["grp", "cell"], "x", "y", 32)
    parts = spatial._divided(cells, hot, "x", "y", None, great_circle).groupBy("cell", "sub").count().collect()
    assert len(hot[0]) > 10 and len(parts) > 10 and max(p["count"] for p in parts) < 120 and sum(p["count"] for p in parts) == n
    zones = spark.createDataFrame([(k, f"POLYGON (({11 + 0.01 * k} 43, {11.01 + 0.01 * k} 43, {11.01 + 0.01 * k} 43.05, {11 + 0.01 * k} 43.05, {11 + 0.01 * k} 43))") for k in range(5)], "id bigint, geometry string")
    for hot_rows in (50_000, 60):
        monkeypatch.setattr(spatial, "HOT", hot_rows)
        got = {r.qid: r.cid for r in region_of(df.select(F.lit("t").alias("tag"), F.col("id").alias("qid"), "x", "y"), zones, pivots=2).collect()}
        assert got == {i: int((a - 11) // 0.01) for i, a in enumerate(lon)}
