import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import config
from roadloom.functions.wkb import along, decode, encode_line, merged, parse
from roadloom.operators import network as N
from roadloom.operators import paths as T
from roadloom.operators.reconstruct import rebuilt
from roadloom.plans import ops
from roadloom.sources.catalog import between
from tests.test_engine import grid_links


def test_config_layers():
    assert config.merged({"a": {"b": 1}}, {"a": {"b": 2, "c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4}
    assert config.overridden({"a": {"b": 1}}, ["a:b=2", "x:y=text"]) == {"a": {"b": 2}, "x": {"y": "text"}}
    assert config.resolved({"root": "/d", "in": {"path": "{root}/{name}.csv"}, "name": "t", "l": ["{in.path}", "{unknown}"]}) == {"root": "/d", "in": {"path": "/d/t.csv"}, "name": "t", "l": ["/d/t.csv", "{unknown}"]}
    assert config.setting("NOT_SET", 5) == 5


def test_wkb(spark):
    line = struct.pack("<BII", 1, 2, 2) + np.array([0, 0, 3, 4], "<f8").tobytes()
    polygon = struct.pack(">BIII", 0, 3, 1, 4) + np.array([0, 0, 1, 0, 1, 1, 0, 0], ">f8").tobytes()
    many = struct.pack("<BII", 1, 5, 2) + line + line
    high = struct.pack("<BIId", 1, 0x80000001 | 0x20000000, 4326, 1.0) + np.array([2, 3], "<f8").tobytes()
    assert parse(line)[1][0].tolist() == [[0, 0], [3, 4]] and len(parse(many)[1]) == 2 and parse(polygon)[0] == "Polygon" and parse(high)[1][0].tolist() == [[1, 2]]
    df = spark.createDataFrame([(bytearray(line),), (bytearray(b"bad"),), (None,)], "g binary")
    got = [r[0] for r in df.select(decode("g").alias("d")).select("d.kind").collect()]
    assert got == ["LineString", None, None]
    xy = "array<struct<x:double,y:double>>"
    ls = spark.createDataFrame([([(0.0, 0.0), (3.0, 4.0), (3.0, 14.0)],), ([(1.0, 1.0)],), (None,)], f"xy {xy}")
    assert [r[0] for r in ls.select(decode(encode_line("xy")).alias("d")).select(F.size(F.col("d.parts")[0])).collect()][0] == 3
    assert [tuple(r[0]) if r[0] else None for r in ls.select(along(F.col("xy"), F.lit(10.0))).collect()] == [(3.0, 9.0), (1.0, 1.0), None]
    two = spark.createDataFrame([([[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 0.0)]],)], f"l array<{xy}>")
    assert len(two.select(merged(F.col("l"))).first()[0]) == 3


def test_network_helpers(spark):
    m = spark.createDataFrame([(1, None), (2, []), (3, ["all"]), (4, ["c"]), (5, ["none"]), (6, ["h"])], "id int, modes array<string>")
    assert sorted(r.id for r in N.allowed(m, "c").collect()) == [1, 2, 3, 4]
    t = spark.createDataFrame([(" a, b,a,,",), (" ",), (None,)], "t string")
    assert [r[0] for r in t.select(N.parsed_set(F.col("t"))).collect()] == [["a", "b"], None, None]
    p = spark.createDataFrame([(1, [1, 3, 1]), (2, [3])], "path int, links array<bigint>")
    assert tuple(N.path_counters(p, 1).first()) == (4, 1, 2, 2)
    links = grid_links(spark)
    first = links.where("from_node = 0 and to_node = 1").first().id
    second = links.where("from_node = 1 and to_node = 2").first().id
    xy = N.path_geometry(spark.createDataFrame([(7, [first, second])], "path int, links array<bigint>"), links).first().xy
    assert [(q.x, q.y) for q in xy] == [(0, 0), (0, 100), (0, 200)]
    s = spark.createDataFrame([(1, 2, 5.0, 1), (1, 1, 4.0, 2), (2, 1, 3.0, 0)], "id_link int, slice int, speed double, n int")
    assert [tuple(r) for r in N.sparse_speeds(s).collect()] == [(1, [1, 2], [4.0, 5.0])]
    ts = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 01:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert between(ts, "ts", "2024-01-01 00:00:00", "2024-01-01 01:00:00").count() == 1


def test_rebuilt_path_follows_the_trip(spark):
    links = grid_links(spark)
    g = T.graph(links.withColumn("minutes", F.array("t0")), N.adjacency(links))
    shapes = {r.id: np.array([(v.x, v.y) for v in r.v]) for r in links.select("id", N.vertices(F.col("geometry")).alias("v")).collect()}
    trips = spark.createDataFrame([(1, [(2.0, 3.0), (4.0, 120.0), (1.0, 205.0), (98.0, 202.0)]), (2, [(0.0, 0.0)]), (3, None), (4, [(9e5, 0.0), (9e5, 9.0)])], "id_trip bigint, xy array<struct<x:double,y:double>>")
    got = rebuilt(trips, g, shapes, 60.0).collect()
    assert [r.id_trip for r in got] == [1]
    ends = {r.id: (r.from_node, r.to_node) for r in links.collect()}
    assert [ends[i] for i in got[0].links] == [(0, 1), (1, 2), (2, 5)]


def test_operations(spark, tmp_path):
    links = grid_links(spark)
    links.write.parquet(str(tmp_path / "links.parquet"))
    N.adjacency(links).write.parquet(str(tmp_path / "turns.parquet"))
    spark.createDataFrame([(0, 0, 8, 50.0), (1, 2, 6, 20.0)], "t int, source bigint, target bigint, demand double").write.parquet(str(tmp_path / "demand.parquet"))
    params = {"op": "dynamic_assignment", "root": str(tmp_path), "settings": {"slices": 2, "iterations": 2, "k": 2}, "inputs": {k: {"path": "{root}/" + k + ".parquet"} for k in ("links", "turns", "demand")}, "outputs": {"paths": {"path": "{root}/paths.parquet"}}}
    (tmp_path / "p.json").write_text(json.dumps(params))
    out = ops.run(spark, str(tmp_path / "p.json"), options=("settings:iterations=1",), runs=str(tmp_path))
    assert sorted(r.t for r in spark.read.parquet(str(tmp_path / "paths.parquet")).collect()) == [0, 1] and out["statistics"].count() == 2
    with pytest.raises(ValueError):
        ops.run(spark, {"op": "nothing"})
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == ["completed", "pending"]
    old = spark.createDataFrame([(1, 5), (2, 6)], "id_trip int, dt_d int")
    new = spark.createDataFrame([(1, 5), (2, 7), (3, 1)], "id_trip int, dt_d int")
    assert sorted((r.id_trip, r.change) for r in ops.changed_trips(new, old).collect()) == [(2, "changed"), (3, "new")]
    paths = spark.createDataFrame([(1, 2, "weekday", 5, None), (1, 2, "weekday", 20, "c"), (1, 9, "weekday", 5, "c")], "source bigint, target bigint, day_type string, t_start int, mode string")
    seen = ops.observed_paths(paths, "weekday", 0, 15, spark.createDataFrame([("c",), ("h",)], "code string"), spark.createDataFrame([(1,), (2,)], "id bigint"))
    assert sorted(r["mode"] for r in seen.collect()) == ["c", "h"]
