import time
from datetime import datetime, timedelta

from roadloom.operators.fcd_trips import build_trips
from roadloom.streaming import fcd as R

T0 = datetime(2024, 1, 1, 8)
SCHEMA = "id_fcd string, id_veh string, ts timestamp_ntz, engine tinyint, speed float, heading float, progr float, x double, y double, geometry string, batch bigint, received_at timestamp_ntz"


def rows():
    out, n = [], 0
    for v, starts in (("a", (0, 4000, 9000)), ("b", (100, 6000))):
        for s in starts:
            for i in range(20):
                n += 1
                t = T0 + timedelta(seconds=s + 30 * i)
                out.append((str(n), v, t, 1, 36.0, 90.0, None, 300.0 * i, 0.0, None, 1, t))
    return sorted(out, key=lambda r: r[2])


def test_stream_equals_batch(spark, tmp_path):
    data = rows()
    folder = tmp_path / "in"
    for k in range(0, len(data), 17):  # trips cross the files
        part = data[k : k + 17]
        spark.createDataFrame(part + part[:2], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"{k:04}"))
    end = [("9999", "z", T0 + timedelta(days=1), 1, 1.0, 1.0, None, 0.0, 0.0, None, 1, T0)]
    spark.createDataFrame(end, SCHEMA).coalesce(1).write.parquet(str(folder / "9999"))
    schema = spark.createDataFrame(data, SCHEMA).schema
    stream = lambda: R.pings(spark, f"{folder}/*", schema)
    got = sorted((r.id_veh, r.id_trip, r.id_last, r.n, round(r.dist)) for r in R.run_available(R.streamed_trips(stream()), str(tmp_path / "trips")).collect())
    batch = sorted((r.id_veh, r.id_trip, r.ids[-1], r.n, round(r.dist)) for r in build_trips(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == batch and len(got) == 5
    speeds = R.run_available(R.slice_speeds(stream()), str(tmp_path / "speeds")).collect()
    assert sum(r.n for r in speeds) == 100 and {r.speed for r in speeds} == {36.0}  # repeated pings count once
    assert R.run_available(R.gap_sessions(stream()), str(tmp_path / "sessions")).count() == 5


def test_sink_replaces_a_repeated_batch(spark, tmp_path):
    write = R.by_batch(str(tmp_path), "2024-01-01")
    df = spark.createDataFrame([(T0, 1), (datetime(2023, 1, 1), 2)], "ts timestamp, v int")
    write(df, 3)
    write(df, 3)
    assert spark.read.parquet(str(tmp_path)).count() == 1


def test_late_pings_make_no_trips_beside_those_sent_out(spark, tmp_path):
    """Ten pings that come after a later trip was sent out, and a vehicle that is never silent but switched off and on."""
    ping = lambda n, v, s, engine=1: (str(n), v, T0 + timedelta(seconds=s), engine, 36.0, 90.0, None, 10.0 * (s % 3600), 0.0, None, 1, T0)
    first = [ping(i, "a", 20_000 + 30 * i) for i in range(20)] + [ping(1000 + i, "c", 30 * i, 0 if i % 100 == 0 else 1) for i in range(1200)]
    parts = [first, [ping(900, "z", 40_000)], [ping(200 + i, "a", 19_000 + 30 * i) for i in range(10)] + [ping(901, "z", 40_030)], [ping(902, "z", 90_000)], [ping(903, "z", 180_000)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        time.sleep(1.1)
    got = R.run_available(R.streamed_trips(R.pings(spark, f"{tmp_path}/in/*", spark.createDataFrame(first, SCHEMA).schema)), str(tmp_path / "out")).collect()
    mine = sorted((r.dt_o, r.dt_d, r.n) for r in got if r.id_veh == "a")
    assert [m[2] for m in mine] == [20] and sum(r.n for r in got if r.id_veh == "c") > 1100
    assert sorted(r.id_trip for r in got if r.id_veh == "c") == [1000 + 100 * k for k in range(12)]
