"""Registered queries do the whole job: over small tables of their own."""

from datetime import timedelta

import numpy as np
import pytest

from roadloom.operators.fcd_trips import build_trips
from roadloom.operators.trips import stops
from roadloom.plans import model_queries as Q
from tests.test_engine import costs_by_link
from tests.test_streaming import SCHEMA, T0


def road(n):
    """Links of 4 minutes there and back along n nodes."""
    rows = [(2 * k + back, k + back, k + 1 - back, 30.0, False, 2.0, None, None, 800.0, 2.0, None, f"LINESTRING ({(k + back) * 2000} 0, {(k + 1 - back) * 2000} 0)") for k in range(n - 1) for back in (0, 1)]
    return rows, "id bigint, from_node bigint, to_node bigint, v0 float, connector boolean, lanes float, alpha float, rcr float, capacity float, length float, modes array<string>, geometry string"


def test_relaxed_costs_has_every_source_and_no_cap(spark, tmp_path):
    spark.createDataFrame(*road(5)).write.parquet(f"{tmp_path}/links.parquet")
    got = {(r.source, r.id_link): r.cost for r in Q.QUERIES["relaxed_costs"](spark, str(tmp_path)).collect()}
    links, turns = Q._network(spark, str(tmp_path))
    rows, pairs = links.collect(), [(r.in_link, r.out_link, r.penalty) for r in turns.where("penalty < double('infinity')").collect()]
    assert got == pytest.approx({(s, k): c for s in range(5) for k, c in costs_by_link(rows, pairs, s).items()})
    assert max(got.values()) > 10


def test_od_estimate_goes_on_until_the_aim_is_least(spark, tmp_path):
    spark.createDataFrame(*road(5)).write.parquet(f"{tmp_path}/links.parquet")
    box = lambda x: f"POLYGON (({x} -10, {x + 20} -10, {x + 20} 10, {x} 10, {x} -10))"
    spark.createDataFrame([(k, box(2000 * k + 990)) for k in range(4)], "id bigint, geometry string").write.parquet(f"{tmp_path}/zones.parquet")
    od = [(0, 1)] * 2 + [(0, 3)] * 6 + [(2, 3)] * 5
    spark.createDataFrame([(k, *p) for k, p in enumerate(od)], "id_trip bigint, id_zone_o bigint, id_zone_d bigint").write.parquet(f"{tmp_path}/trips.parquet")
    got = {(r.o, r.d): r.value for r in Q.QUERIES["od_estimate"](spark, str(tmp_path)).collect()}
    pairs = sorted(set(od))
    prior = np.array([25.0 * od.count(p) for p in pairs])
    m = np.array([[float(o <= k < d) for o, d in pairs] for k in range(3)])
    aim = lambda g: 0.5 * ((g - prior) ** 2).sum() + 0.5 * ((m @ g - 1.2 * m @ prior) ** 2).sum()
    least = aim(np.linalg.solve(np.eye(3) + m.T @ m, prior + 1.2 * m.T @ m @ prior))
    assert sorted(got) == pairs and aim(np.array([got[p] for p in pairs])) == pytest.approx(least, rel=1e-3)


def test_streams_keep_late_pings_and_the_open_end(spark, tmp_path):
    data = [(str(1000 * v + i), f"v{v}", T0 + timedelta(seconds=30 * i + 4000 * (i // 40)), 1, 36.0, 90.0, None, 300.0 * i, 0.0, None, 1, T0) for v in range(2) for i in range(240)]
    late = [r for r in data if int(r[0]) % 7 == 3]  # come last, hours behind
    rest = sorted((r for r in data if r not in late), key=lambda r: r[2])
    files = [rest[k : k + 40] for k in range(0, len(rest), 40)] + [late[:20], late[20:]]
    assert len(files) > 8
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/fcd.parquet")
    run = lambda q: Q.QUERIES[q](spark, str(tmp_path)).collect()
    assert sum(r.n for r in run("stream_slice_speeds")) == 480
    sessions = run("stream_sessions")
    assert len(sessions) == 12 and sum(r.n for r in sessions) == 480
    batch = sorted((r.id_veh, r.id_trip, r.ids[-1], r.n, round(r.dist)) for r in build_trips(spark.read.parquet(f"{tmp_path}/fcd.parquet")).collect())
    assert sorted((r.id_veh, r.id_trip, r.id_last, r.n, round(r.dist)) for r in run("stream_trips")) == batch and len(batch) == 12


def test_a_longer_stop_that_begins_long_after_the_first_is_found():
    t = np.arange(101) * 60.0
    x = np.where(t <= 660, 0.0, np.where(t <= 1200, 60.0, 130.0))
    assert stops(t, x, 0 * x, 60.0, 600.0) == [(12, 101)]
