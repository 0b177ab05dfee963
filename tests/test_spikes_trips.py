import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from roadloom.operators import spikes
from roadloom.operators.fcd_trips import Rules, build_trips, cut_trips
from roadloom.operators.sequences import DAY_US
from roadloom.operators.spikes import AREA, flagged_pings, implausible_readings, impossible_places, p4_found
from roadloom.operators.trips import fits, islands, stops, stops_and_trips

FCD = "id_fcd string, id_veh string, ts timestamp_ntz, engine tinyint, x double, y double, geometry string, batch bigint, received_at timestamp_ntz, progr float, bad string"
T0 = datetime(2024, 1, 1, 22)
X, Y = 630_000.0, 4_850_000.0


def pings(spark, tracks):
    """tracks: vehicle -> [(seconds, x, y)]"""
    rows, n = [], 0
    for v, track in tracks.items():
        for s, x, y in track:
            n += 1
            t = T0 + timedelta(seconds=s)
            rows.append((str(n), v, t, 1, float(x), float(y), None, 1, t, None, "x"))
    return spark.createDataFrame(rows, FCD)


def reading(v):
    return list(implausible_readings(np.array(v, float), 0, 250, 12, 0.3, 3, 4)[0])


def test_readings():
    assert reading([50, 51, 90, 50, 52, 51]) == ["", "", "spike", "", "", ""]
    assert reading([50, 51, 20, 21, 22, 50, 52]) == ["", "", "spike", "spike", "spike", "", ""]
    assert reading([50, 51, 20, 21, 22, 23, 50, 52]) == [""] * 8
    assert reading([50, -1, 300, 50]) == ["", "bounds", "bounds", ""]
    assert reading([50 + i % 3 for i in range(5)] + [40] * 12 + [52])[5:17] == ["stuck"] * 12
    assert reading([50 + i % 3 for i in range(5)] + [40] * 11 + [52]) == [""] * 17
    assert reading([50, 90, 50, 90, 50]) == ["", "spike", "", "spike", ""]
    assert reading([42, 43, 110, 75, 125, 42, 43])[2:5] == ["spike"] * 3  # of several groupings, the largest
    assert reading([93, 90, 258, 189, 89, 90])[2:4] == ["bounds", "spike"]
    assert reading([]) == [] and reading([5]) == [""]
    assert reading([50, 80, -1, 50]) == ["", "", "bounds", ""]  # a neighbour that is a case itself speaks for nothing


def test_the_filter_decides_which_groups_are_candidates(monkeypatch):
    """The stated rule is the refinement of the Hampel filter's candidates: none is lost, and without the filter's
    median, MAD and score nothing is found."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        v = rng.choice([50.0, 52.0, 55.0, 70.0, 90.0, 120.0, 20.0], size=rng.integers(3, 30))
        n, band = len(v), 0.3 * np.median(v)
        for size in (1, 2, 3):
            stated = [i for i in range(1, n - size) if min(v[i : i + size]) - max(v[i - 1], v[i + size]) > band or min(v[i - 1], v[i + size]) - max(v[i : i + size]) > band]
            if n < size + 2:
                continue
            med, mad, score = spikes.hampel_frames(v, size)
            for i in stated:
                assert score[i - 1] >= 1 / 1.4826 - 1e-9 and med[i - 1] in (v[i - 1], v[i + size])
    frames = spikes.hampel_frames
    spike = [50, 51, 90, 50, 52, 51]
    for broken in (lambda v, k: (*frames(v, k)[:2], frames(v, k)[2] * 0), lambda v, k: (v[1 : len(v) - k], *frames(v, k)[1:])):
        monkeypatch.setattr(spikes, "hampel_frames", broken)
        assert reading(spike) == [""] * 6


def naive_impossible(t, x, y):
    limit, out = 250 / 3.6, set()
    ok = [i for i in range(len(t)) if AREA[0] <= x[i] <= AREA[1] and AREA[2] <= y[i] <= AREA[3]]
    d = lambda i, j: np.hypot(x[i] - x[j], y[i] - y[j]) > limit * (t[j] - t[i])
    out |= set(range(len(t))) - set(ok)
    last, k = None, 0
    while k < len(ok):
        i = ok[k]
        if last is None or not d(last, i):
            last, k = i, k + 1
            continue
        j = next((m for m in range(k + 1, len(ok)) if not d(last, ok[m])), None)
        if j is None:
            last, k = i, k + 1
            continue
        nxt = ok[j]
        for m in range(j - 1, k - 1, -1):
            if d(ok[m], nxt):
                out.add(ok[m])
            else:
                nxt = ok[m]
        last, k = ok[j], j + 1
    return out


def test_impossible_places_random():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(0, 40)
        t = np.cumsum([rng.choice([5, 30, 60, 600]) for _ in range(n)]).astype(float)
        x = X + np.cumsum([rng.uniform(-200, 200) for _ in range(n)])
        y = np.full(n, Y)
        for _ in range(rng.randrange(4)):
            if n:
                i = rng.randrange(n)
                x[i : i + rng.randrange(1, 4)] += rng.choice([20_000, -15_000, 900_000])
        got = set(np.flatnonzero(impossible_places((t * 1e6).astype(np.int64), x, y, np.array([0] if n else [], int), AREA, 250)))
        assert got == naive_impossible(t, x, y)


def test_blocks_make_no_difference(spark):
    rng = random.Random(2)
    tracks = {}
    for v in ("a", "b", "hot"):
        s, x, track = 0, X, []
        for _ in range(1500 if v == "hot" else 300):
            s += rng.choice([6, 30, 60])
            x += rng.uniform(-80, 100) if rng.random() < 0.6 else 0
            track.append((s, x + (25_000 if rng.random() < 0.02 else 0), Y + rng.uniform(-8, 8)))
        tracks[v] = track
    df = pings(spark, tracks)
    whole = sorted(map(tuple, flagged_pings(df, block_us=10_000 * DAY_US).where("bad").select("id").collect()))
    parts = sorted(map(tuple, flagged_pings(df, block_us=3600 * 1_000_000).where("bad").select("id").collect()))
    assert whole == parts and whole
    one = sorted(map(tuple, stops_and_trips(df, block_us=10_000 * DAY_US).collect()))
    many = sorted(map(tuple, stops_and_trips(df, block_us=1800 * 1_000_000).collect()))
    assert [r[:4] + r[8:] for r in one] == [r[:4] + r[8:] for r in many] and {r[0] for r in one} == {"stop", "trip"}
    assert [r[7] for r in one] == pytest.approx([r[7] for r in many])
    a = sorted(map(tuple, build_trips(df, block_us=10_000 * DAY_US).select("id_trip", "n").collect()))
    b = sorted(map(tuple, build_trips(df, block_us=1800 * 1_000_000).select("id_trip", "n").collect()))
    assert a == b


def test_stop_and_trip_rules(spark):
    still = [(60 * i, X + i % 2 * 20, Y) for i in range(12)]  # 11 minutes
    drive = [(720 + 30 * i, X + 400 * (i + 1), Y) for i in range(6)]
    gap = [(720 + 150 + 1000 + 30 * i, X + 5000 + 400 * i, Y) for i in range(4)]  # too few for a trip
    got = sorted((r.kind, r.id_fcd_first, r.id_fcd_last, r.n_pings) for r in stops_and_trips(pings(spark, {"v": still + drive + gap})).collect())
    assert got == [("stop", 1, 12, 12), ("trip", 13, 18, 6)]
    assert stops_and_trips(pings(spark, {"v": still}).limit(0)).count() == 0
    silent = [(0, X, Y), (5000, X + 30, Y)]
    assert [(r.kind, r.n_pings) for r in stops_and_trips(pings(spark, {"v": silent})).collect()] == [("stop", 2)]


def test_smallest_circle():
    a = np.array([0.0, 119.9]), np.array([0.0, 0.0])
    assert fits(*a, 60) and not fits(np.array([0.0, 120.1]), np.array([0.0, 0.0]), 60)
    tri = 60 * np.cos(np.radians([90, 210, 330])), 60 * np.sin(np.radians([90, 210, 330]))
    assert fits(*tri, 60.0001) and not fits(*tri, 59.99)
    assert stops(np.array([0.0]), np.array([0.0]), np.array([0.0]), 60, 600) == []


def brute_stops_and_trips(track):
    """The stated rules on one vehicle's pings (seconds, x, y), islands cut at steps over 120 m, longest stop first found."""
    t, x, y = (np.array(c, float) for c in zip(*track))
    n, stop_of, i = len(t), np.zeros(len(t), int), 0
    holds = lambda a, b: fits(x[a:b], y[a:b], 60.0)
    runs = [(t[b - 1] - t[a], a, b) for a in range(n) for b in range(a + 1, n + 1) if t[b - 1] - t[a] >= 600 and holds(a, b)]
    out = []
    while True:
        free = [r for r in runs if r[1] >= i]
        if not free:
            break
        first = min(free, key=lambda r: r[1])  # of the stops that overlap, chained, with the first: the longest
        best, end = max((r for r in free if r[1] == first[1]), key=lambda r: r[2]), 0
        while end != best[2]:
            end = best[2]
            best = max([best] + [r for r in free if first[1] <= r[1] < end], key=lambda r: (r[0], -r[1]))
            if best[2] != end:
                continue
        out.append(("stop", best[1], best[2]))
        stop_of[best[1] : best[2]] = len(out)
        i = best[2]
    new = [k for k in range(n) if k == 0 or stop_of[k] != stop_of[k - 1] or (not stop_of[k] and t[k] - t[k - 1] > 900)]
    for a, b in zip(new, [*new[1:], n]):
        if not stop_of[a] and b - a >= 5:
            out.append(("trip", a, b))
    return sorted(out)


def test_stops_and_trips_against_the_rules(spark):
    """Vehicles that drive, creep, stand with noise and fall silent, over midnight: clear stays, whose box a circle
    holds, and unclear ones, blocks of an hour and of a day."""
    rng = random.Random(3)
    tracks = {}
    for v in range(12):
        s, x, y, track = 0, X, Y, []
        while len(track) < 90:
            mode = rng.choice(["drive", "stand", "creep", "shift", "silence"])
            for _ in range(rng.randrange(1, 14)):
                s += 1000 if mode == "silence" and rng.random() < 0.3 else rng.choice([45, 60, 90])
                x += {"drive": 300, "creep": 25, "shift": rng.choice([0, 0, 0, 70])}.get(mode, 0)
                track.append((s, x + rng.uniform(-6, 6), y + rng.uniform(-6, 6)))
        tracks[f"v{v}"] = track
    want, base = [], 0
    for v, track in tracks.items():
        want += [(k, v, base + a + 1, base + b) for k, a, b in brute_stops_and_trips(track)]
        base += len(track)
    for block_us in (DAY_US, 3600 * 1_000_000):
        got = sorted((r.kind, r.id_veh, r.id_fcd_first, r.id_fcd_last) for r in stops_and_trips(pings(spark, tracks), block_us=block_us).collect())
        assert got == sorted(want) and {k for k, *_ in got} == {"stop", "trip"}


def test_islands_of_the_windows(spark):
    """A short stay is merged into the move around it, a long one is a piece; wide ones and the block's edges are unsure."""
    track = [(30 * i, X + 300 * i, Y) for i in range(5)] + [(150 + 60 * i, X + 1500 + 5 * (i % 2), Y) for i in range(3)] + [(330 + 30 * i, X + 1900 + 300 * i, Y) for i in range(4)]
    track += [(480 + 100 * i, X + 4000 + 10 * (i % 2), Y) for i in range(9)] + [(1400 + 30 * i, X + 4300 + 300 * i, Y) for i in range(3)]
    rows = flagged_pings(pings(spark, {"v": track}), block_us=2 * DAY_US).where("not bad").drop("bad")
    got = islands(rows, 60.0, 600.0, 900.0).orderBy("t").collect()
    pieces = list(dict.fromkeys((r.nth, r.silences, r.stay) for r in got))
    assert [pieces.index((r.nth, r.silences, r.stay)) for r in got] == [0] + [1] * 11 + [2] * 9 + [3] * 2 + [4]
    assert [r.id for r in got if r.stay] == [1, *range(13, 22), 24] and [r.id for r in got if r.unsure] == [1, 24]


def test_p4_found_columns(spark):
    track = [(60 * i, X + 100 * i, Y) for i in range(6)]
    track[3] = (180, X + 30_000, Y)
    agg = spark.createDataFrame([(i, T0 + timedelta(minutes=15 * i), 1, v, None) for i, v in enumerate([50.0, 51.0, 99.0, 50.0, 49.0, None])], "id_res bigint, slot_ts timestamp_ntz, id_link bigint, avg_speed double, published_at timestamp_ntz")
    got = sorted(map(tuple, p4_found(pings(spark, {"v": track}), agg.unionByName(agg)).collect()))
    assert got == [("agg", 2), ("fcd", 4)]


def test_trip_recorder_rules():
    nan = float("nan")

    def cut(rows):
        t, x, engine, odo = (np.array(c, float) for c in zip(*rows))
        return cut_trips(t, x, np.zeros(len(t)), engine, odo, Rules())

    base = [(30 * i, 300 * i, 1, nan) for i in range(5)]
    assert cut(base) == [[0, 1, 2, 3, 4]]
    assert cut(base + [(120, 1200, 1, nan), (150, 1200, 1, nan)]) == [[0, 1, 2, 3, 4]]  # same time, same place
    assert cut(base + [(2000 + 30 * i, 9000 + 300 * i, 1, nan) for i in range(3)]) == [[0, 1, 2, 3, 4], [5, 6, 7]]  # silence
    assert cut([(t, x, 0 if i == 2 else 1, o) for i, (t, x, _, o) in enumerate(base)]) == [[0, 1], [2, 3, 4]]  # switched on
    assert cut([(t, x, 2 if i == 2 else 1, o) for i, (t, x, _, o) in enumerate(base)]) == [[0, 1, 2], [3, 4]]  # switched off
    assert cut([(t, x, 1, 1000 - x if i > 2 else x) for i, (t, x, _, _) in enumerate(base)])[0] == [0, 1, 2]  # odometer falls
    spike = [(t, x + (50_000 if i == 2 else 0), e, o) for i, (t, x, e, o) in enumerate(base)]
    assert cut(spike) == [[0, 1, 3, 4]]
    assert cut(base[:1]) == [] and cut([(0, 0, 1, nan), (30, 50, 1, nan)]) == []  # too short
    # a stop of 700 s from 1000 s on, seen by the sliding anchor; the trip ends before the anchor
    stop = [(20 * i, 200 * min(i, 50) + (i > 85) * 200 * (i - 85) + i % 2, 1, nan) for i in range(130)]
    first, second = cut(stop)
    assert 48 <= first[-1] <= 52 and 80 <= second[0] <= 86 and second[-1] == 129
    long = [(20 * i, 200 * min(i, 50) + (i > 100) * 200 * (i - 100) + i % 2, 1, nan) for i in range(150)]  # 1000 s: nothing of it is left in the first trip
    assert cut(long)[0][-1] <= 52
    stand = [(30 * i, 10 * (i % 2) + 300 * max(0, min(i - 5, 5)), 1, nan) for i in range(16)]
    t, x, engine, odo = (np.array(c, float) for c in zip(*stand))
    assert cut_trips(t, x, 0 * x, engine, odo, Rules(trim=True)) == [[5, 6, 7, 8, 9, 10]] and len(cut_trips(t, x, 0 * x, engine, odo, Rules())[0]) == 16


def test_truncated_tail(spark):
    df = pings(spark, {"a": [(30 * i, X + 300 * i, Y) for i in range(10)], "b": [(4000 + 30 * i, X + 300 * i, Y) for i in range(10)]})
    end = T0 + timedelta(seconds=4400)
    assert {r.id_veh: r.truncated for r in build_trips(df, until=end).collect()} == {"a": False, "b": True}
    assert not any(r.truncated for r in build_trips(df).collect())
