"""Trips of vehicles by the rules of a trip recorder: breaks by engine, odometer, silence and slow stretches.

Unlike trips.stops_and_trips, which finds stops by place, this builder decides ping by ping what goes on a trip.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from math import hypot

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.operators.delivery import first_pings
from roadloom.operators.sequences import DAY_US, micros, natural_groups, per_group, spans


@dataclass(frozen=True)
class Rules:
    """Fixed values by default: seconds, metres and metres a second that part trips."""

    silence_s: float = 900.0
    slow_silence_s: float = 300.0
    slow_m_s: float = 0.5556
    max_m_s: float = 69.44
    jump_m: float = 20_000.0
    stop_s: float = 600.0
    stop_m_s: float = 0.1389
    least_m: float = 100.0
    least_s: float = 1.0
    join_m: float = 200.0
    low: float = 5.0
    high: float = 95.0
    reach: float = 1.5
    trim: bool = False
    stop_o_m: float = 50.0
    stop_d_m: float = 50.0


def trimmed(trip: list[int], x: np.ndarray, y: np.ndarray, rules: Rules) -> list[int]:
    """The trip from the last ping in a row near its first place to the first in a row near its last place."""
    far = np.flatnonzero(np.hypot(x[trip] - x[trip[0]], y[trip] - y[trip[0]]) >= rules.stop_o_m)
    trip = trip[max(0, int(far[0]) - 1 if len(far) else len(trip) - 1) :]
    far = np.flatnonzero(np.hypot(x[trip] - x[trip[-1]], y[trip] - y[trip[-1]]) >= rules.stop_d_m)
    return trip[: int(far[-1]) + 2 if len(far) else 1]


def cut_trips(t: np.ndarray, x: np.ndarray, y: np.ndarray, engine: np.ndarray, odo: np.ndarray, rules: Rules) -> list[list[int]]:
    """Indices of the pings of each trip of one vehicle, in order (see cut_so_far)."""
    trips, _, rest = cut_so_far(t, x, y, engine, odo, rules, len(t))
    return trips + rest


def cut_so_far(t: np.ndarray, x: np.ndarray, y: np.ndarray, engine: np.ndarray, odo: np.ndarray, rules: Rules, upto: int) -> tuple[list[list[int]], int, list[list[int]]]:
    """Of the first `upto` pings of one vehicle, in order: the trips that are over, the first ping of the one still
    open, and that one if it is a trip; t in seconds, odo NaN where unknown. No later ping changes what is over.

    A ping at the time or place of the one before is passed over. A break starts a new trip: engine switched on, or off
    at the ping before; odometer falling or jumping; silence, or a shorter one at walking pace. Else a ping too fast to
    come and to go is dropped. The anchor slides along the trip, stop_s behind: one that a ping reaches from it in more
    than that, but at hardly any speed, means a stop, and cuts the trip before the anchor. With `trim` the pings of a
    trip that stand at its ends are left out.
    """
    trips: list[list[int]] = []
    now: list[int] = []
    far = False
    anchor = 0  # place in now
    prev = -1
    n = len(t)
    ts, xs, ys, on, read = (v.tolist() for v in (t, x, y, engine, odo))  # lists are read faster one by one

    def close() -> None:
        nonlocal now, far, anchor
        trip = now
        if rules.trim and len(trip) > 1:
            trip = trimmed(trip, x, y, rules)
        if far and len(trip) > 2:
            px, py = x[trip], y[trip]
            keep = np.ones(len(trip), bool)
            for v in (px, py):
                lo, hi = np.percentile(v, [rules.low, rules.high])
                keep &= (v >= lo - rules.reach * (hi - lo)) & (v <= hi + rules.reach * (hi - lo))
            trip = [k for k, ok in zip(trip, keep, strict=True) if ok]
        if len(trip) > 1 and t[trip[-1]] - t[trip[0]] >= rules.least_s:
            span = odo[trip[-1]] - odo[trip[0]]
            if np.isnan(span):
                span = float(np.hypot(np.diff(x[trip]), np.diff(y[trip])).sum())
            if span >= rules.least_m:
                trips.append(trip)
        now, far, anchor = [], False, 0

    begun = 0
    for i in range(upto):
        if prev < 0:
            now, prev, begun = [i], i, i
            continue
        dt = ts[i] - ts[prev]
        if dt == 0 or (xs[i] == xs[prev] and ys[i] == ys[prev]):
            continue
        dist = hypot(xs[i] - xs[prev], ys[i] - ys[prev])
        v, d_odo = dist / dt, read[i] - read[prev]
        if on[i] == 0 or on[prev] == 2 or d_odo < 0 or d_odo > rules.jump_m or dt > rules.silence_s or (dt > rules.slow_silence_s and v < rules.slow_m_s):
            close()
            now, prev, begun = [i], i, i
            continue
        if i + 1 < n and ts[i + 1] > ts[i]:
            ahead = hypot(xs[i + 1] - xs[i], ys[i + 1] - ys[i]) / (ts[i + 1] - ts[i])
            if v > rules.max_m_s and ahead > rules.max_m_s:
                continue
            if v > rules.max_m_s >= ahead and len(now) == 1:
                now, prev, begun, anchor = [i], i, i, 0
                continue
        far |= dist > rules.jump_m
        a = now[anchor]
        since = ts[i] - ts[a]
        if since > rules.stop_s:
            if hypot(xs[i] - xs[a], ys[i] - ys[a]) / since < rules.stop_m_s:
                now = now[:anchor]
                close()
                now, prev, begun = [i], i, i
                continue
            while anchor < len(now) and ts[i] - ts[now[anchor]] > rules.stop_s:
                anchor += 1
        now.append(i)
        prev = i
    over = len(trips)
    close()
    return trips[:over], begun, trips[over:]


TRIP = "id_veh string, id_trip bigint, id_last bigint, t_o bigint, t_d bigint, x_o double, y_o double, x_d double, y_d double, n bigint, dist double, avg_speed double, ids array<bigint>"


def fcd_pings(fcd: DataFrame) -> DataFrame:
    """First-received pings with engine and odometer (progr) as the recorder needs them."""
    return first_pings(fcd.withColumn("progr", F.col("progr").cast("double")), ("engine", "progr"))


def trip_rows(tab: pa.Table, starts: np.ndarray, rules: Rules) -> pa.Table:
    t, x, y, ids = (tab[c].to_numpy() for c in ("t", "x", "y", "id"))
    engine = tab["engine"].fill_null(1).to_numpy()
    odo = tab["progr"].to_numpy(zero_copy_only=False).astype(float)
    veh = tab["id_veh"]
    out = []
    for a, b in spans(starts, len(t)):
        for trip in cut_trips(t[a:b] / 1e6, x[a:b], y[a:b], engine[a:b], odo[a:b], rules):
            k = a + np.array(trip)
            d = float(np.hypot(np.diff(x[k]), np.diff(y[k])).sum())
            s = (t[k[-1]] - t[k[0]]) / 1e6
            out.append((veh[int(k[0])].as_py(), int(ids[k[0]]), int(ids[k[-1]]), int(t[k[0]]), int(t[k[-1]]), float(x[k[0]]), float(y[k[0]]), float(x[k[-1]]), float(y[k[-1]]), len(k), d, d / s * 3.6, ids[k].tolist()))
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 4, pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 13, kinds, strict=True)], names=[c.split()[0] for c in TRIP.split(", ")])


def build_trips(fcd: DataFrame, rules: Rules | None = None, block_us: int = DAY_US, until: datetime | None = None) -> DataFrame:
    """(id_trip, id_veh, dt_o, dt_d, n, dist, avg_speed, previous, p_before, x_o, y_o, truncated, ids) of each trip.

    truncated: a vehicle's last trip that ends within silence_s of `until`, the end of the data (none is without it);
    more of it may come, so a caller keeps its pings for the next run.

    A silence over silence_s always parts trips, so blocks of a vehicle's time are cut at their first such silence; a
    hot vehicle is spread over tasks. A trip that begins at most join_m from the end of the one before starts there.
    Equal times are in order of id; rows without id, vehicle, time or place are left aside; no rows give no trips.
    """
    rules = rules or Rules()
    rows = fcd_pings(fcd).select("id_veh", "id", micros(F.col("ts")).alias("t"), "x", "y", "engine", "progr")
    rows = rows.withColumn("block", F.floor(F.col("t") / F.lit(block_us)).cast("int"))
    w = W.partitionBy("id_veh", "block").orderBy("t", "id")
    rows = rows.withColumn("cut", F.coalesce(F.col("t") - F.lag("t").over(w) > F.lit(int(rules.silence_s * 1e6)), F.lit(False)).cast("int"))
    rows = rows.withColumn("head", F.max("cut").over(w) == 0).drop("cut")
    groups = natural_groups(rows, "id_veh")
    trips = per_group(groups.select("id_veh", "group", "id", "t", "x", "y", "engine", "progr"), ["id_veh", "group"], ["t", "id"], lambda tab, starts: trip_rows(tab, starts, rules), TRIP)
    v = W.partitionBy("id_veh").orderBy("t_o", "id_trip")
    near = F.hypot(F.col("x_o") - F.lag("x_d").over(v), F.col("y_o") - F.lag("y_d").over(v)) <= rules.join_m
    trips = trips.withColumns({"near": F.coalesce(near, F.lit(False)), "previous": F.lag("id_trip").over(v), "p_before": (F.col("t_o") - F.lag("t_d").over(v)) / 1e6, "px": F.lag("x_d").over(v), "py": F.lag("y_d").over(v)})
    start = lambda a, b: F.when(F.col("near"), F.col(a)).otherwise(F.col(b))
    end = F.lit(until).cast("timestamp") if until else F.lit(None).cast("timestamp")
    open_end = F.lead("id_trip").over(v).isNull() & (F.col("t_d") > F.unix_micros(end) - F.lit(int(rules.silence_s * 1e6)))
    trips = trips.withColumn("truncated", F.coalesce(open_end, F.lit(False)))
    return trips.select("id_trip", "id_veh", F.timestamp_micros("t_o").cast("timestamp_ntz").alias("dt_o"), F.timestamp_micros("t_d").cast("timestamp_ntz").alias("dt_d"), "n", "dist", "avg_speed", "previous", "p_before", start("px", "x_o").alias("x_o"), start("py", "y_o").alias("y_o"), "truncated", "ids")
