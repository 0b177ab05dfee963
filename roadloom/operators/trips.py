"""Stops and trips from location pings.

Order of work: impossible places out (spikes.flagged_pings); SQL windows over blocks of a vehicle's time give each ping
its lagged distance and speed; hysteresis and gaps in time cut the pings into islands; short stays are merged into the
moves around them; pieces are joined over the blocks' edges; only stays that a circle may or may not hold are searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.operators.sequences import DAY_US
from roadloom.operators.spikes import AREA, MAX_KMH, flagged_pings


def fits(x: np.ndarray, y: np.ndarray, radius: float) -> bool:
    """Whether all points lie within radius of one place (that of their smallest enclosing circle)."""
    lo, hi, ylo, yhi = x.min(), x.max(), y.min(), y.max()
    if max(hi - lo, yhi - ylo) > 2 * radius:
        return False
    for cx, cy in (((lo + hi) / 2, (ylo + yhi) / 2), (x.mean(), y.mean())):
        if ((x - cx) ** 2 + (y - cy) ** 2).max() <= radius * radius:
            return True
    u = np.unique(np.stack([x, y], 1), axis=0)
    return _circle(u, u[:1])[1] <= radius * radius * (1 + 1e-12)


def _circle(u: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and squared radius of the smallest enclosing circle, by growing the set of points on its edge: solve it
    exactly, add the farthest point outside, repeat."""
    support = edge
    while True:
        c, r2, support = _small(support)
        d = ((u - c) ** 2).sum(1)
        k = int(d.argmax())
        if d[k] <= r2 * (1 + 1e-12) + 1e-12:
            return c, r2
        support = np.vstack([support, u[k]])


def _small(s: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Smallest enclosing circle of at most four points, and the points on it."""
    best = None
    n = len(s)
    if n == 1:
        return s[0], 0.0, s
    sets = [(i, j) for i in range(n) for j in range(i)] + [(i, j, k) for i in range(n) for j in range(i) for k in range(j)]
    for idx in sets:
        p = s[list(idx)]
        if len(idx) == 2:
            c = p.mean(0)
        else:
            m = 2 * (p[1:] - p[0])
            det = m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
            if abs(det) < 1e-9:
                continue
            q = ((p[1:] - p[0]) ** 2).sum(1)
            c = p[0] + np.array([q[0] * m[1, 1] - q[1] * m[0, 1], m[0, 0] * q[1] - m[1, 0] * q[0]]) / det
        r2 = ((p - c) ** 2).sum(1).max()
        if ((s - c) ** 2).sum(1).max() <= r2 * (1 + 1e-9) + 1e-9 and (best is None or r2 < best[1]):
            best = (c, r2, p)
    return best


def _until(x: np.ndarray, y: np.ndarray, i: int, end: int, within) -> int:
    """The largest j <= end for which within(i, j) holds, by doubling and halving; within must be monotone."""
    good, step = i + 1, 1
    while good < end:
        j = min(end, good + step)
        if not within(i, j):
            bad = j
            break
        good, step = j, step * 2
    else:
        return end
    while bad - good > 1:
        mid = (good + bad) // 2
        if within(i, mid):
            good = mid
        else:
            bad = mid
    return good


def stops(t: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, least_s: float) -> list[tuple[int, int]]:
    """Maximal runs [i, j) of one sequence within radius of one place and lasting least_s, t in seconds.

    Only islands without a step over 2 * radius that last long enough are searched. Where runs overlap, the one lasting
    longest is taken.
    """
    n = len(t)
    cut = np.flatnonzero(np.r_[True, np.hypot(np.diff(x), np.diff(y)) > 2 * radius]) if n else np.zeros(0, int)
    out = []
    within = lambda a, b: fits(x[a:b], y[a:b], radius)
    for i, end in zip(cut, np.r_[cut[1:], n], strict=True):
        while i < end and t[end - 1] - t[i] >= least_s:
            late = i + int(np.searchsorted(t[i:end], t[i] + least_s))  # the run must reach this ping
            if max(np.ptp(x[i : late + 1]), np.ptp(y[i : late + 1])) > 2 * radius or not within(i, late + 1):
                i += 1
                continue
            j = _until(x, y, i, end, within)
            best, k, e = (t[j - 1] - t[i], i, j), i, j
            while e < end:  # a later start may reach further: the first that takes in ping e, found by halving
                low, k = k, e
                while k - low > 1:
                    mid = (low + k) // 2
                    low, k = (low, mid) if within(mid, e + 1) else (mid, k)
                if k >= j or t[end - 1] - t[k] <= best[0]:
                    break
                e = _until(x, y, k, end, within)
                best = max(best, (t[e - 1] - t[k], k, e), key=lambda r: r[0])
            out.append((int(best[1]), int(best[2])))
            i = best[2]
    return out


PIECE = "id_veh string, kind string, head struct<t:bigint,id:bigint,x:double,y:double>, tail struct<t:bigint,id:bigint,x:double,y:double>, n bigint, dist double, top double"


def islands(rows: DataFrame, radius: float, stop_s: float, gap_s: float) -> DataFrame:
    """Pings (id_veh, block, id, t, x, y) with `step`, `speed`, and whether each lies in a `stay` (else in a move), at the
    `first` or `last` edge of its block, and in an `unsure` stay. A piece is what agrees in `stay`, the number of stays
    begun before it (`nth`) and that of silences in moves (`silences`).

    Hysteresis: a stay ends with one step over 2 * radius, as no place has both ends within radius; a moving vehicle
    stays again only after stop_s without such a step. Stays shorter than that are merged into the move around them,
    unless they lie at an edge of the block and may go on beyond it. Moves are cut at silences over gap_s, stays aren't.
    A stay is sure if the circle round its box has at most the radius.
    """
    day = ["id_veh", "block"]
    by_time = W.partitionBy(*day).orderBy("t", "id")
    back = lambda c: F.col(c) - F.lag(c).over(by_time)
    rows = rows.withColumns({"step": F.hypot(back("x"), back("y")), "dt": back("t") / 1e6, "ends": F.lead("t").over(by_time).isNull()})
    rows = rows.withColumns({"speed": F.try_divide("step", "dt"), "leaves": F.coalesce(F.col("step") > 2 * radius, F.lit(True))})
    so_far = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("island", F.sum(F.col("leaves").cast("int")).over(so_far(by_time)))
    # islands follow each other in time, so one more sort of the same partitions serves what follows
    whole = W.partitionBy(*day, "island").orderBy("t", "id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    span = lambda c: F.max(c).over(whole) - F.min(c).over(whole)
    rows = rows.withColumns({"lasts": span("t"), "wide": F.hypot(span("x"), span("y")), "first": F.col("island") == 1, "last": F.max("ends").over(whole)})
    edge = F.col("first") | F.col("last")
    rows = rows.withColumn("stay", edge | (F.col("lasts") >= F.lit(int(stop_s * 1e6))))
    rows = rows.withColumn("unsure", edge | F.col("stay") & (F.col("wide") > 2 * radius))
    count = lambda c: F.sum(c.cast("int")).over(so_far(W.partitionBy(*day).orderBy("island", "t", "id")))
    return rows.withColumns({"nth": count(F.col("leaves") & F.col("stay")), "silences": count(~F.col("stay") & F.coalesce(F.col("dt") > gap_s, F.lit(False)))})


def _resolve(radius: float, stop_s: float, gap_s: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces as they are, but a stay with pings is searched for the runs that a circle holds; what lies between them
    is moves, cut at silences."""
    ping = pa.struct([("t", pa.int64()), ("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])
    schema = pa.schema([("id_veh", pa.string()), ("kind", pa.string()), ("head", ping), ("tail", ping), ("n", pa.int64()), ("dist", pa.float64()), ("top", pa.float64())])

    def searched(veh: str, pings: pa.StructArray) -> list[tuple]:
        t, ids, x, y = (pings.field(c).to_numpy(zero_copy_only=False) for c in ("t", "id", "x", "y"))
        s = t / 1e6
        stop_of = np.zeros(len(t), np.int64)
        for k, (i, j) in enumerate(stops(s, x, y, radius, stop_s), 1):
            stop_of[i:j] = k
        new = np.r_[True, (np.diff(stop_of) != 0) | (stop_of[1:] == 0) & (np.diff(s) > gap_s)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(t)] - 1
        step = np.r_[0.0, np.hypot(np.diff(x), np.diff(y))]
        speed = np.r_[0.0, step[1:] / np.maximum(np.diff(s), 1e-6)]
        at = lambda i: {"t": int(t[i]), "id": int(ids[i]), "x": float(x[i]), "y": float(y[i])}
        return [(veh, "stop" if stop_of[a] else "trip", at(a), at(b), int(b - a + 1), float(step[a + 1 : b + 1].sum()), float(speed[a + 1 : b + 1].max(initial=0.0))) for a, b in zip(first, last, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column("pings").is_valid()
            yield from pa.Table.from_batches([b.filter(pc.invert(there))]).select(schema.names).cast(schema).to_batches()
            hard = b.filter(there)
            for k in range(hard.num_rows):
                found = searched(hard.column("id_veh")[k].as_py(), hard.column("pings")[k].values)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return run


def stops_and_trips(fcd: DataFrame, radius: float = 60.0, stop_s: float = 600.0, least_pings: int = 5, gap_s: float = 900.0, area: tuple = AREA, max_kmh: float = MAX_KMH, block_us: int = DAY_US) -> DataFrame:
    """(kind, id_veh, id_fcd_first, id_fcd_last, ts_first, ts_last, duration_s, distance_m, n_pings, top_kmh), kind stop
    or trip.

    A vehicle's sequence is cut into blocks of time, so a hot vehicle is spread over tasks; from there on a piece is one
    row: a move, or a stay, which keeps its pings only while it is unsure or lies at its block's edge. Pieces are joined
    over the edges, stays that are still unsure are searched, and moves that follow each other within gap_s are trips.
    The top speed is that of the steps to the run's pings, for a trip also of the one out of the stop before it.
    Equal times are in order of id; rows without id, vehicle, time or place are left aside; an empty table gives no rows.
    """
    rows = islands(flagged_pings(fcd, area, max_kmh, block_us).where("not bad").drop("bad"), radius, stop_s, gap_s)
    ping = F.struct("t", "id", "x", "y")
    within = F.when(~F.col("leaves") | ~F.col("stay") & (F.col("dt") <= gap_s), F.col("speed"))
    pieces = rows.groupBy("id_veh", "block", "nth", "silences", "stay").agg(
        F.min(F.struct("t", "id", "x", "y", "step")).alias("head"), F.max(ping).alias("tail"), F.count(F.lit(1)).alias("n"), F.sum("step").alias("dist"), F.coalesce(F.max(within), F.lit(0.0)).alias("top"),
        F.max(F.col("stay") & F.col("first")).alias("first"), F.max(F.col("stay") & F.col("last")).alias("last"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.array_sort(F.collect_list(F.when(F.col("unsure"), ping))).alias("pings"),
    )
    pieces = pieces.withColumns({"dist": F.coalesce(F.col("dist") - F.coalesce("head.step", F.lit(0.0)), F.lit(0.0)), "head": F.struct(*[F.col(f"head.{c}").alias(c) for c in ("t", "id", "x", "y")])})
    order = W.partitionBy("id_veh").orderBy("head.t", "head.id")
    step = F.hypot(F.col("head.x") - F.lag("tail.x").over(order), F.col("head.y") - F.lag("tail.y").over(order))
    goes_on = F.coalesce(F.col("first") & F.lag("last").over(order) & (F.lag("block").over(order) < F.col("block")) & (step <= 2 * radius), F.lit(False))
    pieces = pieces.withColumns({"step": step, "goes_on": goes_on, "speed": F.try_divide(step, (F.col("head.t") - F.lag("tail.t").over(order)) / 1e6)})
    linked = lambda c: F.when(F.col(c), 0).otherwise(1)
    pieces = pieces.withColumn("chain", F.sum(linked("goes_on")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    plus = lambda c: F.when(F.col(c), F.col("step")).otherwise(0.0)
    fast = lambda c: F.when(F.col(c), F.col("speed"))
    chains = pieces.groupBy("id_veh", "chain").agg(
        F.min("head").alias("head"), F.max("tail").alias("tail"), F.sum("n").alias("n"), F.sum(F.col("dist") + plus("goes_on")).alias("dist"), F.greatest(F.max("top"), F.max(fast("goes_on"))).alias("top"),
        (F.max("stay") & (F.max("tail.t") - F.min("head.t") >= F.lit(int(stop_s * 1e6)))).alias("stay"), (F.hypot(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")) > 2 * radius).alias("wide"), F.flatten(F.array_sort(F.collect_list("pings"))).alias("pings"),
    )
    kind = F.when(F.col("stay"), "stop").otherwise("trip")
    parts = chains.select("id_veh", kind.alias("kind"), "head", "tail", "n", "dist", "top", F.when(F.col("stay") & F.col("wide"), F.col("pings")).alias("pings"))
    parts = parts.mapInArrow(_resolve(radius, stop_s, gap_s), PIECE)
    follows = (F.col("kind") == "trip") & (F.lag("kind").over(order) == "trip") & (F.col("head.t") - F.lag("tail.t").over(order) <= F.lit(int(gap_s * 1e6)))
    parts = parts.withColumns({"step": step, "speed": F.try_divide(step, (F.col("head.t") - F.lag("tail.t").over(order)) / 1e6), "follows": F.coalesce(follows, F.lit(False))})
    parts = parts.withColumn("run", F.sum(linked("follows")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = parts.groupBy("id_veh", "run", "kind").agg(F.min("head").alias("head"), F.max("tail").alias("tail"), F.sum("n").alias("n_pings"), F.sum(F.col("dist") + plus("follows")).alias("distance_m"), F.greatest(F.max("top"), F.max(fast("follows"))).alias("top"))
    whole = whole.where((F.col("kind") == "stop") | (F.col("n_pings") >= least_pings))
    moment = lambda c: F.timestamp_micros(F.col(f"{c}.t"))
    return whole.select("kind", "id_veh", F.col("head.id").alias("id_fcd_first"), F.col("tail.id").alias("id_fcd_last"), moment("head").alias("ts_first"), moment("tail").alias("ts_last"), ((F.col("tail.t") - F.col("head.t")) / 1e6).alias("duration_s"), "distance_m", "n_pings", (F.col("top") * 3.6).alias("top_kmh"))
