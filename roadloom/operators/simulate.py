"""Vehicles loaded on a network: first in, first out, with speed by density, capacity, storage, signals and events.

One run is one kernel, as links are shared by all vehicles at each step; Spark spreads runs (scenarios and seeds).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Network:
    """Arrays by link: km, km/h, vehicles an hour, lanes, alpha, critical density; events (link, from, to, speed km/h, 0
    closed) in minutes; signals (link, cycle, green from, green to) in seconds."""

    ids: list[int]
    km: np.ndarray
    v0: np.ndarray
    capacity: np.ndarray
    lanes: np.ndarray
    alpha: np.ndarray
    critical: np.ndarray
    events: list[tuple[int, float, float, float]] = field(default_factory=list)
    signals: dict[int, tuple[float, float, float]] = field(default_factory=dict)


STEP_S, VEHICLE_KM, LEAST_KMH, KEEP = 6.0, 0.007, 5.0, 0.9


def departures(flows: list[tuple[list[list[int]], list[float], list[float]]], slice_minutes: float, seed: int) -> list[tuple[float, list[int]]]:
    """(minute, links) of vehicles of each pair (paths, path flows, demand by slice): demand rounded with its rest
    carried on, departures spread over the slice, paths drawn in proportion to their flow."""
    rng = np.random.default_rng(seed)
    out = []
    for paths, weight, demand in flows:
        rest, w = 0.0, np.asarray(weight, float)
        if not len(paths) or w.sum() <= 0:
            continue
        for k, value in enumerate(demand):
            n = int(np.ceil(value + rest - 0.5))
            rest = value + rest - n
            if n > 0:
                at = np.sort(k * slice_minutes + (np.arange(n) + rng.random(n)) * slice_minutes / n)
                out += [(float(a), paths[p]) for a, p in zip(at, rng.choice(len(paths), n, p=w / w.sum()), strict=True)]
    return sorted(out, key=lambda v: v[0])


def run(net: Network, vehicles: list[tuple[float, list[int]]], minutes: float, slice_minutes: float = 15.0, trace_share: float = 0.0, seed: int = 0) -> tuple[list[tuple], list[tuple], dict[str, int]]:
    """Results by link and slice, traces of a share of the vehicles, and how many entered, left and are on the way.

    A vehicle leaves its link once it has driven it, its link's capacity allows, its signal is green, it heads the
    queue and the next link has room and is open. Speed follows density, smoothed over steps.
    """
    at = {i: k for k, i in enumerate(net.ids)}
    n = len(net.ids)
    queue: list[deque] = [deque() for _ in range(n)]
    storage = np.maximum(1, np.floor(net.km * net.lanes / VEHICLE_KM)).astype(int)
    inside, credit, speed = np.zeros(n, int), np.zeros(n), net.v0.astype(float).copy()
    pending = deque((t, [at[i] for i in links], j) for j, (t, links) in enumerate(vehicles) if all(i in at for i in links) and links)
    waiting: dict[int, deque] = {}
    rng = np.random.default_rng(seed)
    traced = rng.random(len(vehicles)) < trace_share
    results, traces = [], []
    flow_in, flow_out, speeds, density, steps = (np.zeros(n) for _ in range(5))
    count = {"entered": 0, "left": 0}
    n_slice = round(slice_minutes * 60 / STEP_S)

    def enter(k: int, path: list[int], pos: int, j: int, now: float) -> None:
        inside[k] += 1
        flow_in[k] += 1
        queue[k].append((now + net.km[k] / max(speed[k], LEAST_KMH) * 3600, path, pos, j))
        if traced[j]:
            traces.append((j, net.ids[k], now / 60))

    for step in range(int(minutes * 60 / STEP_S)):
        now = step * STEP_S
        limit, shut = net.v0.astype(float).copy(), np.zeros(n, bool)
        for link, a, z, v in net.events:
            if link in at and a <= now / 60 < z:
                shut[at[link]] |= v <= 0
                if v > 0:
                    limit[at[link]] = min(limit[at[link]], v)
        while pending and pending[0][0] * 60 <= now:
            _, path, j = pending.popleft()
            waiting.setdefault(path[0], deque()).append((path, j))
        for k in [k for k, w in waiting.items() if w]:
            while waiting[k] and inside[k] < storage[k] and not shut[k]:
                path, j = waiting[k].popleft()
                count["entered"] += 1
                enter(k, path, 0, j, now)
        credit = np.minimum(credit + net.capacity * STEP_S / 3600, np.maximum(1.0, net.capacity * STEP_S / 3600))
        heads = [(queue[k][0][0], k) for k in np.flatnonzero(inside) if queue[k]]
        for _, k in sorted(heads):
            if k_signal := net.signals.get(net.ids[k]):
                cycle, a, z = k_signal
                if not a <= now % cycle < z:
                    continue
            while queue[k] and queue[k][0][0] <= now and credit[k] >= 1:
                _, path, pos, j = queue[k][0]
                following = path[pos + 1] if pos + 1 < len(path) else None
                if following is not None and (inside[following] >= storage[following] or shut[following]):
                    break
                queue[k].popleft()
                inside[k] -= 1
                credit[k] -= 1
                flow_out[k] += 1
                if following is None:
                    count["left"] += 1
                else:
                    enter(following, path, pos + 1, j, now)
        rho = inside / np.maximum(net.km * net.lanes, 1e-9)
        target = np.maximum(limit * np.exp(-(1 / net.alpha) * (rho / net.critical) ** net.alpha), LEAST_KMH)
        speed = KEEP * speed + (1 - KEEP) * target
        speeds += speed
        density += rho
        steps += 1
        if (step + 1) % n_slice == 0:
            used = (flow_in > 0) | (density > 0)
            for k in np.flatnonzero(used):
                results.append((step // n_slice, net.ids[k], flow_in[k] * 60 / slice_minutes, flow_out[k] * 60 / slice_minutes, speeds[k] / steps[k], density[k] / steps[k], net.km[k] / (speeds[k] / steps[k]) * 60))
            flow_in, flow_out, speeds, density, steps = (np.zeros(n) for _ in range(5))
    count["present"] = int(inside.sum())
    count["not_entered"] = len(pending) + sum(len(w) for w in waiting.values())
    return results, traces, count


RESULT = "seed int, slice int, id_link bigint, flow_in double, flow_out double, speed double, density double, tt double"


def simulated(net: Network, flows: list[tuple[list[list[int]], list[float], list[float]]], seeds: DataFrame, minutes: float, slice_minutes: float = 15.0) -> DataFrame:
    """Link results of one run a seed (column `seed`); network and demand of one scenario are broadcast, as a kernel
    holds them in any case."""
    shared = seeds.sparkSession.sparkContext.broadcast((net, flows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, demand = shared.value
        for b in batches:
            for seed in b.column("seed").to_pylist():
                got, _, _ = run(own, departures(demand, slice_minutes, seed), minutes, slice_minutes, seed=seed)
                cols = [pa.array([seed] * len(got), pa.int32()), *[pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 7, [pa.int32(), pa.int64(), *[pa.float64()] * 5], strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in RESULT.split(", ")])

    return seeds.select(F.col("seed").cast("int")).repartition("seed").mapInArrow(each, RESULT)
