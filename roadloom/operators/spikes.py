"""Implausible readings: impossible places of moving devices, and spikes, stuck values and bounds of measurements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators.delivery import first_delivery, first_pings
from roadloom.operators.sequences import DAY_US, micros, per_group, spans, with_halo

#: The study area (x from, x to, y from, y to) in metres, and the speed no vehicle exceeds in km/h.
AREA = (610_000.0, 670_000.0, 4_830_000.0, 4_890_000.0)
MAX_KMH = 250.0


def halo_us(area: tuple[float, float, float, float] = AREA, max_kmh: float = MAX_KMH) -> int:
    """The time after which any place of the area can be reached from any other: pings further apart in time than
    this can't show each other to be impossible."""
    return int(np.hypot(area[1] - area[0], area[3] - area[2]) / (max_kmh / 3.6) * 1e6) + 1_000_000


def impossible_places(t: np.ndarray, x: np.ndarray, y: np.ndarray, starts: np.ndarray, area: tuple, max_kmh: float) -> np.ndarray:
    """Flags of the impossible places of one or more sequences (rows sorted, `starts` their first rows).

    Outside the area; or faster than max_kmh both from the last and to the next plausible place. Only steps that are
    too fast are looked at one by one: from the last plausible ping the first reachable later ping is sought, and those
    between that can't reach it either, seen from the latest to the earliest, are impossible.
    """
    bad = ~((x >= area[0]) & (x <= area[1]) & (y >= area[2]) & (y <= area[3]))
    keep = np.flatnonzero(~bad)
    if len(keep) < 3:
        return bad
    group = np.zeros(len(t), np.int64)
    group[starts] = 1
    g = np.cumsum(group)[keep]
    t, x, y = t[keep] / 1e6, x[keep], y[keep]
    limit = max_kmh / 3.6
    fast = (np.hypot(np.diff(x), np.diff(y)) > limit * np.diff(t)) & (g[1:] == g[:-1])
    ends = np.searchsorted(g, g, side="right")
    done = -1
    for i in np.flatnonzero(fast) + 1:
        if i <= done:
            continue
        last, end = i - 1, ends[i]
        j, step = i + 1, 64
        while j < end:  # in slices, as the next reachable ping is mostly near
            s = slice(j, min(end, j + step))
            there = np.flatnonzero(np.hypot(x[s] - x[last], y[s] - y[last]) <= limit * (t[s] - t[last]))
            if len(there):
                j += int(there[0])
                break
            j, step = s.stop, step * 2
        if j >= end:
            continue  # no later ping to judge by
        following = j
        for k in range(j - 1, i - 1, -1):
            if np.hypot(x[following] - x[k], y[following] - y[k]) > limit * (t[following] - t[k]):
                bad[keep[k]] = True
            else:
                following = k
        done = j
    return bad


def flagged_pings(fcd: DataFrame, area: tuple = AREA, max_kmh: float = MAX_KMH, block_us: int = DAY_US) -> DataFrame:
    """(id_veh, block, id, t, x, y, bad) of each first-received ping with time and place.

    A vehicle's sequence is cut into blocks of time with a halo as long as it takes to cross the area, so a hot vehicle
    is spread over tasks and a block sees every ping that can speak for or against its own. Ties in time are in order
    of id. Empty input gives no rows; null ids, times and places are left aside by first_pings.
    """
    rows = first_pings(fcd, ()).select("id_veh", "id", micros(F.col("ts")).alias("t"), "x", "y")

    def kernel(tab: pa.Table, starts: np.ndarray) -> pa.Table:
        t, x, y = (tab[c].to_numpy() for c in ("t", "x", "y"))
        bad = impossible_places(t, x, y, starts, area, max_kmh)
        return tab.select(["id_veh", "block", "id", "t", "x", "y"]).append_column("bad", pa.array(bad)).filter(pa.array(t // block_us == tab["block"].to_numpy()))  # without the halo

    return per_group(with_halo(rows, "t", block_us, halo_us(area, max_kmh)), ["id_veh", "block"], ["t", "id"], kernel, "id_veh string, block int, id bigint, t bigint, x double, y double, bad boolean")


def _rolling(v: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling median and median absolute deviation over 2 * half + 1 readings, the window shifted in at the ends."""
    w = min(2 * half + 1, len(v))
    windows = np.lib.stride_tricks.sliding_window_view(v, w)
    at = np.clip(np.arange(len(v)) - half, 0, len(windows) - 1)
    med = np.median(windows, axis=1)[at]
    return med, np.median(np.abs(windows[at] - med[:, None]), axis=1)


def hampel_frames(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Hampel filter for groups of `size` consecutive readings, rolled over v: the frame of a group is the group and
    the readings before and after it, these weighing as much as the group each.

    Per frame (group from reading 1, 2, ...): the weighted median, the weighted median absolute deviation from it, and
    the score, the group's largest deviation in units of 1.4826 * MAD. So weighted, neither the group nor one odd
    neighbour is the median: of a group beyond both its neighbours it is the nearer of them.
    """
    wide = np.lib.stride_tricks.sliding_window_view(v, size + 2)[:, [*[0] * size, *range(1, size + 1), *[size + 1] * size]]
    med = np.median(wide, axis=1)
    dev = np.abs(wide - med[:, None])
    mad = np.median(dev, axis=1)
    return med, mad, dev[:, size : 2 * size].max(axis=1) / np.maximum(1.4826 * mad, 1e-9)


def implausible_readings(v: np.ndarray, low: float, high: float, stuck: int, share: float, longest: int, half: int) -> tuple[np.ndarray, ...]:
    """Kinds of case ('' for none) of one source's readings in order, with rolling median, MAD and Hampel score.

    Bounds, then runs of at least `stuck` equal readings, then spikes. Candidates for spikes are the groups of up to
    `longest` readings that the Hampel filter of their frame finds: a score of at least one MAD. That loses no group
    beyond both neighbours, whose largest deviation is never below the MAD. Of the candidates remain those whose every
    reading lies beyond the frame's median, all on one side, by more than `share` of the source's median (the MAD of a
    smooth source would make noise a case). Neither neighbour may be a case: larger groups come first, then those
    further from the median of the wider rolling window, and one that conflicts with an accepted group is left.
    """
    n = len(v)
    kind = np.full(n, "", object)
    med, mad = _rolling(v, half) if n else (v, v)
    score = np.abs(v - med) / np.maximum(1.4826 * mad, 1e-9)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if n else np.zeros(0, int)
    length = np.diff(np.r_[first, n])
    kind[np.repeat(length >= stuck, length)] = "stuck"
    kind[(v < low) | (v > high)] = "bounds"
    base = kind != ""
    band = share * np.median(v) if n else 0.0
    found = []
    for size in range(1, longest + 1):
        if n < size + 2:
            break
        centre, _, outlying = hampel_frames(v, size)
        at = np.flatnonzero((outlying >= 1 / 1.4826 - 1e-9) & ~base[: n - size - 1] & ~base[size + 1 :]) + 1
        beyond = v[at[:, None] + np.arange(size)] - centre[at - 1, None]
        at = at[(beyond > band).all(axis=1) | (beyond < -band).all(axis=1)]
        found += [(float(np.abs(v[i : i + size] - med[i : i + size]).min()), int(i), size) for i in at]
    case, neighbour = base.copy(), np.zeros(n, bool)
    for _, i, size in sorted(found, key=lambda f: (-f[2], -f[0], f[1])):
        if case[i - 1] or case[i + size] or neighbour[i : i + size].any():
            continue
        case[i : i + size] = True
        neighbour[[i - 1, i + size]] = True
        kind[i : i + size] = np.where(kind[i : i + size] == "", "spike", kind[i : i + size])
    return kind, med, mad, score


def flagged_readings(df: DataFrame, low: float = 0.0, high: float = 250.0, stuck: int = 12, share: float = 0.3, longest: int = 3, half: int = 4) -> DataFrame:
    """(id_link, id_res, t, avg_speed, roll_median, roll_mad, hampel_score, kind) of each reading that isn't null.

    Repeated rows count once (the first published), nulls are left aside, equal times are in order of id_res. A group
    is one link; as its repeated rows are gone, it has one row a slot of time, so its size is bounded by the calendar
    (35,040 a year) whatever share of the delivered rows it holds.
    """
    rows = first_delivery(df, F.col("id_res"), "published_at", ["id_link", "slot_ts", "avg_speed"], "id_res")
    rows = rows.where("avg_speed is not null and not isnan(avg_speed) and id_link is not null and slot_ts is not null")
    rows = rows.select("id_link", "id_res", micros(F.col("slot_ts")).alias("t"), "avg_speed")

    def kernel(tab: pa.Table, starts: np.ndarray) -> pa.Table:
        v = tab["avg_speed"].to_numpy()
        parts = [implausible_readings(v[a:b], low, high, stuck, share, longest, half) for a, b in spans(starts, len(v))]
        kind, med, mad, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        for name, c in (("roll_median", med), ("roll_mad", mad), ("hampel_score", score), ("kind", kind)):
            tab = tab.append_column(name, pa.array(c))
        return tab

    return per_group(rows, ["id_link"], ["t", "id_res"], kernel, "id_link bigint, id_res bigint, t bigint, avg_speed double, roll_median double, roll_mad double, hampel_score double, kind string")


def p4_found(fcd: DataFrame, readings: DataFrame) -> DataFrame:
    pings = flagged_pings(fcd).where("bad").select(F.lit("fcd").alias("kind"), "id")
    return pings.unionByName(flagged_readings(readings).where("kind != ''").select(F.lit("agg").alias("kind"), F.col("id_res").alias("id")))
