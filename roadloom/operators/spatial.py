"""Complete radius joins of points, and the region containing each point.

Partition: a bounded number of pivots, each point in the Voronoi cell of its nearest pivot. A centre that may be
within its radius of a point is also sent to every cell whose pivot is at most twice the radius further than its
nearest: by the triangle inequality no pair is lost. Hot cells are divided again in the same way. Within a cell a vantage-point tree over the centres is searched
by all query points at once. Any metric will do; planar and great-circle distance are given.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import finite
from roadloom.operators.delivery import first_delivery, first_pings
from roadloom.operators.sequences import per_group, spans
from roadloom.session import discarded, written

Metric = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
EARTH_M = 6_371_008.8
LEAF = 64
#: Pivots are the points with the smallest hashes: a sample bounded by this number, whatever the input.
PIVOTS = 128
#: Query rows of a cell that one task takes. A hotter cell is divided again by pivots of its own; only where that leaves
#: more (about one place) are its queries dealt to parts and its centres copied to each.
HOT = 50_000


def planar(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.hypot(ax - bx, ay - by)


def great_circle(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Metres on the sphere between places in degrees (x longitude, y latitude)."""
    ax, ay, bx, by = (np.radians(v) for v in (ax, ay, bx, by))
    h = np.sin((by - ay) / 2) ** 2 + np.cos(ay) * np.cos(by) * np.sin((bx - ax) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def radius_pairs(qx: np.ndarray, qy: np.ndarray, cx: np.ndarray, cy: np.ndarray, r: np.ndarray, metric: Metric = planar) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, centre) within the centre's radius, by a vantage-point tree over the centres.

    All queries go down the tree together. A node keeps its vantage point, the median distance of the rest to it, and
    prunes a side for the queries that the triangle inequality rules out, by the largest radius on that side.
    """
    qs, cs = [], []
    todo = [(np.arange(len(cx)), np.arange(len(qx)))]
    while todo:
        c, q = todo.pop()
        if not len(c) or not len(q):
            continue
        if len(c) <= LEAF:
            for part in np.array_split(q, max(1, len(q) // 20_000)):
                i, k = np.nonzero(metric(qx[part, None], qy[part, None], cx[None, c], cy[None, c]) <= r[None, c])
                qs.append(part[i])
                cs.append(c[k])
            continue
        v, rest = c[0], c[1:]
        dq = metric(qx[q], qy[q], cx[v], cy[v])
        hit = q[dq <= r[v]]
        qs.append(hit)
        cs.append(np.full(len(hit), v))
        dc = metric(cx[rest], cy[rest], cx[v], cy[v])
        mid = np.median(dc)
        near = dc <= mid
        if near.all():  # many at one distance: halve them anyway, each half bounded by its own distances
            near = np.arange(len(rest)) < len(rest) // 2
        for side in (near, ~near):
            top = r[rest[side]].max()
            todo.append((rest[side], q[(dq >= dc[side].min() - top) & (dq <= dc[side].max() + top)]))
    if not qs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(qs), np.concatenate(cs)


def contains(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether points lie in the region of the rings x, y (ring k ends before ends[k]), holes out: even-odd rule.

    An edge holds its lower end only, so of two regions that share an edge one contains a point on it.
    """
    start = np.r_[0, ends[:-1]]
    nxt = np.arange(1, len(x) + 1)
    nxt[ends - 1] = start
    x2, y2 = x[nxt], y[nxt]
    inside = np.zeros(len(px), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for part in np.array_split(np.arange(len(px)), max(1, len(px) * len(x) // 2_000_000)):
            qx, qy = px[part, None], py[part, None]
            crosses = (y[None] <= qy) != (y2[None] <= qy)
            at = x[None] + (qy - y[None]) / (y2 - y)[None] * (x2 - x)[None]
            inside[part] = (crosses & (qx < at)).sum(axis=1) % 2 == 1
    return inside


NUMBERS = re.compile(r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|[-+]?\.\d+(?:[eE][-+]?\d+)?")


def rings(text: str | None) -> list[np.ndarray]:
    """Rings of a polygon or multipolygon in WKT, EWKT or GeoJSON, as arrays of (x, y); none if it can't be read."""
    if not text:
        return []
    try:
        if text.lstrip().startswith("{"):
            shape = json.loads(text)
            many = shape["coordinates"] if shape["type"] == "MultiPolygon" else [shape["coordinates"]]
            return [np.array(ring, float)[:, :2] for polygon in many for ring in polygon]
        head, _, body = text.partition("(")
        dims = 2 + sum(head.upper().rstrip().endswith(e) for e in (" Z", " M")) + 2 * head.upper().rstrip().endswith(" ZM")
        return [np.array(NUMBERS.findall(ring), float).reshape(-1, dims)[:, :2] for ring in re.findall(r"\(([^()]+)\)", "(" + body)]
    except (ValueError, KeyError, TypeError, IndexError):
        return []


REGION = "cid bigint, cx double, cy double, r double, xs array<double>, ys array<double>, ends array<bigint>"


def regions(zones: DataFrame, id_col: str = "id", geometry: str = "geometry") -> DataFrame:
    """(cid, cx, cy, r, xs, ys, ends): a circle round each region and its rings; unreadable or null shapes and ids give
    no row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cid, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                found = [ring for ring in rings(text) if len(ring) > 2]
                if cid is None or not found:
                    continue
                p = np.concatenate(found)
                c = (p.min(0) + p.max(0)) / 2
                out.append((cid, *c, float(np.hypot(*(p - c).T).max()) * (1 + 1e-9), p[:, 0].tolist(), p[:, 1].tolist(), np.cumsum([len(f) for f in found]).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 7, [pa.int64(), *[pa.float64()] * 3, *[pa.list_(pa.float64())] * 2, pa.list_(pa.int64())], strict=True)], ["cid", "cx", "cy", "r", "xs", "ys", "ends"])

    return zones.select(F.col(id_col).cast("bigint"), geometry).mapInArrow(parse, REGION)


def pivots_of(points: DataFrame, x: str, y: str, count: int = PIVOTS) -> np.ndarray:
    """At most `count` distinct places, those with the smallest hashes: the same for the same points in any order."""
    got = points.select(x, y).where(f"{x} is not null and {y} is not null").groupBy(x, y).agg(F.xxhash64(x, y).alias("h")).orderBy("h", x, y).limit(count).collect()
    return np.array([(p[0], p[1]) for p in got], float).reshape(-1, 2)


def in_cells(df: DataFrame, x: str, y: str, r: str | None, pivots: np.ndarray, metric: Metric) -> DataFrame:
    """Adds `cell` (nearest pivot) and `own`; with a radius column, a row for every other cell it may matter to."""
    schema = df.select("*", F.lit(0).alias("cell"), F.lit(True).alias("own")).schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 5000):
                part = b.slice(s, 5000)
                px, py = (part.column(c).to_numpy(zero_copy_only=False) for c in (x, y))
                d = metric(px[:, None], py[:, None], pivots[None, :, 0], pivots[None, :, 1])
                nearest = d.argmin(axis=1)
                if r is None:
                    row, cell = np.arange(len(px)), nearest
                else:
                    reach = d[np.arange(len(px)), nearest] + 2 * part.column(r).to_numpy(zero_copy_only=False)
                    row, cell = np.nonzero(d <= (reach * (1 + 1e-9) + 1e-6)[:, None])
                t = pa.Table.from_batches([part]).take(pa.array(row))
                t = t.append_column("cell", pa.array(cell.astype(np.int32))).append_column("own", pa.array(cell == nearest[row]))
                yield from t.cast(pa.schema([f.with_nullable(True) for f in t.schema])).to_batches()

    return df.mapInArrow(assign, schema)


def _hot_pivots(queries: DataFrame, keys: list[str], x: str, y: str, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots of each cell that holds a hot group of queries: about `count` of its places, those with the smallest
    remainders of their hashes. Sent to the driver: the hot ones of at most PIVOTS cells, and about `count` places each."""
    hot = [r[0] for r in queries.groupBy(*keys).count().where(F.col("count") > HOT).select("cell").distinct().collect()]
    if not hot:
        return {}
    places = written(queries.where(F.col("cell").isin(hot)).select("cell", x, y).distinct(), "hot-places")
    size = places.groupBy("cell").agg(F.count(F.lit(1)).alias("places"))
    got = places.join(F.broadcast(size), "cell").where(F.pmod(F.xxhash64(x, y), F.col("places")) < count).select("cell", x, y).collect()
    discarded(places)
    found: dict[int, list] = {}
    for cell, px, py in sorted(got):
        found.setdefault(cell, []).append((px, py))
    return {c: np.array(p, float) for c, p in found.items() if len(p) > 1}


def _divided(df: DataFrame, hot: dict[int, np.ndarray], x: str, y: str, r: str | None, metric: Metric) -> DataFrame:
    """Adds `sub`, the nearest of its hot cell's own pivots (0 elsewhere); with a radius column, a row for every other
    one it may matter to, by the same inequality as in_cells."""
    if not hot:
        return df.withColumn("sub", F.lit(0))
    schema = df.withColumn("sub", F.lit(0)).schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("cell").to_numpy(zero_copy_only=False)
            px, py = (b.column(c).to_numpy(zero_copy_only=False) for c in (x, y))
            rows, subs = [np.flatnonzero(~np.isin(cells, list(hot)))], []
            subs.append(np.zeros(len(rows[0]), np.int64))
            for c in np.intersect1d(np.unique(cells), list(hot)):
                p = hot[int(c)]
                for at in np.array_split(np.flatnonzero(cells == c), max(1, (cells == c).sum() // 5000)):
                    d = metric(px[at, None], py[at, None], p[None, :, 0], p[None, :, 1])
                    if r is None:
                        rows.append(at)
                        subs.append(d.argmin(axis=1))
                    else:
                        reach = d.min(axis=1) + 2 * b.column(r).to_numpy(zero_copy_only=False)[at]
                        row, sub = np.nonzero(d <= (reach * (1 + 1e-9) + 1e-6)[:, None])
                        rows.append(at[row])
                        subs.append(sub)
            t = pa.Table.from_batches([b]).take(pa.array(np.concatenate(rows))).append_column("sub", pa.array(np.concatenate(subs).astype(np.int32)))
            yield from t.cast(pa.schema([f.with_nullable(True) for f in t.schema])).to_batches()

    return df.mapInArrow(assign, schema)


def _split(queries: DataFrame, centres: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Adds `part`: queries of a group that is still hot are dealt to its parts by hash, and its centres are copied to
    each part."""
    hot = queries.groupBy(*keys).count().where(F.col("count") > HOT).select(*[F.col(k).alias(f"h_{k}") for k in keys], F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    on = lambda d: [d[k] == hot[f"h_{k}"] for k in keys]
    drop = [f"h_{k}" for k in keys] + ["parts"]
    queries = queries.join(hot, on(queries), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("qid"), F.col("parts")), F.lit(0)).cast("int")).drop(*drop)
    centres = centres.join(hot, on(centres), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop(*drop)
    return queries, centres


def near_pairs(points: DataFrame, radius: float, metric: Metric = planar, pivots: int = PIVOTS) -> DataFrame:
    """(id_1, id_2): each pair of points (grp, id, entity, x, y) of one grp and different entities at most radius apart,
    once, the smaller id first. Rows with a null in any of these columns take no part."""
    points = points.where(" and ".join(f"{c} is not null" for c in ("grp", "id", "entity", "x", "y"))).withColumn("r", F.lit(float(radius)))
    at = pivots_of(points, "x", "y", pivots)
    if not len(at):
        return points.select(F.col("id").alias("id_1"), F.col("id").alias("id_2")).limit(0)
    cells = written(in_cells(points, "x", "y", "r", at, metric), "cells")
    hot = _hot_pivots(cells.where("own"), ["grp", "cell"], "x", "y", pivots)
    queries = _divided(cells.where("own").withColumn("qid", F.col("id")), hot, "x", "y", None, metric)
    queries, centres = _split(queries, _divided(cells, hot, "x", "y", "r", metric), ["grp", "cell", "sub"])
    both = queries.select("grp", "cell", "sub", "part", F.lit(True).alias("query"), "id", "entity", "x", "y").unionByName(centres.select("grp", "cell", "sub", "part", F.lit(False).alias("query"), "id", "entity", "x", "y"))

    def kernel(tab: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y, ids = (tab[c].to_numpy() for c in ("x", "y", "id"))
        entity = tab["entity"].combine_chunks().dictionary_encode().indices.to_numpy()
        query = tab["query"].to_numpy()
        left, right = [], []
        for a, b in spans(starts, len(x)):
            q, c = a + np.flatnonzero(query[a:b]), a + np.flatnonzero(~query[a:b])
            i, k = radius_pairs(x[q], y[q], x[c], y[c], np.full(len(c), float(radius)), metric)
            i, k = q[i], c[k]
            ok = (ids[i] < ids[k]) & (entity[i] != entity[k])
            left.append(ids[i[ok]])
            right.append(ids[k[ok]])
        return pa.table({"id_1": np.concatenate(left), "id_2": np.concatenate(right)})

    return per_group(both, ["grp", "cell", "sub", "part"], ["id"], kernel, "id_1 bigint, id_2 bigint")


def region_of(points: DataFrame, zones: DataFrame, metric: Metric = planar, pivots: int = PIVOTS) -> DataFrame:
    """(tag, qid, cid): for each point (tag, qid, x, y) each region that contains it; points in none give no row.

    Regions are joined by the circles round them, then tested exactly. Rows with a null id or place take no part.
    """
    points = points.where("qid is not null and x is not null and y is not null")
    shapes = regions(zones)
    at = pivots_of(shapes, "cx", "cy", pivots)
    if not len(at):
        return points.select("tag", "qid", F.col("qid").alias("cid")).limit(0)
    queries = written(in_cells(points, "x", "y", None, at, metric), "cells")
    hot = _hot_pivots(queries, ["cell"], "x", "y", pivots)
    centres = _divided(in_cells(shapes, "cx", "cy", "r", at, metric), hot, "cx", "cy", "r", metric)
    queries, centres = _split(_divided(queries, hot, "x", "y", None, metric), centres, ["cell", "sub"])
    empty = {"r": "double", "xs": "array<double>", "ys": "array<double>", "ends": "array<bigint>"}
    left = queries.select("cell", "sub", "part", F.lit(True).alias("query"), "tag", F.col("qid").alias("id"), "x", "y", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    right = centres.select("cell", "sub", "part", F.lit(False).alias("query"), F.lit("").alias("tag"), F.col("cid").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), *empty)

    def kernel(tab: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y, ids = (tab[c].to_numpy() for c in ("x", "y", "id"))
        query = tab["query"].to_numpy()
        r = tab["r"].to_numpy()
        q_all, c_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in spans(starts, len(x)):
            q, c = a + np.flatnonzero(query[a:b]), a + np.flatnonzero(~query[a:b])
            i, k = radius_pairs(x[q], y[q], x[c], y[c], r[c], metric)
            i, k = q[i], c[k]
            order = np.argsort(k, kind="stable")
            i, k = i[order], k[order]
            edges = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else [0]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                shape = [np.asarray(tab[col][int(k[s])].as_py()) for col in ("xs", "ys", "ends")]
                ok = contains(x[i[s:e]], y[i[s:e]], *shape)
                q_all.append(i[s:e][ok])
                c_all.append(k[s:e][ok])
        q, c = np.concatenate(q_all), np.concatenate(c_all)
        return pa.table({"tag": tab["tag"].take(q), "qid": ids[q], "cid": ids[c]})

    return per_group(left.unionByName(right), ["cell", "sub", "part"], ["query", "id"], kernel, "tag string, qid bigint, cid bigint")


def line_end(geometry: Column, last: bool) -> tuple[Column, Column]:
    """x, y of the first or last point of a line in WKT, EWKT or GeoJSON."""
    wkt = F.substring_index(F.substring_index(F.substring_index(geometry, "(", -1), ")", 1), ",", -1 if last else 1)
    found = F.regexp_extract(geometry, "\\[\\s*([^\\[\\]]+)\\][^\\[]*$" if last else "\\[\\s*([^\\[\\]]+)\\]", 1)
    p = F.split(F.trim(F.when(geometry.startswith("{"), found).otherwise(wkt)), "[,\\s]+")
    return tuple(finite(F.try_element_at(p, F.lit(k)).try_cast("double")) for k in (1, 2))


def p3_found(fcd: DataFrame, trips: DataFrame, zones: DataFrame, radius: float = 50.0) -> DataFrame:
    """(kind, id_1, id_2) as TESTDATA.md states it; only engine 0 of the first-received copy is a switch-on."""
    on = written(first_pings(fcd).where("engine = 0"), "switched-on")
    near = near_pairs(on.select(F.to_date("ts").alias("grp"), "id", F.col("id_veh").alias("entity"), "x", "y"), radius)
    trip = first_delivery(trips, F.col("id_trip"), "loaded_at", ["id_zone_o", "id_zone_d", "geometry"], "id_trip")
    (ox, oy), (dx, dy) = (line_end(F.trim("geometry"), last) for last in (False, True))
    ends = trip.select("id_trip", F.explode(F.array(*[F.struct(F.lit(k).alias("tag"), x.alias("x"), y.alias("y")) for k, x, y in (("trip_o", ox, oy), ("trip_d", dx, dy))])).alias("e")).select("e.tag", F.col("id_trip").alias("qid"), "e.x", "e.y")
    points = on.select(F.lit("ping_zone").alias("tag"), F.col("id").alias("qid"), "x", "y").unionByName(ends)
    inside = region_of(points, zones)
    given = trip.select("id_trip", F.explode(F.create_map(F.lit("trip_o"), "id_zone_o", F.lit("trip_d"), "id_zone_d")).alias("k", "zone"))
    wrong = inside.join(given, (F.col("qid") == F.col("id_trip")) & (F.col("tag") == F.col("k")), "left").where((F.col("tag") == "ping_zone") | ~F.col("zone").eqNullSafe(F.col("cid")))
    return near.select(F.lit("ping_near").alias("kind"), "id_1", "id_2").unionByName(wrong.select(F.col("tag").alias("kind"), F.col("qid").alias("id_1"), F.col("cid").alias("id_2")))
