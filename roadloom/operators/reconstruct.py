"""Paths that trips took, rebuilt from their pings: the cheapest chain of links near the trip's line."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadloom.operators.clusters import to_line
from roadloom.operators.paths import Graph, shortest

REBUILT = "id_trip bigint, source bigint, target bigint, tot_cost double, links array<bigint>"


def rebuilt(trips: DataFrame, g: Graph, shapes: dict[int, np.ndarray], reach: float = 500.0) -> DataFrame:
    """(id_trip, source, target, tot_cost, links) of trips (id_trip, xy array<struct<x,y>>).

    A link costs its vertices' largest distance to the trip's line, plus turns; only links within reach of the trip
    take part. It starts at the tail of the link nearest to the first ping and ends at the head of that nearest to the
    last. Trips without a chain, or with fewer than two pings, give no row. Graph and shapes are a network of checked
    size (paths.graph); trips are spread over tasks.
    """
    shared = trips.sparkSession.sparkContext.broadcast((g, shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lines = shared.value
        shape = [lines[int(i)] for i in own.ids]
        box = np.array([[*s.min(0), *s.max(0)] for s in shape]).reshape(-1, 4)
        for b in batches:
            out = []
            for key, xy in zip(b.column("id_trip").to_pylist(), b.column("xy").to_pylist(), strict=True):
                p = np.array([(v["x"], v["y"]) for v in xy or ()], float).reshape(-1, 2)
                if len(p) < 2:
                    continue
                lo, hi = p.min(0) - reach, p.max(0) + reach
                near = np.flatnonzero((box[:, 0] <= hi[0]) & (box[:, 2] >= lo[0]) & (box[:, 1] <= hi[1]) & (box[:, 3] >= lo[1]))
                cost = np.full(len(own.ids), np.inf)
                for k in near:
                    d = to_line(shape[k], p)
                    if d <= reach:
                        cost[k] = d
                use = np.flatnonzero(np.isfinite(cost))
                if not len(use):
                    continue
                ends = [min(use, key=lambda k: (to_line(p[[e]], shape[k]), int(own.ids[k]))) for e in (0, -1)]  # noqa: B023
                source, target = int(own.tail[ends[0]]), int(own.head[ends[1]])
                local = replace(own, minutes=cost[:, None], by_tail={source: [k for k in own.by_tail.get(source, ()) if np.isfinite(cost[k])]})
                got = shortest(local, source, {target}, 0.0).get(target)
                if got and np.isfinite(got[0]):
                    out.append((key, source, target, got[0], got[1]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], [c.split()[0] for c in REBUILT.split(", ")])

    return trips.select("id_trip", "xy").mapInArrow(run, REBUILT)
