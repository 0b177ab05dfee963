"""Groups of near things: connected components of edges, and paths within a Hausdorff distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.operators.sequences import per_group, spans
from roadloom.session import discarded, written


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id of each connected component, of edges (a, b); a == b names a lone vertex.

    Alternating large-star and small-star rounds: each vertex links its neighbours to the smallest among them, so paths
    shrink by about half a round and no vertex's neighbours are gathered. Edges are distinct and a table is written each
    round; ends when a round changes nothing.
    """
    loops = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        new = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = written(new, "edges")
        change = new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty()
        discarded(e)
        e = new
        if change:
            break
    else:
        raise RuntimeError("components still change after the last round")
    return loops.join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def to_line(p: np.ndarray, line: np.ndarray) -> float:
    """The largest distance of points p to a line of vertices."""
    if len(line) == 1:
        return float(np.hypot(*(p - line[0]).T).max())
    a, d = line[:-1], np.diff(line, axis=0)
    length = (d**2).sum(1)
    s = np.clip(((p[:, None] - a[None]) * d[None]).sum(2) / np.where(length > 0, length, 1), 0, 1)
    return float(np.hypot(*np.moveaxis(p[:, None] - a[None] - s[..., None] * d[None], 2, 0)).min(1).max())


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Hausdorff distance of two lines, taken at their vertices."""
    return max(to_line(a, b), to_line(b, a))


def path_clusters(paths: DataFrame, eps: float = 100.0) -> DataFrame:
    """(source, target, cluster, id, tot_cost, mean_cost, n, k): clusters of the paths (source, target, id, tot_cost,
    xy array<struct<x,y>>) of each pair, joined where two are at most eps apart; the cheapest is the representative
    (its id also names the cluster), and k ranks a pair's clusters by it.

    Paths of one shape are one vertex with a count (aggregated first). Lines at most eps apart have boxes whose corners
    are at most eps apart, so a shape is compared with those of its corner's cell and the cells round it: a busy pair is
    spread over tasks, and a task sends out at most one edge a shape, as members of one cluster aren't compared again.
    The components of these edges are the clusters. Null or empty shapes are left out.
    """
    shape = F.flatten(F.transform("xy", lambda p: F.array(p["x"], p["y"])))
    same = paths.where("xy is not null and size(xy) > 0").withColumn("shape", shape).groupBy("source", "target", "shape").agg(F.min(F.struct("tot_cost", "id")).alias("best"), F.sum("tot_cost").alias("total"), F.count(F.lit(1)).alias("n"))
    low = lambda odd: F.array_min(F.filter("shape", lambda v, i: i % 2 == odd))
    same = written(same.select("source", "target", F.xxhash64("source", "target", "shape").alias("vertex"), "best", "total", "n", "shape", F.floor(low(0) / eps).alias("cx"), F.floor(low(1) / eps).alias("cy")), "shapes")
    round_it = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = same.select("source", "target", "cx", "cy", "vertex", "shape", round_it.alias("d")).select("source", "target", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"), "vertex", "shape")

    def kernel(tab: pa.Table, starts: np.ndarray) -> pa.Table:
        vertex, own = tab["vertex"].to_numpy(), tab["own"].to_numpy()
        column = tab["shape"].combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
        lines = [flat[a:b].reshape(-1, 2) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        box = np.array([[*v.min(0), *v.max(0)] for v in lines]).reshape(-1, 4)
        root = np.arange(len(lines))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in spans(starts, len(lines)):
            for i in a + np.flatnonzero(own[a:b]):
                for j in a + np.flatnonzero((np.abs(box[a:b] - box[i]) <= eps).all(1)):
                    x, y = top(int(i)), top(int(j))
                    if x != y and hausdorff(lines[i], lines[j]) <= eps:
                        root[max(x, y)] = min(x, y)
        to = np.array([top(i) for i in range(len(lines))], int)
        use = own | (to != np.arange(len(lines)))
        return pa.table({"a": vertex[use], "b": vertex[to[use]]})

    edges = per_group(near, ["source", "target", "cx", "cy"], ["vertex"], kernel, "a bigint, b bigint")
    of = components(edges).select(F.col("id").alias("vertex"), "component")
    g = same.drop("shape").join(of, "vertex").groupBy("source", "target", "component").agg(F.min("best").alias("b"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("source", "target").orderBy("b.tot_cost", "b.id")) - 1
    return g.select("source", "target", F.col("b.id").alias("cluster"), F.col("b.id").alias("id"), F.col("b.tot_cost").alias("tot_cost"), (F.col("total") / F.col("n")).alias("mean_cost"), "n", rank.cast("bigint").alias("k"))
