"""Time-dependent shortest paths on links with turn costs, path costs, and the assignment matrix."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.session import collected, discarded, kernel_partitions, written

#: Links of a graph that tasks may be given whole; a larger one is relaxed by joins instead.
MAX_LINKS = 2_000_000


@dataclass
class Graph:
    """Links in arrays: out-links of each link with turn minutes, and minutes by time slice (past the end the last)."""

    ids: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    minutes: np.ndarray
    first: np.ndarray
    turns: np.ndarray
    penalty: np.ndarray
    by_tail: dict[int, list[int]]
    slice_minutes: float

    @cached_property
    def rows(self) -> tuple[list, ...]:
        """The arrays as lists, whose single elements are read faster."""
        return tuple(a.tolist() for a in (self.ids, self.head, self.minutes, self.first, self.turns, self.penalty))


def graph(links: DataFrame, turns: DataFrame, slice_minutes: float = 15.0) -> Graph:
    """links: (id, from_node, to_node, minutes array<double>); turns: (in_link, out_link, penalty), infinite = forbidden.

    Links and turns are brought to the driver only after their size in bytes has been checked (slices multiply it).
    """
    n = links.count()
    if n > MAX_LINKS:
        raise ValueError(f"{n} links are more than tasks may be given ({MAX_LINKS}); use relaxed_paths")
    rows = sorted(collected(links.select("id", "from_node", "to_node", "minutes"), "links", F.size("minutes")))
    ids = np.array([r[0] for r in rows], np.int64)
    at = {int(i): k for k, i in enumerate(ids)}
    width = max((len(r[3]) for r in rows), default=1)
    minutes = np.array([[*r[3], *[r[3][-1]] * (width - len(r[3]))] for r in rows], float).reshape(len(rows), width)
    pairs = sorted((at[r[0]], at[r[1]], r[2]) for r in collected(turns.where("penalty < double('infinity')").select("in_link", "out_link", "penalty"), "turns") if r[0] in at and r[1] in at)
    first = np.searchsorted([p[0] for p in pairs], np.arange(len(rows) + 1))
    by_tail: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        by_tail.setdefault(int(r[1]), []).append(k)
    return Graph(ids, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), minutes, first, np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], float), by_tail, slice_minutes)


def shortest(g: Graph, source: int, targets: set[int], t_start: float) -> dict[int, tuple[float, list[int], list[float]]]:
    """Cheapest path to each target node: (minutes, link ids, minutes on leaving each link).

    A label belongs to a link, not a node, so that turns cost. Clock: minutes from the interval's start; first come
    first served. Of equal costs the smaller link goes first. Ends when all targets are settled.
    """
    ids, head, minutes, first, turns, penalty = g.rows
    last, width = g.minutes.shape[1] - 1, g.slice_minutes
    infinite = float("inf")
    best: dict[int, float] = {}
    back: dict[int, int] = {}
    done: set[int] = set()
    heap: list[tuple[float, int, int]] = []
    for k in g.by_tail.get(source, ()):
        c = minutes[k][min(int(t_start // width), last)]
        best[k] = c
        heapq.heappush(heap, (c, ids[k], k))
    open_targets, found = set(targets) - {source}, {}
    while heap and open_targets:
        c, _, k = heapq.heappop(heap)
        if k in done:
            continue
        done.add(k)
        node = head[k]
        if node in open_targets:
            open_targets.discard(node)
            found[node] = k
        for j in range(first[k], first[k + 1]):
            m = turns[j]
            if m in done:
                continue
            way = c + penalty[j]
            way += minutes[m][min(int((t_start + way) // width), last)]
            if way < best.get(m, infinite):
                best[m] = way
                back[m] = k
                heapq.heappush(heap, (way, ids[m], m))
    out = {}
    for node, k in found.items():
        chain = [k]
        while chain[-1] in back:
            chain.append(back[chain[-1]])
        chain.reverse()
        out[node] = (best[k], [ids[i] for i in chain], [best[i] for i in chain])
    return out


PATH = "source bigint, target bigint, t_start double, tot_cost double, links array<bigint>, costs array<double>"


def shortest_paths(tasks: DataFrame, g: Graph) -> DataFrame:
    """Paths of tasks (source, targets array<bigint>, t_start); unreachable targets give no row. The graph is a
    broadcast variable of checked size; a task is one search, so tasks spread over executors."""
    shared = tasks.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            rows = []
            for s, targets, t in zip(*(b.column(c).to_pylist() for c in ("source", "targets", "t_start")), strict=True):
                rows += [(s, node, t, c, links, costs) for node, (c, links, costs) in sorted(shortest(own, s, set(targets), t).items())]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [c.split()[0] for c in PATH.split(", ")])

    spaced = tasks.select("source", "targets", F.col("t_start").cast("double")).repartition(kernel_partitions(tasks.sparkSession), "source", "t_start")
    return spaced.mapInArrow(run, PATH)


def relaxed_costs(links: DataFrame, turns: DataFrame, sources: DataFrame, within: float = float("inf"), rounds: int = 1000) -> DataFrame:
    """(source, id_link, cost): cheapest minutes to the end of each link that is reached within the given minutes, by
    joins, for graphs too large for one task.

    Each round extends only the labels that improved in the last; tables are written between rounds, so the plan stays
    short and survives lost executors, and the table of the round before is deleted. Ends when nothing improves.
    """
    edges = turns.where("penalty < double('infinity')").join(links.select(F.col("id").alias("out_link"), "minutes"), "out_link").select("in_link", "out_link", (F.col("penalty") + F.col("minutes")).alias("step"))
    edges = written(edges, "edges")
    labels = written(sources.join(links, F.col("source") == F.col("from_node")).groupBy("source", F.col("id").alias("id_link")).agg(F.min("minutes").alias("cost")).where(F.col("cost") <= within), "labels")
    fresh = labels
    for _ in range(rounds):
        step = fresh.join(edges, F.col("id_link") == F.col("in_link")).groupBy("source", F.col("out_link").alias("id_link")).agg(F.min(F.col("cost") + F.col("step")).alias("new")).where(F.col("new") <= within)
        both = written(labels.join(step, ["source", "id_link"], "full").withColumn("better", F.coalesce(F.col("new") < F.col("cost") - 1e-12, F.col("new").isNotNull())).select("source", "id_link", F.when(F.col("better"), F.col("new")).otherwise(F.col("cost")).alias("cost"), "better"), "labels")
        discarded(labels)
        labels, fresh = both.drop("better"), both.where("better").drop("better")
        if fresh.isEmpty():
            return labels
    raise RuntimeError("costs still improve after the last round")


def relaxed_paths(tasks: DataFrame, links: DataFrame, turns: DataFrame, slice_minutes: float = 15.0, rounds: int = 100_000) -> DataFrame:
    """The paths of shortest_paths (tasks with source, targets, t_start; links with minutes by slice), by joins, for
    graphs too large for one task; of paths that cost the same it may find another.

    Labels of links, each with the link before it, are extended round by round as in relaxed_costs, the minutes looked
    up at the label's own time. Then all paths are walked back together, one link a round.
    """
    at = lambda t: F.get("minutes", F.least(F.floor((F.col("t_start") + t) / slice_minutes).cast("int"), F.size("minutes") - 1))
    key = ["source", "t_start", "id_link"]
    tasks = tasks.select("source", "targets", F.col("t_start").cast("double").alias("t_start"))
    edges = turns.where("penalty < double('infinity')").join(links.select(F.col("id").alias("out_link"), "minutes"), "out_link")
    edges = written(edges.select("in_link", "out_link", "penalty", "minutes"), "edges")
    first = tasks.select("source", "t_start").distinct().join(links, F.col("source") == F.col("from_node"))
    labels = written(first.select("source", "t_start", F.col("id").alias("id_link"), at(F.lit(0.0)).alias("cost"), F.lit(None).cast("bigint").alias("before")), "labels")
    fresh = labels
    for _ in range(rounds):
        way = F.col("cost") + F.col("penalty")
        step = fresh.join(edges, F.col("id_link") == F.col("in_link")).select("source", "t_start", F.col("out_link").alias("id_link"), F.struct((way + at(way)).alias("cost"), "in_link").alias("s"))
        step = step.groupBy(*key).agg(F.min("s").alias("s"))
        better = F.coalesce(F.col("s.cost") < F.col("cost") - 1e-12, F.col("s").isNotNull())
        both = labels.join(step, key, "full").withColumn("better", better)
        new = written(both.select(*key, F.when(F.col("better"), F.col("s.cost")).otherwise(F.col("cost")).alias("cost"), F.when(F.col("better"), F.col("s.in_link")).otherwise(F.col("before")).alias("before"), "better"), "labels")
        discarded(labels)
        labels, fresh = new.drop("better"), new.where("better").drop("better")
        if fresh.isEmpty():
            break
    else:
        raise RuntimeError("costs still improve after the last round")
    wanted = tasks.select("source", "t_start", F.explode("targets").alias("target")).where("source <> target").distinct()
    ends = wanted.join(links.select(F.col("id").alias("id_link"), F.col("to_node").alias("target")), "target").join(labels, key)
    now = ends.groupBy("source", "target", "t_start").agg(F.min(F.struct("cost", "id_link")).alias("e")).select("source", "target", "t_start", F.col("e.id_link").alias("id_link"), F.lit(0).alias("back"))
    parts = []
    for k in range(rounds):
        parts.append(written(now.join(labels, key), "path-links"))
        now = parts[-1].where("before is not null").select("source", "target", "t_start", F.col("before").alias("id_link"), F.lit(k + 1).alias("back"))
        if now.isEmpty():
            break
    every = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()]) if any(p.inputFiles() for p in parts) else parts[0]
    g = every.groupBy("source", "target", "t_start").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("k"), "id_link", "cost"))).alias("p"))  # one path's links
    return g.select("source", "target", "t_start", F.element_at("p.cost", -1).alias("tot_cost"), F.col("p.id_link").alias("links"), F.col("p.cost").alias("costs"))


def paths_between(tasks: DataFrame, links: DataFrame, turns: DataFrame, slice_minutes: float = 15.0) -> DataFrame:
    """Shortest paths on a network of any size: by searches on a broadcast graph where it is small enough, else by joins."""
    if links.count() <= MAX_LINKS:
        return shortest_paths(tasks, graph(links, turns, slice_minutes))
    return relaxed_paths(tasks, links, turns, slice_minutes)


def path_costs(paths: DataFrame, links: DataFrame, key: str = "path") -> DataFrame:
    """Minutes of each path by constant link minutes, and its links: (path, tot_cost, n_links)."""
    e = paths.select(key, F.explode("links").alias("id")).join(links.select("id", "minutes"), "id")
    return e.groupBy(key).agg(F.sum("minutes").alias("tot_cost"), F.count(F.lit(1)).alias("n_links"))


def timed_cost(minutes: Column, slice_minutes: float, start: Column) -> Column:
    """Minutes along a path given each link's minutes by slice (array of arrays), entered when the one before is left;
    past the last slice its value holds."""
    at = lambda m, t: F.element_at(m, F.least(F.floor((start + t) / slice_minutes).cast("int"), F.size(m) - 1) + 1)
    return F.aggregate(minutes, F.lit(0.0), lambda t, m: t + at(m, t))


def assignment_matrix(paths: DataFrame, detectors: DataFrame, slice_minutes: float = 15.0) -> DataFrame:
    """(t_enter, t_start, id_link, o, d, share): the share of an OD pair's demand of a slice that enters a detector's
    link in a slice; both as slice indices. paths: (o, d, t_start, links, costs, path_flow, demand)."""
    e = paths.select("o", "d", "t_start", "path_flow", "demand", "costs", F.posexplode("links").alias("pos", "id_link"))
    entered = F.col("t_start") + F.when(F.col("pos") == 0, 0.0).otherwise(F.get("costs", F.col("pos") - 1))
    e = e.join(detectors.select("id_link").distinct(), "id_link", "left_semi").withColumn("t_enter", F.floor(entered / slice_minutes).cast("int")).withColumn("t_start", F.floor(F.col("t_start") / slice_minutes).cast("int"))
    return e.groupBy("t_enter", "t_start", "id_link", "o", "d").agg(F.sum(F.try_divide(F.col("path_flow"), F.col("demand"))).alias("share"))


def tasks_of(spark: SparkSession, od: DataFrame) -> DataFrame:
    """One search a source and start: its targets in an array, which has as many entries as the graph has zones."""
    return od.groupBy("source", "t_start").agg(F.array_sort(F.collect_set("target")).alias("targets"))
