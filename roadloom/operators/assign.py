"""Assignment by successive averages, static loading, and demand estimation from counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.scalars import bpr
from roadloom.operators.network import path_flows
from roadloom.operators.paths import path_costs, paths_between, tasks_of
from roadloom.session import discarded, written

Vdf = Callable[[Column, Column, Column], Column]


def loaded(links: DataFrame, flows: DataFrame, vdf: Vdf = bpr) -> DataFrame:
    """Links with flow and minutes under it."""
    f = flows.select(F.col("id_link").alias("id"), "flow")
    return links.drop("flow").join(f, "id", "left").withColumn("flow", F.coalesce("flow", F.lit(0.0))).withColumn("minutes", vdf(F.col("t0"), F.col("flow"), F.col("capacity").cast("double")))


def expanded(od: DataFrame, total: float) -> DataFrame:
    """Demand raised or lowered alike so that it adds up to a total, as a survey's is to a count; empty stays empty."""
    whole = od.agg(F.sum("demand").alias("__all"))  # one row
    return od.crossJoin(whole).withColumn("demand", F.try_divide(F.col("demand") * total, F.col("__all"))).drop("__all")


def assigned(od: DataFrame, links: DataFrame, turns: DataFrame, iterations: int = 6, k: int = 3, max_gap: float = 0.01, vdf: Vdf = bpr) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Paths with flows, loaded links and statistics by iteration, of od (source, target, demand) on links (id,
    from_node, to_node, t0, capacity).

    The first k iterations each add a shortest path and split the demand equally over the pair's paths; later ones move
    1 / n of the demand to its cheapest path. A pair's flows always add up to its demand. Stops once the relative gap,
    looked at from the third iteration on, is below max_gap. Each iteration's paths are a written table: the plan stays
    short, and lost executors cost no iteration. Pairs that no path joins have no rows.
    """
    links = written(links.select("id", "from_node", "to_node", "t0", "capacity", F.col("t0").alias("minutes")), "links")
    od = written(od.groupBy("source", "target").agg(F.sum("demand").alias("demand")), "demand")
    tasks = tasks_of(od.sparkSession, od.withColumn("t_start", F.lit(0.0)))
    paths: DataFrame | None = None
    stats: list[dict] = []
    for i in range(iterations):
        if i < k:
            new = paths_between(tasks, links.withColumn("minutes", F.array("minutes")), turns).select("source", "target", F.lit(i).alias("k"), "links")
            paths = new if paths is None else paths.select("source", "target", "k", "links").unionByName(new)
            paths = paths.join(od, ["source", "target"]).withColumn("path_flow", F.col("demand") / (i + 1))
        else:
            best = F.struct("tot_cost", "k")
            costed = _costed(paths, links)
            first = costed.groupBy("source", "target").agg(F.min(best).alias("b")).select("source", "target", F.col("b.k").alias("best_k"))
            n = i + 1
            moved = F.col("path_flow") * ((n - 1) / n) + F.when(F.col("k") == F.col("best_k"), F.col("demand") / n).otherwise(0.0)
            paths = costed.join(first, ["source", "target"]).withColumn("path_flow", moved).drop("best_k", "tot_cost", "n_links")
        paths = written(paths, "paths")
        flows = path_flows(paths, ("id_link",))
        links = written(loaded(links, flows, vdf), "links")
        costed = _costed(paths, links)
        key = costed.groupBy("source", "target").agg(F.sum(F.col("path_flow") * F.col("tot_cost")).alias("tt"), F.max("demand").alias("f"), F.min("tot_cost").alias("least"), F.count(F.lit(1)).alias("n"), F.countDistinct("links").alias("u"))
        row = key.agg(F.sum("tt").alias("total_time"), F.sum(F.col("f") * F.col("least")).alias("least_time"), F.sum("f").alias("demand"), F.sum("n").alias("paths"), F.sum("u").alias("unique_paths")).first()
        gap = abs(row["total_time"] - row["least_time"]) / row["least_time"] if row["least_time"] else 0.0
        stats.append({"iteration": i, **row.asDict(), "rgap": gap})
        if i > 1 and gap < max_gap:
            break
    return paths, links, stats


def _costed(paths: DataFrame, links: DataFrame) -> DataFrame:
    p = paths.withColumn("path", F.struct("source", "target", "k"))
    return p.join(path_costs(p, links), "path").drop("path")


def link_output(links: DataFrame) -> DataFrame:
    """(id, flow, minutes, speed_share, saturation); without capacity the saturation is null."""
    return links.select("id", "flow", "minutes", F.try_divide(F.col("t0"), F.col("minutes")).alias("speed_share"), F.try_divide(F.col("flow"), F.col("capacity").cast("double")).alias("saturation"))


def estimated(prior: DataFrame, matrix: DataFrame, counts: DataFrame, gamma1: float = 0.5, gamma2: float = 0.5, iterations: int = 20, longest: float = 0.05) -> tuple[DataFrame, list[float]]:
    """Demand (o, d, value) that agrees with counts: least gamma1 * |g - prior|^2 + gamma2 * |M g - c|^2.

    matrix: (id_link, o, d, share); counts: (id_link, count). Each step goes along g * (1 - step * slope), slope the
    gradient scaled to its largest value. As M g is linear in the step, the aim is a parabola in it: one distributed
    aggregation gives its three coefficients, and golden section finds the step in [0, longest] on the driver without
    touching the data. Negative demand becomes 1. Returns the demand and the aim before each step and at the end.
    """
    g = written(prior.select("o", "d", F.col("value").alias("prior"), F.col("value").alias("g")), "demand")
    m = written(matrix.join(counts.select("id_link"), "id_link", "left_semi"), "matrix")
    aims: list[float] = []
    for _ in range(iterations):
        fitted = m.join(g, ["o", "d"]).groupBy("id_link").agg(F.sum(F.col("share") * F.col("g")).alias("mg"))
        residual = counts.join(fitted, "id_link", "left").select("id_link", (F.coalesce("mg", F.lit(0.0)) - F.col("count")).alias("r"))
        pull = m.join(residual, "id_link").groupBy("o", "d").agg(F.sum(F.col("share") * F.col("r")).alias("pull"))
        s = written(g.join(pull, ["o", "d"], "left").withColumn("slope", gamma1 * (F.col("g") - F.col("prior")) + gamma2 * F.coalesce("pull", F.lit(0.0))), "slope")
        top = s.agg(F.max(F.abs("slope"))).first()[0]
        if not top:
            break
        move = F.col("g") * F.col("slope") / F.lit(top)
        own = s.agg(F.sum(F.pow(F.col("g") - F.col("prior"), 2)).alias("a"), F.sum((F.col("g") - F.col("prior")) * move).alias("b"), F.sum(F.pow(move, 2)).alias("c")).first()
        shift = m.join(s.select("o", "d", move.alias("move")), ["o", "d"]).groupBy("id_link").agg(F.sum(F.col("share") * F.col("move")).alias("h"))
        fit = residual.join(shift, "id_link", "left").select("r", F.coalesce("h", F.lit(0.0)).alias("h")).agg(F.sum(F.pow("r", 2)).alias("a"), F.sum(F.col("r") * F.col("h")).alias("b"), F.sum(F.pow("h", 2)).alias("c")).first()
        a, b, c = (gamma1 * own[k] + gamma2 * (fit[k] or 0.0) for k in ("a", "b", "c"))
        aims.append(a)
        step = golden(lambda x: a - 2 * b * x + c * x * x, 0.0, longest * top)  # noqa: B023
        moved = F.col("g") - move * step
        old, g = g, written(s.select("o", "d", "prior", F.when(moved < 0, 1.0).otherwise(moved).alias("g")), "demand")
        discarded(old)
        discarded(s)
        if a - (a - 2 * b * step + c * step * step) <= 1e-9 * max(1.0, a):
            break
    return g.select("o", "d", F.col("g").alias("value")), aims


def golden(f: Callable[[float], float], low: float, high: float, rounds: int = 100, tolerance: float = 1e-10) -> float:
    """The place of the least value of a function with one valley in [low, high]."""
    ratio = (np.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if high - low <= tolerance * max(1.0, abs(high)):
            break
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return min((low, (low + high) / 2, high), key=f)
