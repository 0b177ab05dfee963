"""One function an operation: parameters and tables in, tables out; and a registry of runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.config import layered, overridden, resolved
from roadloom.operators import assign as A
from roadloom.operators import paths as T
from roadloom.operators.clusters import path_clusters
from roadloom.operators.fcd_trips import build_trips
from roadloom.sources.catalog import Dataset, save_state

Tables = Mapping[str, DataFrame]


def static_assignment(tables: Tables, iterations: int = 6, k: int = 3, max_gap: float = 0.01) -> dict[str, DataFrame]:
    """One interval: demand (source, target, demand) on links and turns."""
    paths, links, stats = A.assigned(tables["demand"], tables["links"], tables["turns"], iterations, k, max_gap)
    rows = paths.sparkSession.createDataFrame(stats, "iteration int, total_time double, least_time double, demand double, paths bigint, unique_paths bigint, rgap double")
    return {"paths": paths, "links": A.link_output(links), "statistics": rows}


def dynamic_assignment(tables: Tables, slices: int, **settings: Any) -> dict[str, DataFrame]:
    """Interval after interval: demand (t, source, target, demand), each slice assigned from free flow; results carry t."""
    out: dict[str, DataFrame] = {}
    for t in range(slices):
        got = static_assignment({**tables, "demand": tables["demand"].where(F.col("t") == t).drop("t")}, **settings)
        for name, df in got.items():
            df = df.withColumn("t", F.lit(t))
            out[name] = out[name].unionByName(df) if name in out else df
    return out


def od_estimation(tables: Tables, whiskers: int = 1, rounds: int = 1, **settings: Any) -> dict[str, DataFrame]:
    """Assignment and estimation in turn: prior (o, d, value), counts (id_link, count), links, turns."""
    demand = tables["prior"]
    for _ in range(max(1, rounds) + max(0, whiskers - 1)):
        od = demand.select(F.col("o").alias("source"), F.col("d").alias("target"), F.col("value").alias("demand"))
        paths = static_assignment({**tables, "demand": od}, **settings)["paths"]
        shares = paths.select(F.col("source").alias("o"), F.col("target").alias("d"), F.lit(0.0).alias("t_start"), "links", F.transform("links", lambda _: F.lit(0.0)).alias("costs"), "path_flow", "demand")
        m = T.assignment_matrix(shares, tables["counts"]).groupBy("id_link", "o", "d").agg(F.sum("share").alias("share"))
        demand, _ = A.estimated(tables["prior"], m, tables["counts"])
    return {"demand": demand}


def paths_calculation(tables: Tables, slice_minutes: float = 15.0) -> dict[str, DataFrame]:
    """Shortest paths of tasks (source, target, t_start) on links with minutes by slice."""
    g = T.graph(tables["links"], tables["turns"], slice_minutes)
    return {"paths": T.shortest_paths(T.tasks_of(tables["tasks"].sparkSession, tables["tasks"]), g)}


def trips(tables: Tables) -> dict[str, DataFrame]:
    return {"trips": build_trips(tables["fcd"])}


def paths_clustering(tables: Tables, eps: float = 100.0) -> dict[str, DataFrame]:
    return {"clusters": path_clusters(tables["paths"], eps)}


def observed_paths(paths: DataFrame, day_type: str, t: int, minutes: int, modes: DataFrame, zones: DataFrame) -> DataFrame:
    """Observed paths of a day type that start in [t, t + minutes), a null mode standing for each mode, with both ends in
    the zones."""
    p = paths.where((F.col("day_type") == day_type) & (F.col("t_start") >= t) & (F.col("t_start") < t + minutes))
    named = p.where("mode is not null").unionByName(p.where("mode is null").drop("mode").crossJoin(modes.select(F.col("code").alias("mode"))).select(*p.columns))  # modes: a handful
    ends = zones.select(F.col("id").alias("source"))
    return named.join(ends, "source", "left_semi").join(ends.withColumnRenamed("source", "target"), "target", "left_semi")


def changed_trips(new: DataFrame, old: DataFrame) -> DataFrame:
    """New trips, and those whose end differs from the old one's."""
    o = old.select(F.col("id_trip").alias("__id"), F.col("dt_d").alias("dt_d_old"))
    j = new.join(o, F.col("id_trip") == F.col("__id"), "left").drop("__id")
    return j.withColumn("change", F.when(F.col("dt_d_old").isNull(), "new").when(~F.col("dt_d").eqNullSafe(F.col("dt_d_old")), "changed")).where("change is not null")


OPS: dict[str, Callable[..., dict[str, DataFrame]]] = {f.__name__: f for f in (static_assignment, dynamic_assignment, od_estimation, paths_calculation, trips, paths_clustering)}


@contextmanager
def recorded(spark: SparkSession, folder: str | None, op: str) -> Iterator[str]:
    """Keeps a row for the run's start and one for its end (completed or failed, with seconds and message)."""
    key, began = uuid.uuid4().hex, time.time()

    def note(status: str, message: str = "") -> None:
        if folder:
            row = [(key, op, status, time.time() - began, message)]
            spark.createDataFrame(row, "id string, op string, status string, seconds double, message string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/runs")

    note("pending")
    try:
        yield key
    except Exception as e:
        note("failed", str(e)[:1000])
        raise
    note("completed")


def run(spark: SparkSession, *layers: Mapping[str, Any] | str, options: tuple[str, ...] = (), runs: str | None = None) -> dict[str, DataFrame]:
    """Runs the operation that the parameters name: {"op": ..., "settings": {...}, "inputs": {name: Dataset fields},
    "outputs": {name: Dataset fields}}; earlier layers prevail. Outputs that are named are written."""
    params = resolved(overridden(layered(list(layers)), options))
    if params.get("op") not in OPS:
        raise ValueError(f"unknown operation {params.get('op')!r}; there are: {', '.join(sorted(OPS))}")
    with recorded(spark, runs, params["op"]):
        tables = {k: Dataset(**v).read(spark) for k, v in params.get("inputs", {}).items()}
        out = OPS[params["op"]](tables, **params.get("settings", {}))
        for name, spec in params.get("outputs", {}).items():
            if "state" in spec:
                save_state(out[name], spec["state"], name, spec["keys"])
            else:
                Dataset(**{k: v for k, v in spec.items() if k != "mode"}).write(out[name], spec.get("mode", "w"))
    return out
