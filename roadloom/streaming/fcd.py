"""The streaming side: late and repeated pings, link speeds by slice, trips with carried-over state, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from roadloom.functions.geo import number_id, with_place
from roadloom.operators.fcd_trips import Rules, cut_so_far


def pings(spark: SparkSession, folder: str, schema: StructType, horizon: str = "60 minutes", files: int = 1, ends: str | None = None) -> DataFrame:
    """A stream of pings (id, id_veh, ts, engine, speed, x, y, progr) from a folder of parquet files, each id once.

    The horizon is the watermark: a ping later than that behind the newest is dropped, and so is the memory of an id.
    ends: a second folder, for the ping that run_whole adds at the end.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    if ends:
        raw = raw.unionByName(spark.readStream.schema(schema).parquet(ends))
    p = with_place(raw.select("geometry", "x", "y", number_id(F.col("id_fcd")).alias("id"), "id_veh", F.col("ts").cast("timestamp").alias("ts"), "engine", "speed", "heading", F.col("progr").cast("double").alias("progr")))
    p = p.where("id is not null and ts is not null and x is not null and id_veh is not null")
    return p.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["id"])


def slice_speeds(p: DataFrame, key: str = "id_veh", width: str = "15 minutes") -> DataFrame:
    """Mean speed and readings by key and slice; a slice is emitted once the watermark has passed it."""
    g = p.where("speed is not null").groupBy(F.window("ts", width), key).agg(F.avg("speed").alias("speed"), F.count("speed").alias("n"))
    return g.select(F.col("window.start").alias("slice"), key, "speed", "n")


def gap_sessions(p: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Sessions of each vehicle parted by silence alone."""
    g = p.groupBy(F.session_window("ts", gap), "id_veh").agg(F.count(F.lit(1)).alias("n"))
    return g.select("id_veh", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


TRIP = "id_veh string, id_trip bigint, id_last bigint, dt_o timestamp, dt_d timestamp, n bigint, dist double"
_STATE = "seen double, t array<double>, x array<double>, y array<double>, engine array<int>, progr array<double>, id array<bigint>"


def streamed_trips(p: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Trips of each vehicle as they end: state is the pings of the unfinished trip, carried from batch to batch, and the
    watermark up to which they are known.

    A trip is sent out once it is over by the rules and the watermark is past the ping that shows it, or silence_s past
    its last ping. A ping behind the watermark of the vehicle's last batch is dropped, so nothing joins or overlaps a
    trip sent out; the memory of that outlasts the trip by a batch, after which Spark itself drops such pings. Input
    that is late by the horizon at most gives the trips of the batch builder, unjoined.
    """
    rules = rules or Rules()
    names = ["t", "x", "y", "engine", "progr", "id"]

    def moment(seconds: float) -> pd.Timestamp:
        return pd.Timestamp(round(seconds * 1e6), unit="us")

    def rows(key: tuple, a: dict[str, np.ndarray], trips: list[list[int]]) -> pd.DataFrame:
        out = [(key[0], int(a["id"][k[0]]), int(a["id"][k[-1]]), moment(a["t"][k[0]]), moment(a["t"][k[-1]]), len(k), float(np.hypot(np.diff(a["x"][k]), np.diff(a["y"][k])).sum())) for k in map(np.array, trips)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRIP.split(", ")])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, *held = state.get if state.exists else (-np.inf, *[[]] * len(names))
        a = dict(zip(names, (np.asarray(v, float) for v in held), strict=True))
        if not state.hasTimedOut:
            new = pd.concat(list(batches))
            new = new.assign(t=new.ts.astype("int64") / (1e9 if str(new.ts.dtype).startswith("datetime64[ns") else 1e6), engine=new.engine.fillna(1), progr=new.progr.astype(float))
            new = new[new.t > seen]
            a = {n: np.concatenate([a[n], new[n].to_numpy(float)]) for n in names}
            order = np.lexsort((a["id"], a["t"]))
            a = {n: v[order] for n, v in a.items()}
        mark = state.getCurrentWatermarkMs()
        t = a["t"]
        known = int(np.searchsorted(t, mark / 1000, side="right"))  # no ping can come before these any more
        # settled: everything before the first silence that the watermark hasn't passed; a silence parts trips whatever follows
        ends = np.r_[np.flatnonzero(np.diff(t) > rules.silence_s), len(t) - 1].astype(int) if len(t) else np.zeros(0, int)
        due = ((t[ends] + rules.silence_s) * 1000).astype(np.int64)
        passed = int(np.searchsorted(due, mark))
        begin = int(ends[passed - 1]) + 1 if passed else 0
        cut = lambda a, upto: cut_so_far(a["t"], a["x"], a["y"], a["engine"], a["progr"], rules, upto)
        if begin:
            done = {n: v[:begin] for n, v in a.items()}
            trips, _, last = cut(done, begin)
            yield rows(key, done, trips + last)
        rest = {n: v[begin:] for n, v in a.items()}
        if known - begin > 1:  # and, of what goes on, every trip that is over
            trips, first, _ = cut(rest, known - begin - 1)
            if first:
                yield rows(key, rest, trips)
                rest = {n: v[first:] for n, v in rest.items()}
        left = len(rest["t"])
        if not left and state.hasTimedOut:
            state.remove()
            return
        state.update((max(seen, mark / 1000), rest["t"].tolist(), rest["x"].tolist(), rest["y"].tolist(), rest["engine"].astype(int).tolist(), rest["progr"].tolist(), rest["id"].astype(int).tolist()))
        state.setTimeoutTimestamp(max(int(due[passed]) if left else 0, mark + 1))

    slim = p.select("id_veh", "id", "ts", "x", "y", F.col("engine").cast("int").alias("engine"), "progr")
    return slim.groupBy("id_veh").applyInPandasWithState(step, TRIP, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def by_batch(folder: str, start: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: a batch's rows replace its own folder, so a repeated batch leaves one copy; rows before
    `start` are left out."""

    def write(df: DataFrame, batch: int) -> None:
        if start:
            df = df.where(F.col(df.columns[0]) >= F.lit(start).cast("timestamp"))
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def run_available(df: DataFrame, folder: str, mode: str = "append", **options: Any) -> DataFrame:
    """Runs a stream over all that is there now, with its checkpoint beside its results, and reads these."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").options(**options).trigger(availableNow=True).foreachBatch(by_batch(f"{folder}/rows")).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows").drop("batch")


def lateness(df: DataFrame) -> int:
    """Seconds, rounded up, by which a ping of a table of files may be behind the newest read before it, whatever files
    of one modification time come first."""
    f = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max("_metadata.file_modification_time").alias("at"), F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("z"))
    newest = F.max("z").over(W.orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))  # one row a file
    return f.select(F.ceil(newest.cast("double") - F.col("a").cast("double")).alias("s")).agg(F.max("s")).first()[0] or 0


def run_whole(df: DataFrame, folder: str, ends: str, end: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a bounded stream over all that is there, then once more with a last ping so far ahead that the watermark
    passes all that is still in state; df reads that ping from the folder ends, and it gives no row itself."""
    run_available(df, folder, mode)
    end.coalesce(1).write.parquet(ends)
    return run_available(df, folder, mode)
