"""Queries of the iterative, geometric and streaming operators; SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.wkb import decode, encode_line
from roadloom.operators import assign as A
from roadloom.operators import clusters as C
from roadloom.operators import network as N
from roadloom.operators import paths as T
from roadloom.operators import simulate as V
from roadloom.operators.delivery import first_delivery
from roadloom.operators.fcd_trips import build_trips
from roadloom.operators.matching import nearest_link
from roadloom.operators.reconstruct import rebuilt
from roadloom.operators.spatial import regions
from roadloom.plans.engine_queries import _PINGS
from roadloom.session import collected, shared_folder, table, written
from roadloom.streaming import fcd as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _network(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Links with free-flow minutes, and turns with penalties by class, u-turns forbidden."""
    links = N.built(table(s, d, "links"))
    penalty = N.turn_penalties(links).withColumn("penalty", F.when(F.col("penalty") >= 7 / 60, float("inf")).otherwise(F.col("penalty")))
    return links.select("id", "from_node", "to_node", "t0", "capacity", F.col("t0").alias("minutes")), penalty


def _node_demand(s: SparkSession, d: str) -> DataFrame:
    """Trips between the nodes nearest to the middle of their zones, a day's demand as vehicles an hour."""
    zones = regions(table(s, d, "zones")).select(F.col("cid").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    links = table(s, d, "links")
    node = nearest_link(zones, N.segments(links), 3000.0).join(links.select(F.col("id").alias("id_link"), "from_node"), "id_link").select(F.col("id").alias("zone"), F.col("from_node").alias("node"))
    t = table(s, d, "trips").select("id_trip", "id_zone_o", "id_zone_d").distinct()
    o, e = node.select(F.col("zone").alias("id_zone_o"), F.col("node").alias("source")), node.select(F.col("zone").alias("id_zone_d"), F.col("node").alias("target"))
    return t.join(o, "id_zone_o").join(e, "id_zone_d").where("source <> target").groupBy("source", "target").agg((F.count(F.lit(1)) * 25.0).alias("demand"))


@query()
def shortest_paths(s: SparkSession, d: str) -> DataFrame:
    links, turns = _network(s, d)
    tasks = T.tasks_of(s, _node_demand(s, d).withColumn("t_start", F.explode(F.array(F.lit(0.0), F.lit(14.0)))))
    return T.paths_between(tasks, links.withColumn("minutes", F.array("minutes", F.col("minutes") * 1.5, "minutes")), turns)


@query()
def relaxed_costs(s: SparkSession, d: str) -> DataFrame:
    """From every node that a link leaves to every link that is reached."""
    links, turns = _network(s, d)
    return T.relaxed_costs(links, turns, links.select(F.col("from_node").alias("source")).distinct())


@query("""SELECT o_orderkey AS path, round(sum(p_retailprice), 2) AS tot_cost, count(*) AS n_links FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def path_costs(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_set("l_partkey").alias("links"))  # at most seven lines an order
    c = T.path_costs(p, table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("minutes")))
    return c.select("path", F.round("tot_cost", 2).alias("tot_cost"), "n_links")


@query("""SELECT id, round(CASE WHEN t0 + 14 < 15 THEN t0 + (CASE WHEN t0 + 14 < 15 THEN t0 ELSE t0 * 2 END) ELSE t0 + 2 * t0 END, 6) AS cost FROM (SELECT id, length::DOUBLE / v0::DOUBLE * 60 AS t0 FROM links)""")
def timed_path_costs(s: SparkSession, d: str) -> DataFrame:
    """Each link driven twice from minute 14, its minutes doubled from the second slice on."""
    links, _ = _network(s, d)
    two = F.array(F.array("t0", F.col("t0") * 2), F.array("t0", F.col("t0") * 2))
    return links.select("id", F.round(T.timed_cost(two, 15.0, F.lit(14.0)), 6).alias("cost"))


def _assigned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[dict]]:
    """The demand expanded to an hour in which the network is congested, so that flows are averaged after k paths."""
    links, turns = _network(s, d)
    return A.assigned(A.expanded(_node_demand(s, d), 200_000.0), links, turns)


@query()
def msa_flows(s: SparkSession, d: str) -> DataFrame:
    return _assigned(s, d)[0].select("source", "target", "k", "demand", "path_flow", F.size("links").alias("n_links"))


@query()
def relative_gap(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(_assigned(s, d)[2], "iteration int, total_time double, least_time double, demand double, paths bigint, unique_paths bigint, rgap double")


@query()
def static_loading(s: SparkSession, d: str) -> DataFrame:
    return A.link_output(_assigned(s, d)[1])


def _shares(s: SparkSession, d: str) -> DataFrame:
    links, turns = _network(s, d)
    od = _node_demand(s, d)
    paths = T.paths_between(T.tasks_of(s, od.withColumn("t_start", F.lit(0.0))), links.withColumn("minutes", F.array("minutes")), turns).join(od, ["source", "target"])
    p = paths.select(F.col("source").alias("o"), F.col("target").alias("d"), "t_start", "links", "costs", F.col("demand").alias("path_flow"), "demand")
    return T.assignment_matrix(p, table(s, d, "links").where("lanes >= 2").select(F.col("id").alias("id_link")))


@query()
def assignment_matrix(s: SparkSession, d: str) -> DataFrame:
    return _shares(s, d)


@query()
def od_estimate(s: SparkSession, d: str) -> DataFrame:
    m = written(_shares(s, d).groupBy("id_link", "o", "d").agg(F.sum("share").alias("share")), "shares")
    prior = written(_node_demand(s, d).select(F.col("source").alias("o"), F.col("target").alias("d"), F.col("demand").alias("value")), "prior")
    counts = m.join(prior, ["o", "d"]).groupBy("id_link").agg((F.sum(F.col("share") * F.col("value")) * 1.2).alias("count"))
    counts = written(counts, "counts")
    return A.estimated(prior, m, counts, iterations=100)[0]  # the reference's number, unless the aim stops falling before


@query()
def trip_paths(s: SparkSession, d: str) -> DataFrame:
    """Links that the trips of the trips table took, by their lines."""
    links, turns = _network(s, d)
    shaped = table(s, d, "links").select("id", N.vertices(F.col("geometry")).alias("v")).where(F.size("v") > 0)
    g = T.graph(links.join(shaped.select("id"), "id", "left_semi").withColumn("minutes", F.array("minutes")), turns)
    shapes = {r[0]: np.array([(p.x, p.y) for p in r[1]]) for r in collected(shaped, "shapes of links", 2 * F.size("v"))}
    t = table(s, d, "trips").select("id_trip", "loaded_at", N.vertices(F.col("geometry")).alias("xy"))
    return rebuilt(first_delivery(t, F.col("id_trip"), "loaded_at", ["xy"], "id_trip"), g, shapes, 1500.0)


@query(r"""WITH t AS (SELECT id_trip, regexp_extract_all(regexp_extract(geometry, '[(\[].*'), '-?\d+(?:\.\d+)?') AS n FROM trips WHERE id_trip IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_trip ORDER BY loaded_at, geometry) = 1)
SELECT id_trip, CAST(len(n) // 2 AS BIGINT) AS n_vertices, round(list_sum(list_transform(generate_series(1, len(n) // 2), lambda i: CAST(n[2*i-1] AS DOUBLE) * i)), 2) AS sum_x, round(list_sum(list_transform(generate_series(1, len(n) // 2), lambda i: CAST(n[2*i] AS DOUBLE) * i)), 2) AS sum_y FROM t""")
def wkb_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Vertices of each trip's line after writing it as WKB and reading that: their number, and coordinates weighted by
    position."""
    t = table(s, d, "trips").select("id_trip", "loaded_at", N.vertices(F.col("geometry")).alias("xy"))
    one = first_delivery(t, F.col("id_trip"), "loaded_at", ["xy"], "id_trip").select("id_trip", decode(encode_line("xy")).alias("g"))
    p = F.col("g.parts")[0]
    total = lambda c: F.round(F.aggregate(F.transform(p, lambda v, i: v[c] * (i + 1)), F.lit(0.0), lambda a, b: a + b), 2)
    return one.select("id_trip", F.size(p).cast("bigint").alias("n_vertices"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query()
def trips_full(s: SparkSession, d: str) -> DataFrame:
    return build_trips(table(s, d, "fcd"))


@query("""WITH RECURSIVE p AS (SELECT vec_id, label, embedding FROM embeddings), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.embedding[1] >= b.embedding[1] - 0.05 AND a.embedding[1] <= b.embedding[1] + 0.05),
r(id, c) AS (SELECT vec_id, vec_id FROM p UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b) SELECT id, min(c) AS component FROM r GROUP BY 1""")
def components(s: SparkSession, d: str) -> DataFrame:
    """Components of vectors of one label whose first values, sorted, are at most 0.05 apart: an edge to the next is enough."""
    from pyspark.sql import Window as W

    e = table(s, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("v"))
    w = W.partitionBy("label").orderBy("v", "vec_id")
    near = F.lead("v").over(w) - F.col("v") <= F.lit(0.05).cast("float")
    return C.components(e.select(F.col("vec_id").alias("a"), F.when(near, F.lead("vec_id").over(w)).otherwise(F.col("vec_id")).alias("b")))


@query()
def path_clusters(s: SparkSession, d: str) -> DataFrame:
    t = first_delivery(table(s, d, "trips"), F.col("id_trip"), "loaded_at", ["id_zone_o", "id_zone_d", "tt", "geometry"], "id_trip").where("id_zone_o is not null and id_zone_d is not null")
    p = t.select(F.col("id_zone_o").alias("source"), F.col("id_zone_d").alias("target"), F.col("id_trip").alias("id"), F.col("tt").alias("tot_cost"), N.vertices(F.col("geometry")).alias("xy"))
    return C.path_clusters(p, 1500.0)


@query()
def vehicle_loading(s: SparkSession, d: str) -> DataFrame:
    rows = sorted(collected(N.built(table(s, d, "links")).select("id", "length", "v0", "capacity", "lanes", "alpha", "rcr"), "links"))
    a = np.array([r[1:] for r in rows], float)
    net = V.Network([r[0] for r in rows], *a.T)
    links, turns = _network(s, d)
    od = _node_demand(s, d)
    g = T.graph(links.withColumn("minutes", F.array("minutes")), turns)
    paths = collected(T.shortest_paths(T.tasks_of(s, od.withColumn("t_start", F.lit(0.0))), g).join(od, ["source", "target"]).select("links", "demand"), "paths", F.size("links"))
    flows = sorted(([r[0]], [1.0], [r[1] / 4] * 2) for r in paths)
    return V.simulated(net, flows, s.range(2).select(F.col("id").alias("seed")), 60.0)


def _run(s: SparkSession, d: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The whole table as a stream of eight files a batch: the horizon is its lateness, and what is in state at the end
    comes out too."""
    folder, own = f"{d}/fcd.parquet", f"{shared_folder(s)}/roadloom-stream-{uuid.uuid4().hex}"
    fcd = s.read.parquet(folder)
    late = R.lateness(fcd) + 60
    newest = F.coalesce(F.max("ts"), F.lit("2000-01-01").cast(fcd.schema["ts"].dataType))
    last = {"id_fcd": F.lit("-1"), "id_veh": F.lit(""), "ts": newest + F.make_dt_interval(secs=F.lit(late + 86_400)), "x": F.lit(0.0), "y": F.lit(0.0)}
    end = fcd.agg(*(last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fcd.schema))
    pings = R.pings(s, f"{folder}*", fcd.schema, f"{late} seconds", 8, f"{own}-end*")
    return R.run_whole(made(pings), own, f"{own}-end", end)


@query(f"""WITH {_PINGS.replace("SELECT id, id_veh, ts, engine,", "SELECT id, id_veh, ts, speed::DOUBLE AS speed,")}
SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS slice, id_veh, avg(speed) AS speed, count(speed) AS n FROM p WHERE speed IS NOT NULL AND id_veh IS NOT NULL GROUP BY ALL""")
def stream_slice_speeds(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, R.slice_speeds)


@query(f"""WITH {_PINGS}, g AS (SELECT id_veh, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new FROM p WHERE id_veh IS NOT NULL WINDOW w AS (PARTITION BY id_veh ORDER BY ts)),
k AS (SELECT *, sum(new) OVER (PARTITION BY id_veh ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT id_veh, min(ts) AS started, max(ts) + INTERVAL 15 MINUTE AS ended, count(*) AS n FROM k GROUP BY id_veh, k""")
def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, R.gap_sessions)


@query()
def stream_trips(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, R.streamed_trips)
