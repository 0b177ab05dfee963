"""Queries of the traffic engine's own operators, each with the SQL that checks it.

Demand uses the star schema as stand-in (zones are nations, a mode is a return flag); network, matching and sequences
use the road tables. Values are rounded alike on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions import predicates as P
from roadloom.functions import scalars as X
from roadloom.operators import demand as D
from roadloom.operators import matching as M
from roadloom.operators import network as N
from roadloom.operators import series as S
from roadloom.operators.delivery import first_pings
from roadloom.session import table

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


def r(c: str, digits: int = 4) -> str:
    return f"round({c}, {digits})"


# --- demand -------------------------------------------------------------------------------------------------------

_OD = """od AS (SELECT c_nationkey AS o, s_nationkey AS d, month(o_orderdate) AS t, l_returnflag AS mode, sum(l_quantity) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_quantity > 0 AND c_nationkey <> s_nationkey GROUP BY ALL)"""


def _od(s: SparkSession, d: str, mode: bool = True) -> DataFrame:
    j = table(s, d, "lineitem").where("l_quantity > 0").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.select(F.col("c_nationkey").alias("o"), F.col("s_nationkey").alias("d"), F.month("o_orderdate").alias("month"), F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("value"))
    return D.binned(j, F.col("month"), 0, 1, 13, ("o", "d", "mode") if mode else ("o", "d"))


@query(f"WITH {_OD} SELECT t, o, d, mode, value, round(value / sum(value) OVER (PARTITION BY t, o, d), 6) AS share FROM od")
def od_demand_share(s: SparkSession, d: str) -> DataFrame:
    return D.shares(_od(s, d)).select("t", "o", "d", "mode", "value", F.round("share", 6).alias("share"))


_ODT = _OD.replace("l_returnflag AS mode, ", "")


@query(f"""WITH {_ODT}, z AS (SELECT n_nationkey AS zone FROM nation), ts AS (SELECT DISTINCT t FROM od)
SELECT ts.t, a.zone AS o, b.zone AS d, CASE WHEN a.zone = b.zone THEN 0.0 ELSE coalesce(od.value, 0.0) END AS value
FROM ts CROSS JOIN z a CROSS JOIN z b LEFT JOIN od ON od.t = ts.t AND od.o = a.zone AND od.d = b.zone""")
def od_matrix_grid(s: SparkSession, d: str) -> DataFrame:
    od = _od(s, d, False)
    return D.grid(od, table(s, d, "nation").select(F.col("n_nationkey").alias("zone")), od.select("t").distinct())


@query(f"""WITH {_ODT}, g AS (SELECT o, d, t, sum(value) AS value, grouping(o, d, t) AS g FROM od GROUP BY GROUPING SETS ((), (o), (d), (t)))
SELECT CASE g WHEN 7 THEN 'all' WHEN 3 THEN 'o' WHEN 5 THEN 'd' ELSE 't' END AS axis, CAST(coalesce(o, d, t) AS BIGINT) AS key, value FROM g""")
def od_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return D.axis_sums(_od(s, d, False))


def _pair(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    od = _od(s, d)
    return tuple(od.where(F.col("mode") == m).drop("mode") for m in ("R", "A"))


for _op, _name, _expr in (("+", "od_add", "coalesce(a.value, 0) + coalesce(b.value, 0)"), ("-", "od_sub", "coalesce(a.value, 0) - coalesce(b.value, 0)"), ("*", "od_mul", "coalesce(a.value, 0) * coalesce(b.value, 0)"), ("/", "od_div", "round(coalesce(a.value, 0) / nullif(coalesce(b.value, 0), 0), 6)"), ("merge", "od_merge", "coalesce(b.value, a.value)")):
    QUERIES[_name] = lambda s, d, op=_op: D.combine(*_pair(s, d), op).withColumn("value", F.round("value", 6)) if op == "/" else D.combine(*_pair(s, d), op)
    SQL[_name] = f"WITH {_OD}, a AS (SELECT * FROM od WHERE mode = 'R'), b AS (SELECT * FROM od WHERE mode = 'A') SELECT t, o, d, {_expr} AS value FROM a FULL JOIN b USING (t, o, d)"


@query(f"WITH {_ODT} SELECT t, d AS o, o AS d, value / 2 AS value FROM od")
def od_transpose_scaled(s: SparkSession, d: str) -> DataFrame:
    return D.scaled(D.transposed(_od(s, d, False)), "/", 2.0)


@query()
def od_inverse(s: SparkSession, d: str) -> DataFrame:
    od = _od(s, d, False).select(F.col("t").cast("int"), F.col("o").cast("bigint"), F.col("d").cast("bigint"), "value")
    eye = table(s, d, "nation").select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("t"), F.col("n_nationkey").cast("bigint").alias("o"), F.col("n_nationkey").cast("bigint").alias("d"), F.lit(1e6).alias("value"))
    return D.inverted(od.unionByName(eye))


@query("SELECT CAST(floor((hour(dt_o) * 60 + minute(dt_o)) / 60) AS INT) AS hour, count(*) AS trips, round(sum(tt), 2) AS tt FROM trips WHERE (hour(dt_o) * 60 + minute(dt_o)) >= 1320 OR (hour(dt_o) * 60 + minute(dt_o)) < 120 GROUP BY ALL")
def demand_midnight_wrap(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trips").withColumn("m", X.minute_of_timestamp(F.col("dt_o")))
    return t.where(P.in_window(F.col("m"), 1320, 1560)).groupBy(F.floor(F.col("m") / 60).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("trips"), F.round(F.sum("tt"), 2).alias("tt"))


@query("SELECT id_link AS id, slot_ts AS timestamp, round(sum(flow_in::DOUBLE * CASE WHEN mode = 'c' THEN 1.5 ELSE 1 END), 2) AS eq_counts FROM aggregated_results GROUP BY ALL")
def weighted_counts(s: SparkSession, d: str) -> DataFrame:
    counts = table(s, d, "aggregated_results").select(F.col("id_link").alias("id"), F.col("slot_ts").alias("timestamp"), "mode", F.col("flow_in").cast("double").alias("counts"))
    modes = s.createDataFrame([("c", 1.5), ("h", 2.0)], "code string, eq_factor double")
    return D.weighted_counts(counts, modes).withColumn("eq_counts", F.round("eq_counts", 2))


@query(f"""WITH {_ODT}, m AS (SELECT o, d, t % 4 AS slice, value / sum(value) OVER (PARTITION BY o) AS share FROM od)
SELECT o, slice, round(sum(share * c), 6) AS value FROM m JOIN (SELECT c_nationkey AS d, count(*) AS c FROM customer GROUP BY 1) g USING (d) GROUP BY ALL""")
def sparse_matrix_vector(s: SparkSession, d: str) -> DataFrame:
    od = _od(s, d, False)
    m = od.select("o", "d", (F.col("t") % 4).alias("slice"), (F.col("value") / F.sum("value").over(W.partitionBy("o"))).alias("share"))
    g = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("d")).agg(F.count(F.lit(1)).alias("value"))
    return D.times_vector(m, g, ["o", "slice"], ["d"]).withColumn("value", F.round("value", 6))


# --- filters and projections ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice <= 50000)")
def filter_dnf(s: SparkSession, d: str) -> DataFrame:
    f = [[("o_orderstatus", "==", "F"), ("o_totalprice", ">", 200000)], [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_totalprice", "<=", 50000)]]
    return table(s, d, "orders").where(P.dnf(f)).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT id_res, id_link FROM aggregated_results WHERE (density IS NULL OR tt IS NOT NULL) AND mode IS NOT NULL AND avg_speed BETWEEN 20 AND 90 AND id_link NOT IN (20001, 20004)")
def filter_expression(s: SparkSession, d: str) -> DataFrame:
    text = P.frame_expression("(density.isnull() | tt.notnull()) & mode != None & avg_speed >= 20 & avg_speed <= 90 & ~(id_link.isin([20001, 20004]))")
    return table(s, d, "aggregated_results").where(text).select("id_res", "id_link")


@query("SELECT doc_id, source FROM documents WHERE source LIKE '%-tv' OR source LIKE 'sub%' OR contains(source, 'film')")
def filter_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(P.frame_expression("source.str.endswith('-tv') | source.str.startswith('sub') | source.str.contains('film')")).select("doc_id", "source")


@query("SELECT id_trip AS trip, upper(id_veh) AS vehicle, CAST(dist / 1000 AS DOUBLE) AS km, round(dist / nullif(tt, 0) * 3.6, 4) AS kmh, 'fcd' AS origin, dt_o - INTERVAL 1 HOUR AS started, CAST(id_zone_o AS VARCHAR) AS zone FROM trips")
def mapping_projection(s: SparkSession, d: str) -> DataFrame:
    from roadloom.sources.catalog import Dataset

    spec = Dataset(
        path=f"{d}/trips.parquet",
        mapping={"trip": "id_trip", "vehicle": "expression:upper(id_veh)", "km": "expression:dist / 1000", "kmh": "expression:round(try_divide(dist, tt) * 3.6, 4)", "started": "dt_o", "zone": "id_zone_o"},
        additional_fields={"origin": ("fcd", "string")},
        dtype={"zone": "string"},
        tz_source="+01:00",
        tz_columns=("started",),
    )
    return spec.read(s)


@query("SELECT id_veh, count(*) AS trips, count(*) FILTER (WHERE id_zone_o IN (SELECT id FROM zones)) AS known, count(*) FILTER (WHERE id_zone_o NOT IN (SELECT id FROM zones)) AS unknown FROM trips WHERE id_zone_o IS NOT NULL GROUP BY 1")
def member_semi_anti(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trips").where("id_zone_o is not null").withColumn("id", F.col("id_zone_o"))
    z = table(s, d, "zones")
    both = P.members(t, z, "id").withColumn("k", F.lit(1)).unionByName(P.members(t, z, "id", False).withColumn("k", F.lit(0)))
    return both.groupBy("id_veh").agg(F.count(F.lit(1)).alias("trips"), F.sum("k").alias("known"), F.sum(1 - F.col("k")).alias("unknown"))


@query("""WITH a AS (SELECT id, lanes, rcr::DOUBLE AS rcr FROM links WHERE NOT connector AND rcr IS NOT NULL), b AS (SELECT id, lanes + 1 AS lanes, 25.0 AS rcr FROM links)
SELECT id, coalesce(a.lanes, b.lanes) AS lanes, coalesce(a.rcr, b.rcr) AS rcr FROM a FULL JOIN b USING (id)""")
def overlay_combine_first(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "links").select("id", "lanes", F.col("rcr").cast("double").alias("rcr"), "connector")
    return D.overlay([links.where("not connector and rcr is not null").drop("connector"), links.select("id", (F.col("lanes") + 1).alias("lanes"), F.lit(25.0).alias("rcr"))], ["id"], ["lanes", "rcr"])


# --- sequences -----------------------------------------------------------------------------------------------------


@query("""SELECT id_trip, id_veh, lag(id_trip) OVER w AS before, lead(id_trip) OVER w AS after, round(epoch(dt_o) - epoch(lag(dt_o) OVER w), 3) AS p_before, round(epoch(lead(dt_o) OVER w) - epoch(dt_o), 3) AS p_after
FROM (SELECT DISTINCT id_trip, id_veh, dt_o FROM trips) WINDOW w AS (PARTITION BY id_veh ORDER BY dt_o, id_trip)""")
def trips_prev_next(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trips").select("id_trip", "id_veh", "dt_o").distinct()
    g = S.neighbours(t, ["id_veh"], ["dt_o", "id_trip"], ["id_trip", "dt_o"], F.date_trunc("month", "dt_o"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return g.select("id_trip", "id_veh", F.col("previous_id_trip").alias("before"), F.col("next_id_trip").alias("after"), F.round(seconds("dt_o") - seconds("previous_dt_o"), 3).alias("p_before"), F.round(seconds("next_dt_o") - seconds("dt_o"), 3).alias("p_after"))


_PINGS = r"""c AS (SELECT try_cast(try_cast(trim(id_fcd) AS DECIMAL(38,6)) AS BIGINT) AS id, *, regexp_extract_all(coalesce(regexp_extract(geometry, '[(\[][^(\[]*$'), ''), '-?\d+(?:\.\d+)?') AS g FROM fcd),
f AS (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at, batch) = 1),
p AS (SELECT * FROM (SELECT id, id_veh, ts, engine, CASE WHEN geometry IS NULL THEN x ELSE CAST(g[1] AS DOUBLE) END AS x, CASE WHEN geometry IS NULL THEN y ELSE CAST(g[2] AS DOUBLE) END AS y FROM f) WHERE ts IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)"""


@query(f"""WITH {_PINGS}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, epoch(ts) - epoch(lag(ts) OVER w) AS dt FROM p WINDOW w AS (PARTITION BY id_veh ORDER BY ts, id)),
n AS (SELECT *, count(*) FILTER (WHERE dt IS NULL OR dt > 900 OR engine = 0) OVER (PARTITION BY id_veh ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT id_veh, session, count(*) AS n, min(ts) AS started, max(ts) AS ended, round(sum(CASE WHEN dt <= 900 AND engine IS DISTINCT FROM 0 THEN step ELSE 0 END), 3) AS metres FROM n GROUP BY ALL""")
def sessions_gap(s: SparkSession, d: str) -> DataFrame:
    """Sessions by silence and ignition; a vehicle's days are blocks, so a hot vehicle is spread over tasks."""
    key, order, day = ["id_veh"], ["ts", "id"], F.to_date("ts")
    p = S.neighbours(first_pings(table(s, d, "fcd")), key, order, ["ts", "x", "y"], day)
    wait = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))) / 1e6
    on = F.col("engine").eqNullSafe(F.lit(0))
    g = S.numbered(p, key, order, F.col("previous_ts").isNull() | (wait > 900) | on, day)
    step = F.when((wait <= 900) & ~on, F.hypot(F.col("x") - F.col("previous_x"), F.col("y") - F.col("previous_y"))).otherwise(0.0)
    return g.groupBy("id_veh", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.round(F.sum(step), 3).alias("metres"))


_SLOTS = """v AS (SELECT id_link, strftime(slot_ts, '%Y-%m-%d') AS day, CAST(hour(slot_ts) * 60 + minute(slot_ts) AS INT) AS minute, avg(avg_speed) AS speed FROM aggregated_results GROUP BY ALL),
g AS (SELECT id_link, day, CAST(unnest(generate_series(0, 1425, 15)) AS INT) AS minute FROM (SELECT DISTINCT id_link, day FROM v))"""


def _slots(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "aggregated_results")
    return a.groupBy("id_link", F.date_format("slot_ts", "yyyy-MM-dd").alias("day"), X.minute_of_timestamp(F.col("slot_ts")).alias("minute")).agg(F.avg("avg_speed").alias("speed"))


@query(f"""WITH {_SLOTS} SELECT id_link, day, minute, round(last_value(speed IGNORE NULLS) OVER (PARTITION BY id_link, day ORDER BY minute), 4) AS speed FROM g LEFT JOIN v USING (id_link, day, minute)""")
def forward_fill_slices(s: SparkSession, d: str) -> DataFrame:
    return S.forward_fill(_slots(s, d), ["id_link", "day"], "minute", "speed", 0, 1425, 15).withColumn("speed", F.round("speed", 4))


@query(f"""WITH {_SLOTS}, j AS (SELECT * FROM g LEFT JOIN v USING (id_link, day, minute)),
b AS (SELECT *, last_value(speed IGNORE NULLS) OVER a AS v0, first_value(speed IGNORE NULLS) OVER z AS v1, last_value(CASE WHEN speed IS NOT NULL THEN minute END IGNORE NULLS) OVER a AS h0, first_value(CASE WHEN speed IS NOT NULL THEN minute END IGNORE NULLS) OVER z AS h1 FROM j
WINDOW a AS (PARTITION BY id_link, day ORDER BY minute ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY id_link, day ORDER BY minute ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT id_link, day, minute, round(coalesce(speed, v0 + (v1 - v0) * ((minute - h0)::DOUBLE / nullif(h1 - h0, 0)), v0, v1), 5) AS speed FROM b""")
def interpolate_gaps(s: SparkSession, d: str) -> DataFrame:
    v = _slots(s, d)
    every = v.select("id_link", "day").distinct().withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(1425), F.lit(15))))
    full = every.join(v, ["id_link", "day", "minute"], "left")
    return S.interpolate(full, ["id_link", "day"], "minute", "speed").select("id_link", "day", "minute", F.round("speed", 5).alias("speed"))


@query("""WITH l AS (SELECT id_event, upper(trim(id_link_set)) AS s, event_type, lag(event_type) OVER w AS prev, row_number() OVER w AS k FROM (SELECT DISTINCT id_event, id_link_set, event_type FROM link_events) WINDOW w AS (PARTITION BY upper(trim(id_link_set)) ORDER BY id_event, event_type))
SELECT s AS id_set, string_agg(coalesce(event_type, '-'), ',' ORDER BY k) FILTER (WHERE k = 1 OR event_type IS DISTINCT FROM prev) AS types FROM l GROUP BY 1""")
def drop_repeats(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "link_events").select("id_event", F.upper(F.trim("id_link_set")).alias("id_set"), "event_type").distinct()
    a = e.groupBy("id_set").agg(F.array_sort(F.collect_list(F.struct("id_event", "event_type"))).alias("a"))
    return a.select("id_set", F.array_join(F.transform(S.drop_repeats(F.col("a.event_type")), lambda v: F.coalesce(v, F.lit("-"))), ",").alias("types"))


_DAILY = "SELECT id_link, hour(slot_ts) AS hour, round(avg(avg_speed), 3) AS v FROM aggregated_results WHERE avg_speed IS NOT NULL GROUP BY ALL"


@query(f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY id_link ORDER BY hour) AS k FROM ({_DAILY})),
e AS (SELECT id_link, k, v AS s FROM v WHERE k = 1 UNION ALL SELECT v.id_link, v.k, e.s * 0.9 + v.v * 0.1 FROM e JOIN v ON v.id_link = e.id_link AND v.k = e.k + 1)
SELECT id_link, round(arg_max(s, k), 5) AS speed FROM e GROUP BY 1""")
def ema_smoothing(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "aggregated_results").where("avg_speed is not null").groupBy("id_link", F.hour("slot_ts").alias("hour")).agg(F.round(F.avg("avg_speed"), 3).alias("v"))
    a = v.groupBy("id_link").agg(F.array_sort(F.collect_list(F.struct("hour", "v"))).alias("a"))  # at most 24 a link
    return a.select("id_link", F.round(S.smoothed(F.col("a.v")), 5).alias("speed"))


@query(f"""WITH RECURSIVE {_ODT}, v AS (SELECT o, d, t, value / 64 AS v, row_number() OVER (PARTITION BY o, d ORDER BY t) AS k FROM od),
e AS (SELECT o, d, k, ceil(v - 0.5) AS n, v - ceil(v - 0.5) AS rest FROM v WHERE k = 1
 UNION ALL SELECT v.o, v.d, v.k, ceil(v.v + e.rest - 0.5), v.v + e.rest - ceil(v.v + e.rest - 0.5) FROM e JOIN v ON v.o = e.o AND v.d = e.d AND v.k = e.k + 1)
SELECT o, d, CAST(sum(n) AS BIGINT) AS vehicles, CAST(max(n) AS BIGINT) AS most, count(*) AS slices FROM e GROUP BY ALL""")
def residual_rounding(s: SparkSession, d: str) -> DataFrame:
    a = _od(s, d, False).groupBy("o", "d").agg(F.array_sort(F.collect_list(F.struct("t", (F.col("value") / 64).alias("v")))).alias("a"))  # at most 13 slices
    n = a.select("o", "d", S.rounded_with_rest(F.col("a.v")).alias("n"))
    return n.select("o", "d", F.aggregate("n", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("vehicles"), F.array_max("n").alias("most"), F.size("n").cast("bigint").alias("slices"))


@query("""WITH b AS (SELECT id_link, quantile_cont(avg_speed, 0.05) AS lo, quantile_cont(avg_speed, 0.95) AS hi FROM aggregated_results GROUP BY 1)
SELECT id_link, count(*) AS kept, round(sum(avg_speed), 3) AS total FROM aggregated_results JOIN b USING (id_link) WHERE avg_speed >= lo - 1.5 * (hi - lo) AND avg_speed <= hi + 1.5 * (hi - lo) GROUP BY 1""")
def percentile_outliers(s: SparkSession, d: str) -> DataFrame:
    kept = S.within_box(table(s, d, "aggregated_results").select("id_link", "avg_speed"), ["id_link"], ["avg_speed"])
    return kept.groupBy("id_link").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("avg_speed"), 3).alias("total"))


@query("""SELECT id_veh, arg_min(id_trip, (dt_o, id_trip)) AS first_trip, arg_max(id_trip, (dt_o, id_trip)) AS last_trip, arg_max(id_trip, (dist, id_trip)) AS longest, count(DISTINCT id_trip) AS trips, round(avg(avg_speed), 4) AS speed FROM trips GROUP BY 1""")
def first_last_point(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "trips").groupBy("id_veh").agg(F.min_by("id_trip", F.struct("dt_o", "id_trip")).alias("first_trip"), F.max_by("id_trip", F.struct("dt_o", "id_trip")).alias("last_trip"), F.max_by("id_trip", F.struct("dist", "id_trip")).alias("longest"), F.countDistinct("id_trip").alias("trips"), F.round(F.avg("avg_speed"), 4).alias("speed"))


@query("""WITH p AS (SELECT o_custkey AS o, o_orderkey AS path, o_totalprice AS cost FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY cost, path) - 1 AS k FROM p)
SELECT o, path, round(cost, 2) AS cost, CAST(k AS INT) AS k FROM k WHERE k < 3""")
def k_path_rank(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "orders").select(F.col("o_custkey").alias("o"), F.col("o_orderkey").alias("path"), F.round("o_totalprice", 2).alias("cost"))
    return S.ranked(p, ["o"], ["cost", "path"]).where("k < 3")


# --- functions -----------------------------------------------------------------------------------------------------


@query("""SELECT id_trip, printf('%02d:%02d', hour(dt_o), minute(dt_o)) AS hhmm, CAST(hour(dt_o) * 60 + minute(dt_o) AS INT) AS minute, CAST(floor((hour(dt_o) * 60 + minute(dt_o)) / 15) * 15 AS INT) AS slice,
CAST(dayofweek(dt_o) AS INT) AS dow, CASE WHEN dayofweek(dt_o) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type, time_bucket(INTERVAL 15 MINUTE, dt_o) AS slot FROM trips""")
def time_functions(s: SparkSession, d: str) -> DataFrame:
    m = X.minute_of_timestamp(F.col("dt_o"))
    t = table(s, d, "trips")
    return t.select("id_trip", X.hhmm(m).alias("hhmm"), X.minutes_of(X.hhmm(m)).alias("minute"), X.floor_to(m, 15).alias("slice"), X.day_of_week(F.col("dt_o")).alias("dow"), X.day_type(F.col("dt_o")).alias("day_type"), X.slot(F.col("dt_o"), 15).alias("slot"))


@query("SELECT CAST(x AS INT) AS slice, printf('%02d:%02d', x // 60, x % 60) AS hhmm FROM generate_series(0, 1425, 15) g(x)")
def generated_series(s: SparkSession, d: str) -> DataFrame:
    return s.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(1425), F.lit(15))).alias("slice")).withColumn("hhmm", X.hhmm(F.col("slice")))


@query("SELECT DISTINCT n_name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM nation")
def normal_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select("n_name", X.normal_name(F.col("n_name")).alias("name")).distinct()


@query("""SELECT id, round(length / v0 * 60, 5) AS t0, round(length / v0 * 60 * (1 + 0.15 * pow(900 / capacity, 4)), 4) AS t900, round(greatest(v0 * exp(-(1 / coalesce(alpha, 1.6::FLOAT)::DOUBLE) * pow(20 / coalesce(rcr, 30::FLOAT)::DOUBLE, coalesce(alpha, 1.6::FLOAT)::DOUBLE)), 5), 3) AS v20,
round((1 - 0.2) * exp(-5.4 / capacity * 300) + 0.2, 5) AS yield FROM (SELECT id, length::DOUBLE AS length, v0::DOUBLE AS v0, capacity::DOUBLE AS capacity, alpha, rcr FROM links)""")
def link_functions(s: SparkSession, d: str) -> DataFrame:
    b = N.built(table(s, d, "links"))
    v0, cap, alpha, rcr = (F.col(c).cast("double") for c in ("v0", "capacity", "alpha", "rcr"))
    return b.select("id", F.round("t0", 5).alias("t0"), F.round(X.bpr(F.col("t0"), F.lit(900.0), cap), 4).alias("t900"), F.round(X.density_speed(v0, F.lit(20.0), rcr, alpha), 3).alias("v20"), F.round(X.yield_capacity(F.lit(300.0), cap, 0.2), 5).alias("yield"))


@query("""SELECT id_event, round(greatest(0.5, 1 - (coalesce(r, 0) + coalesce(f, 0) + coalesce(f, 0) * coalesce(r, 0))), 6) AS factor, sp AS speed, ln AS lanes FROM
(SELECT id_event, CAST(json_extract_string(params, '$.rain') AS DOUBLE) AS r, CAST(json_extract_string(params, '$.fog') AS DOUBLE) AS f, CAST(json_extract_string(params, '$.speed') AS DOUBLE) AS sp, json_extract_string(params, '$.type_lanes') AS ln FROM link_events)""")
def json_params(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "link_events").select("id_event", F.from_json("params", "rain double, fog double, wind double, snow double, speed double, type_lanes string").alias("p"))
    return e.select("id_event", F.round(X.weather_factor(F.col("p.rain"), F.col("p.fog"), F.col("p.wind"), F.col("p.snow")), 6).alias("factor"), F.col("p.speed").alias("speed"), F.col("p.type_lanes").alias("lanes"))


# --- sets ----------------------------------------------------------------------------------------------------------


@query("""SELECT 'all' AS variant, id_link, sum(flow_in)::DOUBLE AS flow FROM aggregated_results GROUP BY ALL UNION ALL SELECT 'light', id_link, sum(flow_in * 0.75)::DOUBLE FROM aggregated_results GROUP BY ALL UNION ALL SELECT 'heavy', id_link, sum(flow_in * 0.25)::DOUBLE FROM aggregated_results GROUP BY ALL""")
def union_variants(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "aggregated_results").groupBy("id_link").agg(F.sum(F.col("flow_in").cast("double")).alias("f"))
    return g.select("id_link", F.stack(F.lit(3), F.lit("all"), F.col("f"), F.lit("light"), F.col("f") * 0.75, F.lit("heavy"), F.col("f") * 0.25).alias("variant", "flow"))


@query("(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'left' FROM customer EXCEPT SELECT s_nationkey, 'left' FROM supplier)")
def intersect_except(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


@query("""SELECT id_set, len(list(DISTINCT id_link)) AS n, array_to_string(list_sort(list(DISTINCT id_link)), ',') AS links FROM links_sets GROUP BY 1""")
def link_set_lists(s: SparkSession, d: str) -> DataFrame:
    return N.set_links(table(s, d, "links_sets")).select("id_set", F.size("links").cast("bigint").alias("n"), F.array_join("links", ",").alias("links"))


@query("""WITH e AS (SELECT DISTINCT id_event, CASE WHEN event_type IS NULL THEN NULL WHEN event_type = 'closure' THEN '[20001, 20004]' WHEN event_type = 'market' THEN '20007' ELSE id_link_set END AS ref FROM link_events)
SELECT id_event, id FROM e JOIN links ON ref IS NULL UNION ALL SELECT id_event, 20007 FROM e WHERE ref = '20007' UNION ALL SELECT id_event, unnest([20001, 20004]) FROM e WHERE ref LIKE '[%' UNION ALL SELECT id_event, id_link FROM e JOIN links_sets ON upper(trim(ref)) = id_set WHERE ref NOT LIKE '[%' AND ref <> '20007'""")
def linkset_resolution(s: SparkSession, d: str) -> DataFrame:
    ref = F.when(F.col("event_type").isNull(), F.lit(None)).when(F.col("event_type") == "closure", "[20001, 20004]").when(F.col("event_type") == "market", "20007").otherwise(F.col("id_link_set"))
    e = table(s, d, "link_events").select("id_event", ref.alias("ref")).distinct()
    return N.referenced_links(e, table(s, d, "links_sets"), table(s, d, "links")).select("id_event", F.col("id_link").alias("id"))


# --- network -------------------------------------------------------------------------------------------------------


@query("SELECT a.id AS in_link, b.id AS out_link, a.to_node AS via, CASE WHEN a.from_node = b.to_node THEN 0.5 ELSE 0.0 END AS penalty FROM links a JOIN links b ON a.to_node = b.from_node")
def adjacency_turns(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "links")
    back = N.adjacency(links).join(links.select(F.col("id").alias("in_link"), F.col("from_node").alias("a")), "in_link").join(links.select(F.col("id").alias("out_link"), F.col("to_node").alias("b")), "out_link")
    turns = back.where("a = b").select("in_link", "out_link", F.lit(0.5).alias("penalty"))
    return N.adjacency(links, turns)


@query("""SELECT t.from_node, t.via_node, t.to_node, a.id AS in_link, b.id AS out_link FROM (SELECT DISTINCT x.from_node, x.to_node AS via_node, y.to_node FROM links x JOIN links y ON x.to_node = y.from_node) t
JOIN links a ON a.from_node = t.from_node AND a.to_node = t.via_node JOIN links b ON b.from_node = t.via_node AND b.to_node = t.to_node""")
def turn_resolution(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "links")
    y = links.select(F.col("from_node").alias("via_node"), F.col("to_node"))
    t = links.select("from_node", F.col("to_node").alias("via_node")).join(y, "via_node").distinct()
    return N.resolved_turns(t, links).select("from_node", "via_node", "to_node", "in_link", "out_link")


_LINE = r"""v AS (SELECT id, from_node, to_node, regexp_extract_all(regexp_extract(geometry, '[(\[].*'), '-?\d+(?:\.\d+)?') AS n FROM links),
s AS (SELECT id AS id_link, CAST(i AS INT) AS pos, CAST(n[2*i-1] AS DOUBLE) AS x1, CAST(n[2*i] AS DOUBLE) AS y1, CAST(n[2*i+1] AS DOUBLE) AS x2, CAST(n[2*i+2] AS DOUBLE) AS y2, len(n) // 2 - 1 AS m FROM (SELECT *, unnest(generate_series(1, len(n) // 2 - 1)) AS i FROM v))"""


@query(f"WITH {_LINE} SELECT id_link, pos, x1, y1, x2, y2, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 4) AS length, round(degrees(atan2(x2-x1, y2-y1)) + CASE WHEN atan2(x2-x1, y2-y1) < 0 THEN 360 ELSE 0 END, 5) AS azimuth FROM s")
def link_segments(s: SparkSession, d: str) -> DataFrame:
    return N.segments(table(s, d, "links")).select("id_link", "pos", "x1", "y1", "x2", "y2", F.round("length", 4).alias("length"), F.round("azimuth", 5).alias("azimuth"))


@query(f"""WITH {_LINE}, a AS (SELECT id AS in_link, to_node AS via, x2 - x1 AS dx1, y2 - y1 AS dy1 FROM s JOIN v ON id = id_link WHERE pos = m), b AS (SELECT id AS out_link, from_node AS via, x2 - x1 AS dx2, y2 - y1 AS dy2 FROM s JOIN v ON id = id_link WHERE pos = 1),
t AS (SELECT in_link, out_link, degrees(atan2(dx1*dy2-dy1*dx2, dx1*dx2+dy1*dy2)) AS a FROM a JOIN b USING (via))
SELECT in_link, out_link, CASE WHEN abs(a) <= 30 THEN 'straight' WHEN abs(a) > 150 THEN 'u_turn' ELSE (CASE WHEN abs(a) <= 60 THEN 'slight' WHEN abs(a) <= 120 THEN 'elbow' ELSE 'sharp' END) || '_' || (CASE WHEN a > 0 THEN 'left' ELSE 'right' END) END AS turn FROM t""")
def azimuth_turn_class(s: SparkSession, d: str) -> DataFrame:
    return N.turn_classes(table(s, d, "links"))


@query("""SELECT 'dangling' AS "check", (SELECT count(*) FROM links WHERE from_node NOT IN (SELECT from_node FROM links WHERE v0 > 50) OR to_node NOT IN (SELECT from_node FROM links WHERE v0 > 50)) AS n UNION ALL SELECT 'no_length', count(*) FILTER (WHERE NOT length > 0 OR length IS NULL) FROM links UNION ALL SELECT 'no_speed', count(*) FILTER (WHERE NOT v0 > 0 OR v0 IS NULL) FROM links""")
def network_checks(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "links")
    nodes = links.where("v0 > 50").select(F.col("from_node").alias("id")).distinct()  # nodes that a fast link leaves
    return N.checks(links, nodes)


@query("""SELECT l_suppkey AS id_link, CAST(month(o_orderdate) AS INT) AS t_start, CAST(sum(round(o_totalprice * 100)::BIGINT) AS BIGINT) AS flow FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def static_link_flow(s: SparkSession, d: str) -> DataFrame:
    path = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("links"))  # an order's lines: at most seven
    p = path.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("links", F.month("o_orderdate").alias("t_start"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("path_flow"))  # cents
    return N.path_flows(p).select("id_link", "t_start", "flow")


@query("""SELECT time_bucket(INTERVAL 60 MINUTE, slot_ts) AS slot, id_link, round(avg(avg_speed), 4) AS speed, round(sum(flow_in::DOUBLE), 2) AS flow, round(sum(flow_in::DOUBLE) / any_value(capacity), 4) AS saturation FROM aggregated_results JOIN links ON links.id = id_link GROUP BY ALL""")
def link_aggregates(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "aggregated_results").withColumn("flow_in", F.col("flow_in").cast("double"))
    g = N.link_results(a, table(s, d, "links"), 60)
    return g.select("slot", "id_link", F.round("speed", 4).alias("speed"), F.round("flow", 2).alias("flow"), F.round("saturation", 4).alias("saturation"))


@query("""WITH v AS (SELECT id_link, slot_ts AS slot, avg(avg_speed) AS speed, max(tt::DOUBLE) AS tt FROM aggregated_results GROUP BY ALL),
j AS (SELECT DISTINCT id_set, v.*, length::DOUBLE AS length, v0::DOUBLE AS v0 FROM links_sets JOIN v USING (id_link) JOIN links ON links.id = id_link),
s AS (SELECT id_set, slot, sum(tt) AS tt, sum(speed * length) AS vl, sum(CASE WHEN speed IS NOT NULL THEN length END) AS l, count(speed) AS n, sum(CASE WHEN speed / v0 <= 0.3 THEN 1 ELSE 0 END) AS l0, sum(CASE WHEN speed / v0 <= 0.6 THEN 1 ELSE 0 END) AS l1 FROM j GROUP BY ALL)
SELECT id_set, round(sum(vl) / sum(l), 4) AS v_avg, round(sum(l0) / nullif(sum(n), 0), 5) AS share_0, round(sum(l1) / nullif(sum(n), 0), 5) AS share_1, count(*) FILTER (WHERE l0 > 0) AS congested_slots, round(max(tt), 3) AS max_tt, round(min(tt), 3) AS min_tt FROM s GROUP BY 1""")
def segment_congestion_stats(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "aggregated_results").groupBy("id_link", F.col("slot_ts").alias("slot")).agg(F.avg("avg_speed").alias("speed"), F.max(F.col("tt").cast("double")).alias("tt"))
    v = v.join(table(s, d, "links").select(F.col("id").alias("id_link"), F.col("length").cast("double").alias("length"), F.col("v0").cast("double").alias("v0")), "id_link")
    c = N.congestion(v, table(s, d, "links_sets").select("id_set", "id_link").distinct())
    return c.select("id_set", F.round("v_avg", 4).alias("v_avg"), F.round("share_0", 5).alias("share_0"), F.round("share_1", 5).alias("share_1"), "congested_slots", F.round("max_tt", 3).alias("max_tt"), F.round("min_tt", 3).alias("min_tt"))


@query(f"WITH {_PINGS} SELECT id, id_veh, ts, engine, x, y FROM p WHERE id_veh IS NOT NULL")
def p5_first_pings(s: SparkSession, d: str) -> DataFrame:
    return first_pings(table(s, d, "fcd"))


# --- matching ------------------------------------------------------------------------------------------------------


def _points(s: SparkSession, d: str) -> DataFrame:
    """Pings with a heading, which and whose speed are those of the first-received copy."""
    f = table(s, d, "fcd").withColumns({c: F.col(c).cast("double") for c in ("heading", "speed")})
    return first_pings(f, ("engine", "heading", "speed")).where("heading is not null")


@query(f"""WITH {_LINE}, {_PINGS.replace("c AS (", "c AS (", 1)}, e AS (SELECT id, x, y FROM p),
j AS (SELECT e.id, id_link, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)) / nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0))) AS q FROM e JOIN s ON x BETWEEN least(x1, x2) - 200 AND greatest(x1, x2) + 200 AND y BETWEEN least(y1, y2) - 200 AND greatest(y1, y2) + 200),
n AS (SELECT id, id_link, sqrt(pow(x-x1-q*(x2-x1), 2) + pow(y-y1-q*(y2-y1), 2)) AS dist FROM j)
SELECT id, id_link, round(dist, 4) AS dist FROM n WHERE dist <= 200 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, id_link) = 1""")
def nearest_link(s: SparkSession, d: str) -> DataFrame:
    p = first_pings(table(s, d, "fcd"), ()).select("id", "x", "y")
    return M.nearest_link(p, N.segments(table(s, d, "links")), 200.0).select("id", "id_link", F.round("dist", 4).alias("dist"))


#: Every pair of a ping and a directed segment in reach, with both likelihoods; the likeliest link of each ping.
_MATCHED = f"""{_LINE}, {_PINGS.replace("SELECT id, id_veh, ts, engine,", "SELECT id, id_veh, ts, engine, heading::DOUBLE AS heading, speed::DOUBLE AS speed,")},
b AS (SELECT id_link, pos, x1, y1, x2, y2 FROM s UNION ALL SELECT -id_link, -pos, x2, y2, x1, y1 FROM s),
l AS (SELECT *, sqrt(pow(x2-x1, 2) + pow(y2-y1, 2)) AS len, degrees(atan2(x2-x1, y2-y1)) + CASE WHEN atan2(x2-x1, y2-y1) < 0 THEN 360 ELSE 0 END AS az FROM b),
m AS (SELECT *, sum(len) OVER (PARTITION BY id_link ORDER BY pos) - len AS from_m FROM l),
j AS (SELECT p.id, engine, id_link, pos, x, y, x1, y1, x2, y2, from_m, len, abs(heading - az) % 360 AS a, coalesce(greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)) / nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), 0))), 0) AS q
 FROM p JOIN m ON x BETWEEN least(x1, x2) - 150 AND greatest(x1, x2) + 150 AND y BETWEEN least(y1, y2) - 150 AND greatest(y1, y2) + 150 WHERE heading IS NOT NULL),
n AS (SELECT *, sqrt(pow(x-x1-q*(x2-x1), 2) + pow(y-y1-q*(y2-y1), 2)) AS dist, least(a, 360 - a) AS angle FROM j),
w AS (SELECT *, 0.183024 * exp(-dist / 5.46376) * CASE WHEN angle <= 5 OR engine IN (0, 2) THEN 0.1 ELSE 0.1 * exp(-(angle - 5) / 5) END AS w FROM n WHERE dist <= 150 AND angle < 45),
k AS (SELECT id, id_link, sum(w) AS w, arg_max(from_m + q * len, (w, -pos)) AS position FROM w GROUP BY ALL),
r AS (SELECT id, arg_max(id_link, (w, -id_link)) AS id_link, arg_max(position, (w, -id_link)) AS position, max(w) / sum(w) AS prob, count(*) AS n_candidates FROM k GROUP BY 1)"""


@query(f"WITH {_MATCHED} SELECT id, id_link, round(position, 3) AS position, round(prob, 6) AS p, n_candidates FROM r")
def map_matching(s: SparkSession, d: str) -> DataFrame:
    m = M.matched(_points(s, d), N.segments(table(s, d, "links"), True), 150.0, 45.0)
    return m.select("id", "id_link", F.round("position", 3).alias("position"), F.round("p", 6).alias("p"), "n_candidates")


@query(f"WITH {_MATCHED} SELECT id, id_link, round(w / sum(w) OVER (PARTITION BY id), 6) AS p, CAST(row_number() OVER (PARTITION BY id ORDER BY w DESC, id_link) - 1 AS INT) AS k FROM k")
def matching_candidates(s: SparkSession, d: str) -> DataFrame:
    c = M.ranked_candidates(_points(s, d), N.segments(table(s, d, "links"), True), 150.0, 45.0)
    return c.select("id", "id_link", F.round("p", 6).alias("p"), "k")


@query(f"WITH {_MATCHED} SELECT id_link, time_bucket(INTERVAL 15 MINUTE, ts) AS slice, round(avg(speed), 4) AS speed, count(speed) AS n FROM r JOIN p USING (id) WHERE speed IS NOT NULL GROUP BY ALL")
def link_speed_slices(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    m = M.matched(p, N.segments(table(s, d, "links"), True), 150.0, 45.0, also=("ts", "speed"))
    return M.link_speeds(m).withColumn("speed", F.round("speed", 4))


@query("""WITH v AS (SELECT id_link, slot_ts AS slice, avg(avg_speed) AS speed, count(avg_speed) AS n FROM aggregated_results WHERE avg_speed IS NOT NULL GROUP BY ALL)
SELECT id_link, slice, round(sum(speed * n) / sum(n), 5) AS speed, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY ALL""")
def merged_running_mean(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "aggregated_results").select("id_link", F.col("slot_ts").alias("ts"), F.col("avg_speed").alias("speed"), F.coalesce(F.col("published_at") > F.col("slot_ts") + F.expr("interval 20 minutes"), F.lit(True)).alias("late"))
    old, new = (M.link_speeds(a.where(F.col("late") == late)) for late in (False, True))
    return M.merged_speeds(old, new).select("id_link", "slice", F.round("speed", 5).alias("speed"), "n")
