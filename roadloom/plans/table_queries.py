"""Queries of filters, series, time attributes, paths as tables, link results and checks, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import predicates as P
from roadloom.functions import scalars as X
from roadloom.operators import attributes as T
from roadloom.operators import matching as M
from roadloom.operators import network as N
from roadloom.operators import series as S
from roadloom.operators.spikes import flagged_readings
from roadloom.plans import ops
from roadloom.plans.engine_queries import _MATCHED, _ODT, _od, _points
from roadloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


# --- filters -------------------------------------------------------------------------------------------------------

_WHERE = "source LIKE '%tv%' OR (n_chars BETWEEN 500 AND 2000 AND lang IS NOT NULL AND NOT (sub_format = 'vtt'))"


@query(f"SELECT doc_id, source, n_chars FROM documents WHERE {_WHERE}")
def filter_where_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(_WHERE).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE (lang = 'it' OR lang = 'en') AND (n_chars > 500 AND n_chars <= 3000)")
def filter_static_and_call(s: SparkSession, d: str) -> DataFrame:
    """A dataset's own filter, an OR, and a call's filter in other names: each holds as a whole."""
    call = P.dnf(P.renamed([[("size", ">", 500), ("size", "<=", 3000)]], {"size": "n_chars"}))
    return table(s, d, "documents").where(P.both("lang = 'it' OR lang = 'en'", call)).select("doc_id", "lang")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'F' AND o_custkey IS NOT NULL")
def filter_in_not_in(s: SparkSession, d: str) -> DataFrame:
    f = [("o_orderpriority", "not in", ["1-URGENT", "5-LOW"]), ("o_orderstatus", "!=", "F"), ("o_custkey", "!=", None)]
    return table(s, d, "orders").where(P.dnf(f)).select("o_orderkey", "o_orderstatus")


@query("SELECT id_veh, count(*) AS n, count(heading) AS with_heading, round(avg(heading::DOUBLE), 4) AS heading FROM fcd WHERE heading IS NOT NULL AND id_veh IS NOT NULL GROUP BY 1")
def rows_with_heading(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "fcd").na.drop(subset=["heading", "id_veh"]).groupBy("id_veh")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count("heading").alias("with_heading"), F.round(F.avg(F.col("heading").cast("double")), 4).alias("heading"))


@query("SELECT l.id, l.from_node FROM links l WHERE NOT EXISTS (SELECT 1 FROM links_sets s WHERE s.id_link = l.id)")
def links_in_no_set(s: SparkSession, d: str) -> DataFrame:
    return P.members(table(s, d, "links"), table(s, d, "links_sets").select(F.col("id_link").alias("id")).distinct(), "id", False).select("id", "from_node")


@query("SELECT id FROM links WHERE modes IS NULL OR len(modes) = 0 OR list_contains(modes, 'all') OR (list_contains(modes, 'c') AND NOT list_contains(modes, 'none'))")
def links_of_mode(s: SparkSession, d: str) -> DataFrame:
    return N.allowed(table(s, d, "links"), "c").select("id")


# --- time ----------------------------------------------------------------------------------------------------------


@query(r"""SELECT id_event, CASE WHEN regexp_matches(trim(start_hm), '^\d{1,2}:\d{2}$') THEN (CAST(split_part(trim(start_hm), ':', 1) AS BIGINT) * 60 + CAST(split_part(trim(start_hm), ':', 2) AS BIGINT)) * 60 END AS seconds,
CAST(id_event % 90 AS BIGINT) * 60 AS minutes, CAST(id_event % 5 AS BIGINT) * 3600 + CAST(id_event % 60 AS BIGINT) * 60 AS parts FROM link_events""")
def interval_texts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "link_events")
    hm = F.when(F.trim("start_hm").rlike("^\\d{1,2}:\\d{2}$"), F.col("start_hm"))
    return e.select("id_event", X.duration_seconds(hm).alias("seconds"), X.duration_seconds((F.col("id_event") % 90).cast("string")).alias("minutes"), X.duration_seconds(F.concat((F.col("id_event") % 5).cast("string"), F.lit("h "), (F.col("id_event") % 60).cast("string"), F.lit(" min"))).alias("parts"))


@query("""WITH d AS (SELECT DISTINCT event_day::TIMESTAMP AS a FROM link_events WHERE event_day IS NOT NULL), s AS (SELECT a, unnest(generate_series(a, a + INTERVAL 3 HOUR, INTERVAL 45 MINUTE)) AS t FROM d)
SELECT a AS day, t, t < a + INTERVAL 3 HOUR AS in_left, t > a AS in_right FROM s""")
def datetime_series(s: SparkSession, d: str) -> DataFrame:
    days = table(s, d, "link_events").where("event_day is not null").select(F.col("event_day").cast("timestamp_ntz").alias("day")).distinct()
    end, step = F.col("day") + F.expr("interval 3 hours"), F.expr("interval 45 minutes")
    both, left, right = (X.series(F.col("day"), end, step, k) for k in ("both", "left", "right"))
    return days.withColumns({"l": left, "r": right}).select("day", F.explode(both).alias("t"), "l", "r").select("day", "t", F.array_contains("l", F.col("t")).alias("in_left"), F.array_contains("r", F.col("t")).alias("in_right"))


_ARRAYS = """h AS (SELECT id_link, hour(slot_ts) AS h, round(avg(avg_speed), 3) AS v, count(*)::DOUBLE AS c FROM aggregated_results WHERE avg_speed IS NOT NULL GROUP BY ALL),
a AS (SELECT id_link, list(v ORDER BY h) AS a, list(c ORDER BY h) FILTER (WHERE h < 20) AS b FROM h GROUP BY 1)"""


@query(f"""WITH {_ARRAYS} SELECT id_link, round(a[least(150 // 60, len(a) - 1) + 1], 4) AS at_150, round(list_sum(list_transform(generate_series(0, greatest(len(a), len(b)) - 1), lambda i: a[least(i, len(a) - 1) + 1] * b[least(i, len(b) - 1) + 1])), 2) AS product,
round(list_sum(list_transform(a, lambda v: pow(v, 2))), 1) AS squares, round(list_sum(a) + CASE WHEN len(a) > 1 THEN a[2] ELSE 0 END, 3) AS doubled_at_60,
CAST(greatest(len(a), 27) AS INT) AS size_after_put, round(list_sum(list_transform(generate_series(0, 23), lambda k: a[least((k * 30 + 60) // 60, len(a) - 1) + 1])), 3) AS resized FROM a WHERE b IS NOT NULL""")
def time_attributes(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "aggregated_results").where("avg_speed is not null").groupBy("id_link", F.hour("slot_ts").alias("h")).agg(F.round(F.avg("avg_speed"), 3).alias("v"), F.count(F.lit(1)).cast("double").alias("c"))
    g = h.groupBy("id_link").agg(F.array_sort(F.collect_list(F.struct("h", "v", "c"))).alias("s"))  # at most 24 hours
    g = g.select("id_link", F.col("s.v").alias("a"), F.col("s").alias("s")).withColumn("b", F.transform(F.filter("s", lambda x: x.h < 20), lambda x: x.c)).where(F.size("b") > 0)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    a, b = F.col("a"), F.col("b")
    return g.select("id_link", F.round(T.value_at(a, F.lit(150), 60), 4).alias("at_150"), F.round(total(T.combined(a, b, "*")), 2).alias("product"), F.round(total(T.scaled(a, "**", 2.0)), 1).alias("squares"), F.round(total(T.scaled_at(a, "*", 2.0, 60, 60)), 3).alias("doubled_at_60"), F.size(T.with_value(a, 1600, 60, F.lit(1.0))).alias("size_after_put"), F.round(total(T.resized(a, 60, 720, 30, 60)), 3).alias("resized"))


# --- paths, matrices and trips as tables -----------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_orderkey AS path, any_value(o_custkey) AS source, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS links FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT path, source, links, CAST(row_number() OVER (PARTITION BY source, links ORDER BY path) - 1 AS INT) AS repetition FROM p""")
def path_repetitions(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("links"))  # at most seven lines an order
    p = p.join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("source"), "links")
    return S.repetitions(p, ["source"], "links", ["path"]).withColumn("links", F.array_join("links", ","))


@query("""WITH p AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS links FROM lineitem GROUP BY 1) SELECT CAST(sum(len(links)) AS BIGINT) AS links, count(*) FILTER (WHERE list_contains(links, 1)) AS paths_with_link,
CAST(sum(len(list_filter(links, lambda v: v = 1))) AS BIGINT) AS uses, count(DISTINCT list_sort(links)) AS unique_paths FROM p""")
def path_counts(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("links"))
    return N.path_counters(p, 1)


@query(f"WITH {_ODT} SELECT t, o, d, value FROM od")
def od_export(s: SparkSession, d: str) -> DataFrame:
    return _od(s, d, False).orderBy("t", "o", "d").select("t", "o", "d", "value")


@query("SELECT m.mode, coalesce(v, 0.0) AS value, coalesce(round(v / sum(v) OVER (), 6), 0.0) AS share FROM (VALUES ('A'), ('N'), ('R'), ('X')) m(mode) LEFT JOIN (SELECT l_returnflag AS mode, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1) USING (mode)")
def class_totals(s: SparkSession, d: str) -> DataFrame:
    """Demand and share of each class; one without demand has 0."""
    classes = s.createDataFrame([(m,) for m in "ANRX"], "mode string")
    v = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("mode")).agg(F.sum("l_quantity").cast("double").alias("v"))
    all_of = v.agg(F.sum("v").alias("all_v"))  # one row
    return classes.join(v, "mode", "left").crossJoin(all_of).select("mode", F.coalesce("v", F.lit(0.0)).alias("value"), F.coalesce(F.round(F.col("v") / F.col("all_v"), 6), F.lit(0.0)).alias("share"))


@query("SELECT id_trip, id_veh, CASE WHEN dt_d = date_trunc('minute', dt_d) THEN NULL ELSE 'changed' END AS change FROM (SELECT DISTINCT id_trip, id_veh, dt_d FROM trips) WHERE dt_d IS DISTINCT FROM date_trunc('minute', dt_d)")
def trips_changed(s: SparkSession, d: str) -> DataFrame:
    """Trips whose end differs from that of the trips kept before, here with ends of whole minutes."""
    new = table(s, d, "trips").select("id_trip", "id_veh", "dt_d").distinct()
    old = new.withColumn("dt_d", F.date_trunc("minute", "dt_d").cast("timestamp_ntz"))
    return ops.changed_trips(new, old).select("id_trip", "id_veh", "change")


# --- links ---------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT id_link, hour(slot_ts) AS hour, mode, sum(flow_in::DOUBLE) AS flow, avg(avg_speed) AS speed FROM aggregated_results GROUP BY ALL)
SELECT id_link, CAST(hour AS INT) AS hour, mode, round(flow, 2) AS flow, round(speed, 4) AS speed, round(flow / nullif(speed, 0), 4) AS density, round(flow / nullif(capacity::DOUBLE, 0), 5) AS saturation FROM r JOIN links ON links.id = id_link""")
def static_link_results(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "aggregated_results").withColumns({"hour": F.hour("slot_ts"), "flow": F.col("flow_in").cast("double")})
    g = N.static_results(a, table(s, d, "links"), ["id_link", "hour", "mode"])
    return g.select("id_link", "hour", "mode", *[F.round(c, k).alias(c) for c, k in (("flow", 2), ("speed", 4), ("density", 4), ("saturation", 5))])


@query("SELECT coalesce(l.id, r.id_link) AS id_link, l.lanes, round(r.speed, 4) AS speed FROM (SELECT id, lanes FROM links WHERE NOT connector) l FULL JOIN (SELECT id_link, avg(avg_speed) AS speed FROM aggregated_results GROUP BY 1) r ON l.id = r.id_link")
def links_outer_results(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "links").where("not connector").select(F.col("id").alias("id_link"), "lanes")
    r = table(s, d, "aggregated_results").groupBy("id_link").agg(F.round(F.avg("avg_speed"), 4).alias("speed"))
    return links.join(r, "id_link", "full")


@query("""WITH v AS (SELECT id_link, slot_ts AS slice, avg(avg_speed) AS speed, count(avg_speed) AS n FROM aggregated_results WHERE avg_speed IS NOT NULL GROUP BY ALL)
SELECT id_link, count(*) AS n_slices, round(arg_min(speed, slice), 4) AS first_speed, round(arg_max(speed, slice), 4) AS last_speed FROM v WHERE n > 0 GROUP BY 1""")
def sparse_link_speeds(s: SparkSession, d: str) -> DataFrame:
    v = M.link_speeds(table(s, d, "aggregated_results").select("id_link", F.col("slot_ts").alias("ts"), F.col("avg_speed").alias("speed")))
    return N.sparse_speeds(v).select("id_link", F.size("slices").cast("bigint").alias("n_slices"), F.round(F.get("speeds", F.lit(0)), 4).alias("first_speed"), F.round(F.element_at("speeds", -1), 4).alias("last_speed"))


@query(f"""WITH {_MATCHED}, o AS (SELECT id_link, lag(id_link) OVER (PARTITION BY id_veh ORDER BY ts, id) AS before FROM r JOIN p USING (id) WHERE id_veh IS NOT NULL)
SELECT before AS in_link, id_link AS out_link, count(*) AS n FROM o WHERE before <> id_link GROUP BY ALL""")
def matched_turns(s: SparkSession, d: str) -> DataFrame:
    m = M.matched(_points(s, d), N.segments(table(s, d, "links"), True), 150.0, 45.0, also=("id_veh", "ts"))
    return M.turns_of_matches(m)


@query("""WITH t AS (SELECT from_node, to_node AS via_node, to_node + 1 AS to_node FROM links), n AS (SELECT from_node AS id FROM links UNION SELECT to_node FROM links)
SELECT 'turn_nodes' AS "check", count(*) FILTER (WHERE from_node NOT IN (SELECT id FROM n) OR via_node NOT IN (SELECT id FROM n) OR to_node NOT IN (SELECT id FROM n)) AS n FROM t
UNION ALL SELECT 'zones_without_node', count(*) FILTER (WHERE id NOT IN (SELECT id FROM n)) FROM zones""")
def turn_and_zone_checks(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "links")
    turns = links.select("from_node", F.col("to_node").alias("via_node"), (F.col("to_node") + 1).alias("to_node"))
    return N.turn_checks(turns, links, table(s, d, "zones"))


@query("""WITH e AS (SELECT DISTINCT id_event, event_type, upper(trim(id_link_set)) AS s, CAST(json_extract_string(params, '$.speed') AS DOUBLE) AS speed FROM link_events)
SELECT event_type, id_link, count(DISTINCT id_event) AS events, min(speed) AS speed FROM e JOIN (SELECT DISTINCT id_set, id_link FROM links_sets) ON s = id_set WHERE event_type IS NOT NULL GROUP BY ALL""")
def events_by_type(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "link_events").select("id_event", "event_type", F.upper(F.trim("id_link_set")).alias("id_set"), F.get_json_object("params", "$.speed").try_cast("double").alias("speed")).distinct()
    sets = table(s, d, "links_sets").select("id_set", "id_link").distinct()
    return e.where("event_type is not null").join(sets, "id_set").groupBy("event_type", "id_link").agg(F.countDistinct("id_event").alias("events"), F.min("speed").alias("speed"))


@query(r"""WITH v AS (SELECT id_trip, regexp_extract_all(regexp_extract(geometry, '[(\[].*'), '-?\d+(?:\.\d+)?') AS n FROM (SELECT id_trip, min(geometry) AS geometry FROM trips GROUP BY 1)),
p AS (SELECT id_trip, list_transform(generate_series(1, len(n) // 2), lambda i: (CAST(n[2*i-1] AS DOUBLE), CAST(n[2*i] AS DOUBLE))) AS p FROM v)
SELECT id_trip, CAST(len(list_filter(generate_series(1, len(p)), lambda i: i = 1 OR p[i] IS DISTINCT FROM p[i-1])) AS BIGINT) AS n_vertices FROM p""")
def lines_repaired(s: SparkSession, d: str) -> DataFrame:
    """Lines without vertices that repeat the one before."""
    t = table(s, d, "trips").groupBy("id_trip").agg(F.min("geometry").alias("geometry"))
    return t.select("id_trip", F.size(S.drop_repeats(N.vertices(F.col("geometry")))).cast("bigint").alias("n_vertices"))


@query("""WITH f AS (SELECT id_res, id_link, slot_ts, avg_speed FROM aggregated_results WHERE id_res IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_res ORDER BY published_at) = 1),
v AS (SELECT * FROM f WHERE avg_speed IS NOT NULL AND NOT isnan(avg_speed) AND id_link IS NOT NULL AND slot_ts IS NOT NULL),
k AS (SELECT *, CASE WHEN avg_speed = lag(avg_speed) OVER w THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY id_link ORDER BY slot_ts, id_res)),
r AS (SELECT *, sum(new) OVER (PARTITION BY id_link ORDER BY slot_ts, id_res ROWS UNBOUNDED PRECEDING) AS run FROM k),
n AS (SELECT *, count(*) OVER (PARTITION BY id_link, run) AS length FROM r)
SELECT id_res, CASE WHEN avg_speed < 0 OR avg_speed > 250 THEN 'bounds' ELSE 'stuck' END AS kind FROM n WHERE avg_speed < 0 OR avg_speed > 250 OR length >= 12""")
def p4_bounds_and_stuck(s: SparkSession, d: str) -> DataFrame:
    """Readings out of bounds and stuck values of p4; spikes follow from these."""
    return flagged_readings(table(s, d, "aggregated_results")).where("kind in ('bounds', 'stuck')").select("id_res", "kind")
