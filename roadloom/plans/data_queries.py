"""The queries of the general data problems (p1 to p5, p7) and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.geo import number_id
from roadloom.operators.delivery import first_delivery
from roadloom.operators.intervals import p1_found
from roadloom.operators.spatial import p3_found
from roadloom.operators.spikes import flagged_readings, p4_found
from roadloom.operators.timestamps import p7_found
from roadloom.operators.trips import stops_and_trips
from roadloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return stops_and_trips(table(spark, folder, "fcd")).select("kind", "id_veh", "id_fcd_first", "id_fcd_last")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    one = first_delivery(table(spark, folder, "fcd"), number_id(F.col("id_fcd")), "received_at", ["ts"], "id_fcd")
    return one.where("n_deliveries > 1").select("id_fcd")


def p5_first_copies(spark: SparkSession, folder: str) -> DataFrame:
    return first_delivery(table(spark, folder, "fcd"), number_id(F.col("id_fcd")), "received_at", ["ts", "received_at"], "id_fcd")


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: p1_found(table(s, d, "link_events")),
    "p2_found": p2_found,
    "p2_stops_trips": lambda s, d: stops_and_trips(table(s, d, "fcd")),
    "p3_found": lambda s, d: p3_found(table(s, d, "fcd"), table(s, d, "trips"), table(s, d, "zones")),
    "p4_found": lambda s, d: p4_found(table(s, d, "fcd"), table(s, d, "aggregated_results")),
    "p4_readings": lambda s, d: flagged_readings(table(s, d, "aggregated_results")),
    "p5_found": p5_found,
    "p5_first_copies": p5_first_copies,
    "p7_found": lambda s, d: p7_found(table(s, d, "fcd_raw")),
}

_ID = "try_cast(try_cast(trim(id_fcd) AS DECIMAL(38,6)) AS BIGINT)"
_P1 = r"""
WITH t AS (SELECT upper(trim(id_link_set)) AS s, date_diff('day', DATE '1970-01-01', event_day) * 1440 AS d,
    regexp_extract(trim(start_hm), '^([01]?\d|2[0-3])[:.h]?([0-5]\d)(:[0-5]\d)?$', ['h', 'm', 's']) AS a,
    regexp_extract(trim(end_hm), '^([01]?\d|2[0-3]|24)[:.h]?([0-5]\d)(:[0-5]\d)?$', ['h', 'm', 's']) AS z FROM link_events),
m AS (SELECT s, d, try_cast(a.h AS BIGINT) * 60 + try_cast(a.m AS BIGINT) AS a, try_cast(z.h AS BIGINT) * 60 + try_cast(z.m AS BIGINT) AS z FROM t),
i AS (SELECT DISTINCT s, d + a AS a, d + z + CASE WHEN z < a THEN 1440 ELSE 0 END AS z FROM m WHERE a IS NOT NULL AND z <= 1440 AND a <> z AND d IS NOT NULL),
n AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY s ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
k AS (SELECT *, sum(new) OVER (PARTITION BY s ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM n),
p AS (SELECT s, min(a) AS a, max(z) AS z FROM k GROUP BY s, island),
g AS (SELECT s, z AS a, lead(a) OVER (PARTITION BY s ORDER BY a) AS z FROM p)
SELECT 'period' AS kind, s AS id_link_set, a AS from_min, z AS to_min FROM p
UNION ALL SELECT 'gap', s, a, z FROM g WHERE z IS NOT NULL"""

#: p3 without partitions: points against all edges by the even-odd rule, and a range join of the switch-on pings.
_P3 = rf"""
WITH c AS (SELECT {_ID} AS id, *, regexp_extract_all(coalesce(regexp_extract(geometry, '[(\[][^(\[]*$'), ''), '-?\d+(?:\.\d+)?') AS g FROM fcd),
f AS (SELECT * FROM c WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at, batch) = 1),
e AS (SELECT * FROM (SELECT id, id_veh, CAST(ts AS DATE) AS day, CASE WHEN geometry IS NULL THEN x ELSE CAST(g[1] AS DOUBLE) END AS x, CASE WHEN geometry IS NULL THEN y ELSE CAST(g[2] AS DOUBLE) END AS y FROM f WHERE engine = 0 AND ts IS NOT NULL AND id_veh IS NOT NULL) WHERE x IS NOT NULL AND y IS NOT NULL),
t AS (SELECT *, regexp_extract_all(regexp_extract(geometry, '[(\[].*'), '-?\d+(?:\.\d+)?') AS n FROM trips WHERE id_trip IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_trip ORDER BY loaded_at) = 1),
q AS (SELECT 'ping_zone' AS kind, id, NULL::BIGINT AS given, x, y FROM e UNION ALL SELECT 'trip_o', id_trip, id_zone_o, CAST(n[1] AS DOUBLE), CAST(n[2] AS DOUBLE) FROM t UNION ALL SELECT 'trip_d', id_trip, id_zone_d, CAST(n[-2] AS DOUBLE), CAST(n[-1] AS DOUBLE) FROM t),
z AS (SELECT id, unnest(regexp_extract_all(regexp_replace(translate(regexp_extract(geometry, '[(\[].*'), '[]', '()'), '\(\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\)', '\1 \2', 'g'), '\(([^()]+)\)', 1)) AS ring FROM zones),
r AS (SELECT id, regexp_extract_all(ring, '-?\d+(?:\.\d+)?') AS n FROM z),
s AS (SELECT id, CAST(n[2*i-1] AS DOUBLE) AS x1, CAST(n[2*i] AS DOUBLE) AS y1, CAST(n[2*i+1] AS DOUBLE) AS x2, CAST(n[2*i+2] AS DOUBLE) AS y2 FROM (SELECT *, unnest(generate_series(1, len(n) // 2 - 1)) AS i FROM r)),
h AS (SELECT kind, q.id, given, s.id AS zone FROM q JOIN s ON y >= least(y1, y2) AND y <= greatest(y1, y2) AND (y1 <= y) <> (y2 <= y) AND x < x1 + (y - y1) / (y2 - y1) * (x2 - x1) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT kind, id AS id_1, zone AS id_2 FROM h WHERE kind = 'ping_zone' OR given IS DISTINCT FROM zone
UNION ALL SELECT 'ping_near', a.id, b.id FROM e a JOIN e b ON a.day = b.day AND a.id < b.id AND a.id_veh <> b.id_veh AND b.x BETWEEN a.x - 50 AND a.x + 50 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 50"""

SQL: dict[str, str] = {
    "p3_found": _P3,
    "p1_found": _P1,
    "p5_found": f"SELECT {_ID} AS id_fcd FROM fcd WHERE {_ID} IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "p5_first_copies": f"""SELECT id_fcd, ts, received_at, n AS n_deliveries FROM (SELECT {_ID} AS id_fcd, ts, received_at, count(*) OVER (PARTITION BY {_ID}) AS n,
        row_number() OVER (PARTITION BY {_ID} ORDER BY received_at) AS k FROM fcd WHERE {_ID} IS NOT NULL) WHERE k = 1""",
}
