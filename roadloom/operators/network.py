"""Links, nodes and turns as tables: vertices, segments, adjacency, turns, checks, link sets, flows and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.scalars import azimuth, free_flow_minutes, turn_class


def vertices(geometry: Column) -> Column:
    """Array of struct(x, y) of a line in WKT, EWKT or GeoJSON; empty where it can't be read."""
    numbers = F.regexp_extract_all(F.regexp_extract(geometry, "[(\\[].*", 0), F.lit("(-?\\d+(?:\\.\\d+)?(?:[eE][-+]?\\d+)?)[,\\s]+(-?\\d+(?:\\.\\d+)?(?:[eE][-+]?\\d+)?)"), 0)
    return F.transform(numbers, lambda p: F.struct(F.split(p, "[,\\s]+")[0].cast("double").alias("x"), F.split(p, "[,\\s]+")[1].cast("double").alias("y")))


def segments(links: DataFrame, both_ways: bool = False) -> DataFrame:
    """(id_link, pos, x1, y1, x2, y2, length, from_m, to_m, azimuth): the segments of each line in order.

    With both_ways each comes again reversed, under the negative id.
    """
    v = links.select(F.col("id").alias("id_link"), vertices(F.col("geometry")).alias("v")).where(F.size("v") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.struct(i.alias("pos"), F.element_at("v", i).alias("a"), F.element_at("v", i + 1).alias("b")))
    s = v.select("id_link", F.explode(pairs).alias("s")).select("id_link", "s.pos", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    if both_ways:
        s = s.unionByName(s.select((-F.col("id_link")).alias("id_link"), (-F.col("pos")).alias("pos"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")))
    s = s.withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    so_far = F.sum("length").over(W.partitionBy("id_link").orderBy("pos"))
    return s.withColumn("to_m", so_far).withColumn("from_m", F.col("to_m") - F.col("length")).withColumn("azimuth", azimuth(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


def built(links: DataFrame) -> DataFrame:
    """Links with defaults for null alpha and rcr, all modes where modes is null, and free-flow minutes t0."""
    return links.withColumns({"alpha": F.coalesce("alpha", F.lit(1.6).cast("float")), "rcr": F.coalesce("rcr", F.lit(30.0).cast("float")), "all_modes": F.col("modes").isNull(), "t0": free_flow_minutes(F.col("length").cast("double"), F.col("v0").cast("double"))})


def adjacency(links: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(in_link, out_link, via, penalty): each pair of links that meet head to tail; every turn of a pair is kept, a
    pair without one has penalty 0."""
    a = links.select(F.col("id").alias("in_link"), F.col("to_node").alias("via"))
    b = links.select(F.col("id").alias("out_link"), F.col("from_node").alias("via"))
    pairs = a.join(b, "via")
    if turns is not None:
        pairs = pairs.join(turns.select("in_link", "out_link", "penalty"), ["in_link", "out_link"], "left")
        return pairs.select("in_link", "out_link", "via", F.coalesce("penalty", F.lit(0.0)).alias("penalty"))
    return pairs.select("in_link", "out_link", "via", F.lit(0.0).alias("penalty"))


def turn_classes(links: DataFrame) -> DataFrame:
    """(in_link, out_link, turn): class of each pair by its last and first segment."""
    v = vertices(F.col("geometry"))
    g = links.select("id", "from_node", "to_node", v.alias("v")).where(F.size("v") > 1)
    last = g.select(F.col("id").alias("in_link"), F.col("to_node").alias("via"), F.element_at("v", -1).alias("b"), F.element_at("v", -2).alias("a"))
    first = g.select(F.col("id").alias("out_link"), F.col("from_node").alias("via"), F.element_at("v", 1).alias("c"), F.element_at("v", 2).alias("d"))
    j = last.join(first, "via")
    kind = turn_class(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("d.x") - F.col("c.x"), F.col("d.y") - F.col("c.y"))
    return j.select("in_link", "out_link", kind.alias("turn"))


#: Seconds that a turn takes by its class.
TURN_SECONDS = {"slight_right": 1.0, "elbow_right": 1.0, "sharp_right": 1.0, "slight_left": 4.0, "elbow_left": 5.0, "sharp_left": 6.0, "u_turn": 7.0}


def turn_penalties(links: DataFrame) -> DataFrame:
    """Minutes of each turn by its class."""
    known = F.create_map(*[F.lit(v) for kv in TURN_SECONDS.items() for v in kv])
    return turn_classes(links).select("in_link", "out_link", (F.coalesce(F.try_element_at(known, F.col("turn")), F.lit(0.0)) / 60).alias("penalty"))


def resolved_turns(node_turns: DataFrame, links: DataFrame) -> DataFrame:
    """Turns given as (from_node, via_node, to_node) as pairs of links."""
    a = links.select(F.col("id").alias("in_link"), "from_node", F.col("to_node").alias("via_node"))
    b = links.select(F.col("id").alias("out_link"), F.col("from_node").alias("via_node"), "to_node")
    return node_turns.join(a, ["from_node", "via_node"]).join(b, ["via_node", "to_node"])


def checks(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, n): links without a known end, and links of no length or speed."""
    ends = links.select(F.explode(F.array("from_node", "to_node")).alias("id"), F.col("id").alias("link"))
    dangling = ends.join(nodes.select("id"), "id", "left_anti").select("link").distinct().agg(F.count(F.lit(1)).alias("n"))
    flat = links.agg(F.count_if(~(F.col("length") > 0) | F.col("length").isNull()).alias("length"), F.count_if(~(F.col("v0") > 0) | F.col("v0").isNull()).alias("v0"))
    return dangling.select(F.lit("dangling").alias("check"), "n").unionByName(flat.select(F.stack(F.lit(2), F.lit("no_length"), "length", F.lit("no_speed"), "v0").alias("check", "n")))


def turn_checks(turns: DataFrame, links: DataFrame, zones: DataFrame) -> DataFrame:
    """(check, n): turns (from_node, via_node, to_node) with a node that no link has (a null too), and zones that are no node."""
    nodes = links.select(F.explode(F.array("from_node", "to_node")).alias("id")).distinct()
    named = turns.withColumn("turn", F.struct("from_node", "via_node", "to_node")).select("turn", F.explode(F.array("from_node", "via_node", "to_node")).alias("id"))
    lost = named.join(nodes, "id", "left_anti").select("turn").distinct()
    bad = turns.withColumn("turn", F.struct("from_node", "via_node", "to_node")).join(lost, "turn", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    alone = zones.join(nodes, "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return bad.select(F.lit("turn_nodes").alias("check"), "n").unionByName(alone.select(F.lit("zones_without_node").alias("check"), "n"))


def static_results(results: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flow, mean speed, density (flow over speed) and saturation (flow over capacity) of links by keys such as time and
    mode; null where divided by 0. results has flow and avg_speed."""
    g = results.groupBy(*keys).agg(F.sum("flow").alias("flow"), F.avg("avg_speed").alias("speed"))
    g = g.join(links.select(F.col("id").alias("id_link"), F.col("capacity").cast("double").alias("capacity")), "id_link")
    return g.withColumns({"density": F.try_divide("flow", "speed"), "saturation": F.try_divide("flow", "capacity")})


def with_node_minutes(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """Turns (in_link, out_link, via, penalty) that also take the minutes of the node passed (id, minutes); a node
    without minutes takes none."""
    n = nodes.select(F.col("id").alias("via"), F.col("minutes").alias("__node"))
    return turns.join(n, "via", "left").withColumn("penalty", F.col("penalty") + F.coalesce("__node", F.lit(0.0))).drop("__node")


def set_links(sets: DataFrame) -> DataFrame:
    return sets.groupBy("id_set").agg(F.array_sort(F.collect_set("id_link")).alias("links"))


def referenced_links(refs: DataFrame, sets: DataFrame, links: DataFrame, ref: str = "ref") -> DataFrame:
    """refs with id_link for each link that ref means: null all links, digits one link, '[1, 2]' those, else a set."""
    kind = F.when(F.col(ref).isNull(), "all").when(F.col(ref).rlike("^\\s*\\d+\\s*$"), "one").when(F.col(ref).rlike("^\\s*\\["), "list").otherwise("set")
    r = refs.withColumn("__kind", kind)
    listed = r.where("__kind in ('one', 'list')").withColumn("id_link", F.explode(F.regexp_extract_all(ref, F.lit("\\d+"), 0))).withColumn("id_link", F.col("id_link").cast("bigint"))
    named = r.where("__kind = 'set'").join(sets.select(F.col("id_set").alias("__set"), "id_link"), F.upper(F.trim(ref)) == F.col("__set")).drop("__set")
    every = r.where("__kind = 'all'").crossJoin(links.select(F.col("id").alias("id_link")))  # a null reference means all links
    return listed.unionByName(named).unionByName(every).drop("__kind")


def path_flows(paths: DataFrame, keys: tuple[str, ...] = ("id_link", "t_start")) -> DataFrame:
    """Sum of path_flow on each link: paths exploded, partial sums before the shuffle."""
    return paths.select("*", F.explode("links").alias("id_link")).groupBy(*keys).agg(F.sum("path_flow").alias("flow"))


def link_results(results: DataFrame, links: DataFrame, minutes: int = 15) -> DataFrame:
    """Mean speed, density and travel time and hourly flow of links by slot, with the saturation by capacity."""
    at = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("slot_ts").cast("timestamp")) / (60 * minutes)) * (60 * minutes)).cast("timestamp_ntz")
    g = results.groupBy(at.alias("slot"), "id_link").agg(F.avg("avg_speed").alias("speed"), F.sum("flow_in").alias("flow"), F.avg("density").alias("density"), F.max("tt").alias("tt"))
    return g.join(links.select(F.col("id").alias("id_link"), "capacity", "v0"), "id_link").select("slot", "id_link", "speed", "flow", "density", "tt", F.try_divide(F.col("flow"), F.col("capacity")).alias("saturation"), F.try_divide(F.col("speed"), F.col("v0")).alias("speed_share"))


def congestion(results: DataFrame, sets: DataFrame, levels: tuple[float, ...] = (0.3, 0.6, 0.8)) -> DataFrame:
    """Per set: mean speed weighted by length, kilometres, share of readings at or below each level of v / v0, congested
    slots, and largest and smallest total travel time of a slot. results has id_link, slot, speed, tt, length, v0."""
    rows = sets.join(results, "id_link")
    ratio = F.try_divide(F.col("speed"), F.col("v0"))
    low = [F.sum(F.when(ratio <= v, 1).otherwise(0)).alias(f"low_{i}") for i, v in enumerate(levels)]
    slot = rows.groupBy("id_set", "slot").agg(F.sum("tt").alias("tt"), F.sum(F.col("speed") * F.col("length")).alias("vl"), F.sum(F.when(F.col("speed").isNotNull(), F.col("length"))).alias("l"), F.count("speed").alias("n"), *low)
    shares = [F.try_divide(F.sum(f"low_{i}"), F.sum("n")).alias(f"share_{i}") for i in range(len(levels))]
    return slot.groupBy("id_set").agg(F.try_divide(F.sum("vl"), F.sum("l")).alias("v_avg"), F.sum("l").alias("km"), *shares, F.count_if(F.col("low_0") > 0).alias("congested_slots"), F.max("tt").alias("max_tt"), F.min("tt").alias("min_tt"))


def allowed(df: DataFrame, mode: str) -> DataFrame:
    """Rows (links, nodes or turns) that a mode may use: null, empty or 'all' modes are every mode, 'none' is none."""
    m = F.col("modes")
    return df.where(m.isNull() | (F.size(m) == 0) | F.array_contains(m, "all") | (F.array_contains(m, mode) & ~F.array_contains(m, "none")))


def parsed_set(text: Column) -> Column:
    """A comma-separated text as an array of distinct trimmed names; null for null or blank."""
    return F.when(F.trim(text) != "", F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda v: v != "")))


def path_counters(paths: DataFrame, link: int) -> DataFrame:
    """Links in all paths, paths that use a link, how often it is used, and different paths: one row."""
    return paths.agg(F.sum(F.size("links")).alias("links"), F.count_if(F.array_contains("links", link)).alias("paths_with_link"), F.sum(F.size(F.filter("links", lambda v: v == link))).alias("uses"), F.countDistinct("links").alias("unique_paths"))


def path_geometry(paths: DataFrame, links: DataFrame, key: str = "path") -> DataFrame:
    """(path, xy): vertices of a path's links in order, repeated joints once. A path's links are its own bound."""
    from roadloom.functions.wkb import merged

    e = paths.select(key, F.posexplode("links").alias("pos", "id")).join(links.select("id", vertices(F.col("geometry")).alias("xy")), "id")
    g = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "xy"))).alias("l"))
    return g.select(key, merged(F.col("l.xy")).alias("xy"))


def sparse_speeds(speeds: DataFrame) -> DataFrame:
    """(id_link, slices, speeds): for links with readings, their slices in order and the speeds in these."""
    g = speeds.where("n > 0").groupBy("id_link").agg(F.array_sort(F.collect_list(F.struct("slice", "speed"))).alias("s"))
    return g.select("id_link", F.col("s.slice").alias("slices"), F.col("s.speed").alias("speeds"))
