"""Map matching and nearest links by an equi-join on grid cells with an exact test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadloom.functions.scalars import angle_between, angle_likelihood, distance_likelihood


def on_segment() -> tuple[Column, Column]:
    """Distance of (x, y) to the segment (x1, y1, x2, y2), and the share of the segment at the nearest point."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.coalesce(F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(F.col("x") - F.col("x1") - s * dx, F.col("y") - F.col("y1") - s * dy), s


def candidates(points: DataFrame, segs: DataFrame, reach: float, max_angle: float | None = None) -> DataFrame:
    """Pairs of points and segments at most reach apart (and with an angle below max_angle to the point's heading).

    A segment goes to the cells (of size reach) along it: in each column of cells that it meets, widened by reach, to
    the rows that its part there may reach, so a long diagonal has cells by its length, not by its box. A point lies in
    one cell, so a pair occurs once and no pair is lost. Hot cells are split by AQE, which the join leaves free to do so.
    """
    cell = lambda c: F.floor(c / reach)
    west, east = F.least("x1", "x2"), F.greatest("x1", "x2")
    s = segs.withColumn("cx", F.explode(F.sequence(cell(west - reach), cell(east + reach))))
    # the part of the segment within reach of the column's sides, and its ends' y
    share = lambda x: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - F.col("x1"), F.col("x2") - F.col("x1")))))
    upright = F.col("x1") == F.col("x2")
    at = lambda x: F.col("y1") + share(x) * (F.col("y2") - F.col("y1"))
    left, right = at((F.col("cx") - 1) * reach), at((F.col("cx") + 2) * reach)
    low = F.when(upright, F.least("y1", "y2")).otherwise(F.least(left, right)) - reach * 1.001
    high = F.when(upright, F.greatest("y1", "y2")).otherwise(F.greatest(left, right)) + reach * 1.001
    s = s.withColumn("cy", F.explode(F.sequence(cell(low), cell(high))))
    p = points.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    d, share_at = on_segment()
    j = p.join(s, ["cx", "cy"]).withColumns({"dist": d, "share": share_at}).where(F.col("dist") <= reach)
    if max_angle is not None:
        j = j.withColumn("angle", angle_between(F.col("heading"), F.col("azimuth"))).where(F.col("angle") < max_angle)
    return j.drop("cx", "cy")


def _likelihoods(points: DataFrame, segs: DataFrame, reach: float, max_angle: float, also: Sequence[str] = ()) -> DataFrame:
    """(id, *also, id_link, w, position): likelihoods of each point's segments, added up per link; the position (metres
    on the link) is that of the link's likeliest segment."""
    c = candidates(points, segs, reach, max_angle)
    c = c.withColumn("w", distance_likelihood(F.col("dist")) * angle_likelihood(F.col("angle"), F.col("engine")))
    return c.groupBy("id", *also, "id_link").agg(F.sum("w").alias("w"), F.max_by(F.col("from_m") + F.col("share") * F.col("length"), F.struct("w", -F.col("pos"))).alias("position"))


def matched(points: DataFrame, segs: DataFrame, reach: float = 50.0, max_angle: float = 45.0, also: Sequence[str] = ()) -> DataFrame:
    """(id, *also, id_link, position, p, n_candidates): each point's likeliest link.

    Likelihoods are normalised over the point. Ties go to the smaller id. Unmatched points give no row. `also` are
    further columns of the points, which have one row an id.
    """
    link = _likelihoods(points, segs, reach, max_angle, also)
    best = link.groupBy("id", *also).agg(F.max_by(F.struct("id_link", "position", "w"), F.struct("w", -F.col("id_link"))).alias("b"), F.sum("w").alias("total"), F.count(F.lit(1)).alias("n_candidates"))
    return best.select("id", *also, "b.id_link", "b.position", F.try_divide(F.col("b.w"), F.col("total")).alias("p"), "n_candidates")


def ranked_candidates(points: DataFrame, segs: DataFrame, reach: float = 50.0, max_angle: float = 45.0) -> DataFrame:
    """(id, id_link, position, p, k): every link a point may lie on with its probability, k = 0 the likeliest; ties to
    the smaller id. A point's candidates are the links in reach."""
    link = _likelihoods(points, segs, reach, max_angle)
    of = W.partitionBy("id")
    return link.select("id", "id_link", "position", F.try_divide(F.col("w"), F.sum("w").over(of)).alias("p"), (F.row_number().over(of.orderBy(F.desc("w"), "id_link")) - 1).alias("k"))


def nearest_link(points: DataFrame, segs: DataFrame, reach: float) -> DataFrame:
    """(id, id_link, dist): the nearest link of each point within reach, ties to the smaller id."""
    c = candidates(points, segs, reach)
    return c.groupBy("id").agg(F.min(F.struct("dist", "id_link")).alias("m")).select("id", "m.id_link", "m.dist")


def link_speeds(matches: DataFrame, minutes: int = 15) -> DataFrame:
    """Mean speed and number of readings by link and slice of (id_link, ts, speed)."""
    at = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (60 * minutes)) * (60 * minutes)).cast("timestamp_ntz")
    return matches.where("speed is not null").groupBy("id_link", at.alias("slice")).agg(F.avg("speed").alias("speed"), F.count("speed").alias("n"))


def merged_speeds(old: DataFrame, new: DataFrame) -> DataFrame:
    """Running mean by link and slice: (v n + v' n') / (n + n')."""
    both = old.unionByName(new)
    return both.groupBy("id_link", "slice").agg(F.try_divide(F.sum(F.col("speed") * F.col("n")), F.sum("n")).alias("speed"), F.sum("n").alias("n"))


def turns_of_matches(matches: DataFrame) -> DataFrame:
    """Successive different links of each vehicle's matched points, in order."""
    w = W.partitionBy("id_veh").orderBy("ts", "id")
    m = matches.withColumn("before", F.lag("id_link").over(w))
    return m.where("before is not null and before <> id_link").groupBy(F.col("before").alias("in_link"), F.col("id_link").alias("out_link")).agg(F.count(F.lit(1)).alias("n"))
