"""Columns for identifiers and planar points in mixed spellings (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_id(c: Column) -> Column:
    """The number that an identifier text denotes ('5', ' 5', '5.0', '005'), else null."""
    t = F.trim(F.regexp_replace(c, "[\\s\\u00a0\\u200b\\ufeff]+", " "))
    d = t.try_cast("decimal(38,6)")
    return F.coalesce(c.try_cast("bigint"), F.when(d == F.floor(d), F.floor(d).try_cast("bigint")))


def finite(c: Column) -> Column:
    return F.when(F.abs(c) < F.lit(1e15), c)


def first_coordinates(geometry: Column) -> tuple[Column, Column]:
    """The first two numbers of the innermost (last opened) coordinate list of a WKT, EWKT or GeoJSON text.

    Most texts are WKT with blanks; only the others are rewritten to that form first.
    """
    odd = geometry.contains("[") | geometry.contains("\t") | geometry.contains("\n")
    plain = F.when(odd, F.translate(geometry, "[],\t\n", "()   ")).otherwise(geometry)
    inner = F.trim(F.substring_index(F.substring_index(plain, "(", -1), ")", 1))
    rest = F.ltrim(F.substr(inner, F.instr(inner, " ")))
    return tuple(finite(F.substring_index(c, " ", 1).try_cast("double")) for c in (inner, rest))


def with_place(df: DataFrame, geometry: str = "geometry", x: str = "x", y: str = "y") -> DataFrame:
    """Replaces x and y of a ping by its place: that of geometry, or x, y where geometry is null or isn't a point that
    can be read; both null unless both are finite numbers."""
    gx, gy = first_coordinates(F.col(geometry))
    df = df.withColumns({"__gx": gx, "__gy": gy})
    read = F.col("__gx").isNotNull() & F.col("__gy").isNotNull()
    px, py = (F.when(read, F.col(g)).otherwise(finite(F.col(c))) for g, c in (("__gx", x), ("__gy", y)))
    df = df.withColumns({x: px, y: py}).drop("__gx", "__gy", geometry)
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.withColumns({x: F.when(there, F.col(x)), y: F.when(there, F.col(y))})
