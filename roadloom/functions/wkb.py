"""Well-known binary to vertices and back, as vectorised functions; lines merged and points along them."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: The codes of the geometry types.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SHAPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(_XY)))])


def parse(data: bytes) -> tuple[str, list[np.ndarray]]:
    """Kind and parts (lines or rings) of a geometry; a third ordinate and an SRID are passed over."""

    def one(at: int) -> tuple[str, list[np.ndarray], int]:
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        base = code & 0xFFFF
        if base >= 1000:
            dims, base = 2 + (1, 1, 2)[base // 1000 - 1], base % 1000
        kind = KINDS[base]

        def run(at: int, n: int) -> tuple[np.ndarray, int]:
            p = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2].astype(float)
            return p, at + n * dims * 8

        if base == 1:
            p, at = run(at, 1)
            return kind, [p], at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if base == 2:
            p, at = run(at, n)
            return kind, [p], at
        parts: list[np.ndarray] = []
        for _ in range(n):
            if base == 3:
                (m,) = struct.unpack_from(order + "I", data, at)
                p, at = run(at + 4, m)
                parts.append(p)
            else:
                _, more, at = one(at)
                parts += more
        return kind, parts, at

    kind, parts, _ = one(0)
    return kind, parts


@pandas_udf(SHAPE)
def decode(wkb: pd.Series) -> pd.DataFrame:
    """struct(kind, parts) of a geometry; null where there is none or it can't be read."""
    out = []
    for b in wkb:
        try:
            kind, parts = parse(bytes(b))
            out.append((kind, [[{"x": x, "y": y} for x, y in p.tolist()] for p in parts]))
        except (TypeError, ValueError, KeyError, IndexError, struct.error):
            out.append((None, None))
    return pd.DataFrame(out, columns=["kind", "parts"])


@pandas_udf(T.BinaryType())
def encode_line(xy: pd.Series) -> pd.Series:
    """WKB of a line given as an array of struct(x, y); null for fewer than two vertices."""

    def one(v: object) -> bytes | None:
        if v is None or len(v) < 2:
            return None
        return struct.pack("<BII", 1, 2, len(v)) + np.array([(p["x"], p["y"]) for p in v], "<f8").tobytes()

    return xy.map(one)


def merged(lines: Column) -> Column:
    """One line of several that follow each other (array of arrays of vertices): repeated joints once."""
    flat = F.flatten(lines)
    return F.filter(flat, lambda p, i: (i == 0) | (p != F.get(flat, i - 1)))


def along(xy: Column, metres: Column) -> Column:
    """struct(x, y) at a distance from the start of a line of vertices; its ends for less or more than its length."""
    n = F.size(xy)
    start = F.struct(F.get(xy, F.lit(0)).alias("p"), metres.cast("double").alias("left"), F.lit(False).alias("done"))

    def step(acc: Column, i: Column) -> Column:
        b = F.get(xy, i)
        d = F.hypot(b["x"] - acc["p"]["x"], b["y"] - acc["p"]["y"])
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(acc["left"], d), F.lit(1.0))))
        p = F.struct((acc["p"]["x"] + share * (b["x"] - acc["p"]["x"])).alias("x"), (acc["p"]["y"] + share * (b["y"] - acc["p"]["y"])).alias("y"))
        return F.when(acc["done"], acc).otherwise(F.struct(p.alias("p"), (acc["left"] - d).alias("left"), (acc["left"] < d).alias("done")))

    return F.when(n > 0, F.aggregate(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["p"]))
