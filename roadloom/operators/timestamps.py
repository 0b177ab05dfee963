"""Timestamps in mixed formats, precisions and zones, normalised to UTC instants through a dictionary.

Distinct pairs of raw text and source zone are parsed once and kept in a table; later inputs parse only what the table
doesn't hold; rows get their instant by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.session import kernel_partitions, shared_folder

#: Months by their first three letters, in English and Italian, and offsets in hours of zone names.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "gen": 1, "mag": 5, "giu": 6, "lug": 7, "ago": 8, "set": 9, "ott": 10, "dic": 12}
ZONES = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}

_DATES = (
    r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})[-/.](?P<d>\d{1,2})",
    r"(?P<y>\d{4})-(?P<doy>\d{3})",
    r"(?P<d>\d{1,2})[-/.](?P<mo>\d{1,2})[-/.](?P<y>\d{4})",
    r"(?:[A-Za-z]{2,9}\.?,?\s+)?(?P<d>\d{1,2})[-\s](?P<mon>[A-Za-z]{3,9})\.?[-\s](?P<y>\d{4})",
)
_TIME = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(?P<zone>[A-Za-z]{1,4}|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?)?"
_FORMS = [re.compile(date + r"(?:[Tt]|,?\s+)" + _TIME + _ZONE) for date in _DATES]
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:[Tt\s]?)(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d+))?" + _ZONE)
_NUMBER = re.compile(r"([-+]?\d+)(?:[.,](\d+))?")
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@lru_cache(maxsize=1000)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _offset(text: str) -> timedelta | None:
    """The offset that a written zone means, None if it isn't known."""
    if text.lower() in ZONES:
        return timedelta(hours=ZONES[text.lower()])
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?", text)
    if not m or int(m[2]) > 18 or int(m[3] or 0) > 59:
        return None
    return timedelta(hours=int(m[2]), minutes=int(m[3] or 0)) * (-1 if m[1] == "-" else 1)


def _count(whole: str, fraction: str | None) -> int | None:
    """A plain number from 1970: its size tells seconds, milliseconds, microseconds or nanoseconds."""
    n, size = int(whole), len(whole.lstrip("+-0"))
    for digits, unit in ((11, 1_000_000), (13, 1_000), (16, 1)):
        if size <= digits:
            part = int((fraction or "0")[:6].ljust(6, "0")) * unit // 1_000_000
            return (n * unit + (part if n >= 0 else -part)) if size >= 9 else None
    return n // 1000 if size <= 19 else None


def instant(text: str | None, zone: str, default: str = "Europe/Rome") -> int | None:
    """Microseconds since 1970 UTC of a text that denotes exactly one instant, else None.

    A zone or offset in the text prevails over `zone` (the default where that is empty). A local time that a clock
    change skips or repeats, a date or time alone, an impossible date, and an unknown zone denote none. Finer digits
    are cut off, missing seconds are 0, numeric dates that don't begin with the year are day first.
    """
    t = re.sub(r"[\s ​﻿]+", " ", text or "").strip()
    m = _COMPACT.fullmatch(t)
    if not m:
        if n := _NUMBER.fullmatch(t):
            return _count(n[1], n[2])
        m = next((m for form in _FORMS if (m := form.fullmatch(t))), None)
        if not m:
            return None
    g = {"doy": None, "mon": None, "ap": None, **m.groupdict()}
    try:
        hour = int(g["h"])
        if g["ap"]:
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (g["ap"][0] in "Pp")
        if g["doy"]:
            day = datetime(int(g["y"]), 1, 1) + timedelta(days=int(g["doy"]) - 1)
            if day.year != int(g["y"]):
                return None
        else:
            day = datetime(int(g["y"]), MONTHS[g["mon"][:3].lower()] if g["mon"] else int(g["mo"]), int(g["d"]))
        local = day.replace(hour=hour, minute=int(g["mi"]), second=int(g["s"] or 0), microsecond=int((g["f"] or "")[:6].ljust(6, "0")))
    except (ValueError, KeyError):
        return None
    if g["zone"]:
        off = _offset(g["zone"])
        if off is None:
            return None
    else:
        z = _zone(zone or default)
        if z is None:
            return None
        off, other = (local.replace(tzinfo=z, fold=k).utcoffset() for k in (0, 1))
        if off != other:  # skipped or repeated
            return None
    return (local.replace(tzinfo=timezone(off)) - EPOCH) // timedelta(microseconds=1)


#: The version of the rules above: what other rules parsed is another dictionary.
RULES = 1
DICTIONARY = "raw string, zone string, epoch_us bigint"


def parsed(pairs: DataFrame) -> DataFrame:
    """(raw, zone, epoch_us) of distinct pairs (raw, zone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us = [instant(r, z) for r, z in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(us, pa.int64())], ["raw", "zone", "epoch_us"])

    return pairs.mapInArrow(run, DICTIONARY)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def dictionary(rows: DataFrame, text: str, zone: str, path: str) -> DataFrame:
    """The dictionary table at path, after the pairs of rows that it lacks have been parsed and appended to it.

    A pair that two writers append at the same time comes out once. The parsing is dealt over all cores, as its cost
    goes by the value and not by the byte.
    """
    spark = rows.sparkSession
    pairs = rows.where(F.trim(text) != "").select(F.col(text).alias("raw"), F.coalesce(F.trim(zone), F.lit("")).alias("zone")).distinct()
    known = _exists(spark, path)
    if known:
        pairs = pairs.join(spark.read.schema(DICTIONARY).parquet(path), ["raw", "zone"], "left_anti")
    if not known or not pairs.isEmpty():
        parsed(pairs.repartition(kernel_partitions(spark), "raw", "zone")).write.mode("append").parquet(path)
    return spark.read.schema(DICTIONARY).parquet(path).groupBy("raw", "zone").agg(F.first("epoch_us").alias("epoch_us"))


def with_instants(rows: DataFrame, text: str = "ts_text", zone: str = "tz_data", path: str | None = None) -> DataFrame:
    """rows with epoch_us, null where the text denotes no single instant (missing, unreadable, ambiguous).

    The dictionary lies at path, by default in the shared folder, where the next call, also of another session, finds
    it again and parses only what is new. Null and blank texts need no join; a text shared by a third of the rows is
    one row of the dictionary, and AQE splits its side of the join.
    """
    path = path or f"{shared_folder(rows.sparkSession)}/roadloom-instants-{RULES}"
    d = dictionary(rows, text, zone, path).where("epoch_us is not null")
    d = d.select(F.col("raw").alias("__raw"), F.col("zone").alias("__zone"), F.col("epoch_us").alias("__us"))
    return rows.join(d, (F.col(text) == F.col("__raw")) & (F.coalesce(F.trim(zone), F.lit("")) == F.col("__zone")), "left").select(rows["*"], F.col("__us").alias("epoch_us"))


def p7_found(raw: DataFrame) -> DataFrame:
    return with_instants(raw.select("id_fcd", "ts_text", "tz_data")).where("epoch_us is not null").select("id_fcd", "epoch_us")
