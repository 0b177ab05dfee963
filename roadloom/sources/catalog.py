"""Datasets by description: scan, filter, mapping, computed and constant columns, types, time zones; and the sinks.

Filters are put on the stored columns, before any cast, so that they and the column pruning reach the scan.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.predicates import both, dnf, frame_expression
from roadloom.functions.wkb import parse

#: Formats by file ending. A folder is read as what its files' ending says.
FORMATS = {".parquet": "parquet", ".geoparquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text"}
_FUNCTIONS: dict[str, Any] = {}


def register_function(name: str, fn: Any) -> None:
    """A column function that a mapping may call by name ('function:name'); text is never evaluated as Python."""
    _FUNCTIONS[name] = fn


def format_of(path: str) -> str:
    end = os.path.splitext(path.rstrip("/"))[1].lower()
    if end in (".feather", ".pickle", ".pkl", ".shp"):
        raise ValueError(f"{end} files are not supported; convert them to parquet")
    if end in (".gpkg", ".sqlite"):
        return "sqlite"
    return FORMATS.get(end, "parquet")


@dataclass
class Dataset:
    """A table and how its columns become the engine's.

    mapping: engine name -> stored name, 'expression:<SQL>' or 'function:<registered name>'; with one, only mapped and
    additional columns remain, and a stored name that isn't there gives null. additional_fields: name -> (value, type).
    filters: DNF list, SQL text or data-frame text ('frame:...'), over stored names.
    """

    path: str = ""
    format: str = ""
    schema: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)
    filters: Any = None
    mapping: Mapping[str, str] = field(default_factory=dict)
    additional_fields: Mapping[str, tuple[Any, str]] = field(default_factory=dict)
    dtype: Mapping[str, str] = field(default_factory=dict)
    tz_source: str | None = None
    tz_columns: Sequence[str] = ()

    def scan(self, spark: SparkSession) -> DataFrame:
        kind = self.format or format_of(self.path)
        reader = spark.read.options(**{"header": True, **self.options}) if kind == "csv" else spark.read.options(**self.options)
        if kind == "sqlite":
            from roadloom.sources.sqlite import SqliteSource

            spark.dataSource.register(SqliteSource)
            return reader.format("sqlite_table").option("path", self.path).load()
        if kind == "json" and self.path.endswith(".json"):
            reader = reader.option("multiLine", True)
        if self.schema:
            reader = reader.schema(self.schema)
        return reader.format(kind).load(self.path) if kind != "jdbc" else reader.format("jdbc").load()

    def read(self, spark: SparkSession, call_filter: Any = None) -> DataFrame:
        df = self.scan(spark)
        df = df.where(both(_condition(self.filters), _condition(call_filter)))
        if self.mapping:
            df = df.select(*[_source(df, v).alias(k) for k, v in self.mapping.items()])
        df = df.withColumns({k: F.lit(v).cast(t) for k, (v, t) in self.additional_fields.items()}) if self.additional_fields else df
        if self.tz_source:
            df = df.withColumns({c: F.convert_timezone(F.lit(self.tz_source), F.lit("UTC"), F.col(c).cast("timestamp_ntz")) for c in self.tz_columns})
        return df.withColumns({c: F.col(c).cast(t) for c, t in self.dtype.items()}) if self.dtype else df

    def write(self, df: DataFrame, mode: str = "w", partition_by: Sequence[str] = ()) -> None:
        """Writes df under its stored names; mode w and t replace, a appends. Partition folders are hive-style."""
        back = {k: v for k, v in self.mapping.items() if not v.startswith(("expression:", "function:")) and k in df.columns}
        df = df.withColumnsRenamed(back)
        writer = df.write.mode({"w": "overwrite", "t": "overwrite", "a": "append"}[mode]).options(**self.options)
        kind = self.format or format_of(self.path)
        if kind == "csv":
            writer = writer.option("header", True)
        if kind == "jdbc":
            writer.format("jdbc").option("truncate", mode == "t").option("batchsize", 1000).save()
            return
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.format(kind).save(self.path)


def _condition(f: Any) -> Column | None:
    if f is None or (isinstance(f, list | tuple) and not f):
        return None
    if isinstance(f, Column):
        return f
    if isinstance(f, str):
        return F.expr(frame_expression(f[6:]) if f.startswith("frame:") else f)
    return dnf(f)


def _source(df: DataFrame, value: str) -> Column:
    if value.startswith("expression:"):
        return F.expr(value[11:])
    if value.startswith("function:"):
        return _FUNCTIONS[value[9:]](df)
    return F.col(f"`{value}`") if value in df.columns else F.lit(None)


#: Columns of each layer: name, type, whether required, default.
LAYERS: dict[str, tuple[tuple[str, str, bool, Any], ...]] = {
    "modes": (("code", "string", True, None), ("description", "string", False, ""), ("eq_factor", "float", False, 1.0)),
    "detectors": (("id", "bigint", True, None), ("id_link", "bigint", True, None)),
    "counts": (("id", "bigint", True, None), ("timestamp", "smallint", True, None), ("mode", "string", False, None), ("counts", "float", True, None)),
    "matrices": (("o", "bigint", True, None), ("d", "bigint", True, None), ("value", "float", True, None), ("timestamp", "smallint", True, None)),
    "zones": (("id", "bigint", True, None), ("geometry", "string", False, None)),
    "nodes": (("id", "bigint", True, None), ("centroid", "tinyint", True, None), ("modes", "array<string>", False, None), ("geometry", "string", False, None)),
    "links": (
        ("id", "bigint", True, None), ("from_node", "bigint", True, None), ("to_node", "bigint", True, None), ("v0", "float", True, None), ("connector", "boolean", True, None), ("lanes", "float", True, None),
        ("alpha", "float", False, 1.6), ("rcr", "float", False, 30.0), ("capacity", "float", True, None), ("length", "float", True, None), ("modes", "array<string>", False, None), ("geometry", "string", True, None),
    ),
    "turns": (("from_link", "bigint", False, None), ("to_link", "bigint", False, None), ("modes", "array<string>", False, None), ("penalty", "double", False, float("inf"))),
    "links_sets": (("id_set", "string", True, None), ("id_link", "bigint", True, None)),
    "fcd": (("id_fcd", "string", True, None), ("id_trip", "string", False, None), ("id_veh", "string", True, None), ("ts", "timestamp_ntz", True, None), ("engine", "tinyint", False, 1), ("speed", "float", False, None), ("heading", "float", False, None), ("progr", "float", False, None), ("x", "double", False, None), ("y", "double", False, None)),
    "events": (("id_link_set", "string", True, None), ("event_type", "string", True, None), ("start_hm", "string", True, None), ("end_hm", "string", True, None), ("params", "string", True, None)),
    "traffic_lights": (("id", "bigint", True, None), ("cycle", "float", True, None), ("offset", "float", False, 0.0), ("phases", "string", True, None), ("geometry", "string", True, None)),
    "paths": (("source", "bigint", True, None), ("target", "bigint", True, None), ("t_start", "smallint", True, None), ("t_base", "smallint", False, None), ("t", "bigint", False, None), ("mode", "string", False, None), ("tot_cost", "float", False, None), ("links", "array<bigint>", True, None), ("k", "tinyint", False, None), ("path_flow", "float", False, None)),
    "fcd_paths": (("source", "bigint", True, None), ("target", "bigint", True, None), ("t_start", "smallint", True, None), ("mode", "string", False, None), ("tot_cost", "float", False, None), ("links", "array<bigint>", True, None), ("id_trip", "string", False, None)),
    "aggregated_results": (("slot_ts", "timestamp_ntz", True, None), ("mode", "string", False, None), ("id_link", "bigint", True, None), ("flow_in", "float", False, None), ("flow_out", "float", False, None), ("avg_speed", "double", False, None), ("density", "float", False, None), ("tt", "float", False, None)),
    "trips": (("id_trip", "bigint", True, None), ("id_veh", "string", True, None), ("dt_o", "timestamp_ntz", True, None), ("dt_d", "timestamp_ntz", True, None)),
}


def layer(df: DataFrame, name: str) -> DataFrame:
    """df's columns in the layer's types, nulls of a column with a default filled; further columns pass through."""
    spec = LAYERS[name]
    if missing := [c for c, _, needed, _ in spec if needed and c not in df.columns]:
        raise ValueError(f"{name}: columns missing: {', '.join(missing)}")
    typed = {}
    for c, kind, _, default in spec:
        value = F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)
        typed[c] = value if default is None else F.coalesce(value, F.lit(default).cast(kind))
    return df.withColumns(typed)


def between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows with start <= ts < end; the range reaches the scan."""
    kind = df.schema[ts].dataType.simpleString()
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def violations(df: DataFrame, name: str) -> DataFrame:
    """(field, missing, unreadable): rows without a required value, and with one that isn't of the type; one pass."""
    spec = [s for s in LAYERS[name] if s[0] in df.columns]
    counts = [F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNull() & F.lit(needed)).alias("missing"), F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias("unreadable")) for c, kind, needed, _ in spec]
    return df.agg(F.array(*counts).alias("v")).select(F.inline("v"))


def write_geoparquet(df: DataFrame, path: str, geometry: str, kinds: Sequence[str], crs: Any, mode: str = "w") -> None:
    """GeoParquet 1.0.0: parquet files with a WKB column whose footers describe it, box of the file's geometries included.

    Spark's own writer can't set keys of a footer, so each task writes one file by Arrow into a folder beside the data
    that readers pass over; when all are there the driver moves them into place (and, with mode w, removes what was
    there before). A task run again writes the same file again. The description of the whole, with its box, lies beside
    the data as _geo.json. Null and unreadable geometries have no part in the box; an empty df leaves only that.
    """
    own = f"_writing-{uuid.uuid4().hex}"
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = root.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    child = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join([base, *names]))
    fs.mkdirs(child(own))

    def described(box: Sequence[float] | None) -> str:
        column = {"encoding": "WKB", "geometry_types": list(kinds), "crs": crs} | ({"bbox": list(box)} if box else {})
        return json.dumps({"version": "1.0.0", "primary_column": geometry, "columns": {geometry: column}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, low, high, writer = f"part-{TaskContext.get().partitionId():06}.parquet", 0, np.full(2, np.inf), np.full(2, -np.inf), None
        for b in batches:
            for wkb in b.column(geometry).to_pylist():
                try:
                    p = np.concatenate(parse(wkb)[1])
                except (TypeError, ValueError, KeyError, IndexError, struct.error):
                    continue
                low, high = np.minimum(low, p.min(0)), np.maximum(high, p.max(0))
            if writer is None:
                store, at = FileSystem.from_uri(f"{base}/{own}/{name}")
                writer = pq.ParquetWriter(at, b.schema, filesystem=store)
            writer.write_batch(b)
            rows += b.num_rows
        box = [*low.tolist(), *high.tolist()] if np.isfinite(low).all() else None
        if writer is not None:
            writer.add_key_value_metadata({"geo": described(box)})
            writer.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "n": rows, "box": box}], pa.schema([("file", pa.string()), ("n", pa.int64()), ("box", pa.list_(pa.float64()))]))

    made = df.mapInArrow(run, "file string, n bigint, box array<double>").collect()  # one row a partition
    if mode == "w":
        for old in fs.listStatus(root):
            if old.getPath().getName() != own:
                fs.delete(old.getPath(), True)
    for r in made:
        fs.rename(child(own, r.file), child(f"{own.removeprefix('_writing-')}-{r.file}"))
    fs.delete(child(own), True)
    boxes = np.array([r.box for r in made if r.box]).reshape(-1, 4)
    out = fs.create(child("_geo.json"), True)
    out.write(bytearray(described([*boxes[:, :2].min(0).tolist(), *boxes[:, 2:].max(0).tolist()] if len(boxes) else None).encode()))
    out.close()


def geo_description(path: str) -> dict[str, Any]:
    """The `geo` description in the footer of a GeoParquet file, or of one of a folder's; empty where there is none."""
    store, at = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    if store.get_file_info(at).type == FileType.Directory:
        files = sorted(f.path for f in store.get_file_info(FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))
        if not files:
            return {}
        at = files[0]
    return json.loads((pq.read_metadata(at, filesystem=store).metadata or {}).get(b"geo", b"{}"))


def save_state(df: DataFrame, folder: str, name: str, keys: Sequence[str] = ("day_type", "t")) -> None:
    """A named snapshot, its partitions replaced one by one."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{folder}/{name}")


def load_state(spark: SparkSession, folder: str, name: str, **keys: Any) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").where(dnf([(k, "==", v) for k, v in keys.items()]))
