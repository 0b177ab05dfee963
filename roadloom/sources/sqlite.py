"""A table of an SQLite or GeoPackage file as a batch source, read in ranges of row ids; geometry stays WKB."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"INT": "bigint", "CHA": "string", "CLO": "string", "TEX": "string", "BLO": "binary", "REA": "double", "FLO": "double", "DOU": "double", "BOO": "boolean"}


def _kind(declared: str) -> str:
    upper = declared.upper()
    if any(g in upper for g in ("GEOMETRY", "POINT", "LINESTRING", "POLYGON")):
        return "binary"
    return next((v for k, v in KINDS.items() if k in upper), "string")


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB inside a GeoPackage geometry; other blobs as they are."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]


class Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: path, table, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        with self._connect() as db:
            found = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {_kind(c[2])}" for c in found)

    def reader(self, schema) -> SqliteReader:  # noqa: ANN001
        return SqliteReader(self.options, [f.name for f in schema.fields], [f.dataType.typeName() for f in schema.fields])


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str], kinds: list[str]) -> None:
        self.path, self.table, self.parts, self.columns, self.kinds = options["path"], options["table"], int(options.get("partitions", 8)), columns, kinds

    def partitions(self) -> list[Rows]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high)):
                yield tuple(wkb_of(v) if k == "binary" else bool(v) if k == "boolean" and v is not None else v for v, k in zip(row, self.kinds, strict=True))
        finally:
            db.close()
