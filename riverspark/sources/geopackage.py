"""GeoPackage layers as a data source: one partition per range of rowids; points, lines and polygons give their bounds."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

ROWS = 50_000
_KINDS = {"INTEGER": LongType(), "INT": LongType(), "MEDIUMINT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "FLOAT": DoubleType()}


def bounds(wkb: bytes) -> tuple[float, float, float, float] | None:
    """min x, min y, max x, max y of a WKB geometry; None if it is empty."""
    found: list[tuple[float, float]] = []

    def read(at: int) -> int:
        e = "<" if wkb[at] == 1 else ">"
        (kind,) = struct.unpack_from(e + "I", wkb, at + 1)
        flags, kind = kind >> 28, kind & 0x0FFFFFFF
        dims = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3) + bool(flags & 8) + bool(flags & 4)
        at, kind = at + 5 + 4 * bool(flags & 2), kind % 1000

        def points(at: int, n: int) -> int:
            for i in range(n):
                x, y = struct.unpack_from(e + "dd", wkb, at + i * dims * 8)
                if x == x:
                    found.append((x, y))
            return at + n * dims * 8

        def count(at: int) -> tuple[int, int]:
            return struct.unpack_from(e + "I", wkb, at)[0], at + 4

        if kind == 1:
            return points(at, 1)
        n, at = count(at)
        if kind == 2:
            return points(at, n)
        for _ in range(n):
            if kind == 3:
                k, at = count(at)
                at = points(at, k)
            else:
                at = read(at)
        return at

    read(0)
    if not found:
        return None
    xs, ys = zip(*found)
    return min(xs), min(ys), max(xs), max(ys)


class Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.layer, self.rows = schema, options["path"], options["layer"], int(options.get("rows", ROWS))
        self.where = options.get("where", "")

    def partitions(self) -> Sequence[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.layer)}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        return [Rows(a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        plain = [f.name for f in self.schema.fields[:-5]]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            (geometry,) = c.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (self.layer,)).fetchone()
            sql = f"SELECT {', '.join(map(_quoted, [*plain, geometry]))} FROM {_quoted(self.layer)} WHERE rowid BETWEEN ? AND ?" + (f" AND ({self.where})" if self.where else "")
            for *values, blob in c.execute(sql, (partition.first, partition.last)):
                wkb = None
                if blob:
                    wkb = blob[8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] :]
                yield (*values, wkb, *((bounds(wkb) if wkb else None) or (None,) * 4))


class GeoPackageSource(DataSource):
    """spark.read.format("geopackage").option("layer", name).load(path): the layer's columns, then wkb, min_x, min_y, max_x, max_y.

    option("columns", "a, b") reads only those of the layer's columns, option("where", "a IN (1, 2)") only the rows that meet
    a condition of the file's SQL; both reach the file. Null or empty geometries have null bounds; an empty layer gives no rows; an unknown layer is an error. Layer columns
    must not be called like the five added ones.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> StructType:
        layer = self.options["layer"]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            found = c.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
            if not found:
                raise ValueError(f"no layer {layer}")
            columns = c.execute(f"PRAGMA table_info({_quoted(layer)})").fetchall()
        chosen = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else None
        if chosen and (lacking := set(chosen) - {c[1] for c in columns}):
            raise ValueError(f"layer {layer} lacks column(s) {', '.join(sorted(lacking))}")
        if chosen:
            columns = [c for c in columns if c[1] in chosen]
        fields = [StructField(n, _KINDS.get(t.upper().split("(")[0], StringType())) for _, n, t, *_ in columns if n != found[0]]
        return StructType([*fields, StructField("wkb", BinaryType()), *[StructField(n, DoubleType()) for n in ("min_x", "min_y", "max_x", "max_y")]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(schema, dict(self.options))

    @classmethod
    def write_boxes(cls, path: str, layer: str, rows: list[tuple]) -> None:
        """A layer of boxes (hybas_id, continent, min_x, min_y, max_x, max_y); for small layers, on the driver."""
        ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        cls.write_polygons(path, layer, [(i, continent, [ring(*box)]) for i, continent, *box in rows])

    @staticmethod
    def write_polygons(path: str, layer: str, rows: list[tuple]) -> None:
        """A layer of polygons (hybas_id, continent, rings of (x, y), closed); for small layers, on the driver."""
        with sqlite3.connect(path) as c:
            c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
            c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', 4326, 0, 0)", (layer,))
            c.execute(f"CREATE TABLE {_quoted(layer)} (fid INTEGER PRIMARY KEY, geom BLOB, hybas_id INTEGER, continent TEXT)")
            for k, (i, continent, rings) in enumerate(rows):
                wkb = struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
                c.execute(f"INSERT INTO {_quoted(layer)} VALUES (?, ?, ?, ?)", (k + 1, b"GP\0\1" + struct.pack("<i", 4326) + wkb, i, continent))
