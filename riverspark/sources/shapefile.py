"""Shapefiles (points, lines, polygons; with their DBF table) as a data source, in ranges of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

ROWS = 50_000


class Records(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _beside(path: str, suffix: str) -> Path:
    p = Path(path)
    return next((q for q in (p.with_suffix(suffix), p.with_suffix(suffix.upper())) if q.exists()), p.with_suffix(suffix))


def _header(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, header bytes, record bytes and fields (name, type, width, decimals) of the DBF table."""
    with _beside(path, ".dbf").open("rb") as f:
        head = f.read(32)
        n, start, size = struct.unpack_from("<IHH", head, 4)
        fields = []
        while (d := f.read(32))[0] != 0x0D:
            fields.append((d[:11].split(b"\0")[0].decode("latin-1"), chr(d[11]), d[16], d[17]))
    return n, start, size, fields


def _value(raw: bytes, kind: str, decimals: int, encoding: str):
    text = raw.decode(encoding, "replace").strip()
    if kind not in "NF":
        return text or None
    try:
        return (float(text) if decimals or kind == "F" else int(text)) if text else None
    except ValueError:  # asterisks: a value that didn't fit
        return None


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows, self.encoding = options["path"], int(options.get("rows", ROWS)), options.get("encoding", "utf-8")

    def partitions(self) -> Sequence[InputPartition]:
        n = _header(self.path)[0]
        return [Records(a, min(a + self.rows, n)) for a in range(0, max(n, 1), self.rows)]

    def read(self, partition: Records) -> Iterator[tuple]:
        _, start, size, fields = _header(self.path)
        with Path(self.path).open("rb") as shp, _beside(self.path, ".shx").open("rb") as shx, _beside(self.path, ".dbf").open("rb") as dbf:
            for k in range(partition.first, partition.last):
                shx.seek(100 + 8 * k)
                offset, length = struct.unpack(">ii", shx.read(8))
                shp.seek(offset * 2 + 8)
                body = shp.read(length * 2)
                (kind,) = struct.unpack_from("<i", body)
                if kind == 0:
                    box = (None,) * 4
                elif kind % 10 == 1:
                    box = struct.unpack_from("<dd", body, 4) * 2
                else:
                    box = struct.unpack_from("<dddd", body, 4)
                dbf.seek(start + size * k)
                row, at, values = dbf.read(size), 1, []
                if row[:1] == b"*":  # deleted
                    continue
                for _, t, width, decimals in fields:
                    values.append(_value(row[at : at + width], t, decimals, self.encoding))
                    at += width
                x, y = (box[0], box[1]) if kind % 10 == 1 else (None, None)
                yield (*values, kind, x, y, *box)


class ShapefileSource(DataSource):
    """spark.read.format("shapefile").load(path to .shp): the table's columns, then shape_type, x, y (of points), min_x, min_y, max_x, max_y.

    Null shapes have null coordinates; deleted records are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        kinds = {"N": lambda d: DoubleType() if d else LongType(), "F": lambda d: DoubleType()}
        fields = [StructField(n, kinds.get(t, lambda d: StringType())(dec)) for n, t, _, dec in _header(self.options["path"])[3]]
        return StructType([*fields, StructField("shape_type", LongType()), *[StructField(n, DoubleType()) for n in ("x", "y", "min_x", "min_y", "max_x", "max_y")]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    @staticmethod
    def write_points(path: str, field: str, rows: list[tuple]) -> None:
        """Points (id, x, y) with one whole-number column; for small layers, on the driver. Names end after 10 characters."""
        n = len(rows)
        xs, ys = [r[1] for r in rows] or [0.0], [r[2] for r in rows] or [0.0]
        box = struct.pack("<4d4d", min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
        head = lambda words: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii", 1000, 1) + box
        Path(path).write_bytes(head(50 + 14 * n) + b"".join(struct.pack(">ii", k + 1, 10) + struct.pack("<idd", 1, x, y) for k, (_, x, y) in enumerate(rows)))
        Path(path).with_suffix(".shx").write_bytes(head(50 + 4 * n) + b"".join(struct.pack(">ii", 50 + 14 * k, 10) for k in range(n)))
        column = field[:10].encode().ljust(11, b"\0") + b"N" + bytes(4) + bytes([20, 0]) + bytes(14)
        Path(path).with_suffix(".dbf").write_bytes(struct.pack("<B3BIHH20x", 3, 26, 1, 1, n, 65, 21) + column + b"\r" + b"".join(b" " + str(i).rjust(20).encode() for i, *_ in rows) + b"\x1a")
