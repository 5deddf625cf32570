"""Point shapefiles (.shp with .dbf, plain or zipped) as a Spark data source: spark.read.format("points").load(path) gives (x, y, attributes map<string,string>)."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "x double, y double, attributes map<string,string>"


def read_points(shp: bytes) -> Iterator[tuple[float, float] | None]:
    at = 100
    while at + 8 <= len(shp):
        length = struct.unpack_from(">I", shp, at + 4)[0] * 2
        kind = struct.unpack_from("<I", shp, at + 8)[0]
        yield struct.unpack_from("<2d", shp, at + 12) if kind in (1, 11, 21) else None
        at += 8 + length


def read_table(dbf: bytes) -> Iterator[dict[str, str]]:
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    for k in range(n):
        p = head + k * size + 1
        row = {}
        for name, width in fields:
            row[name] = dbf[p : p + width].decode("utf-8", "replace").strip()
            p += width
        yield row


def write_points(path: str, rows: list[tuple[float, float, dict[str, str]]]) -> None:
    """A small writer for fixtures: path without suffix."""
    body = b"".join(struct.pack(">II", k + 1, 10) + struct.pack("<I2d", 1, x, y) for k, (x, y, _) in enumerate(rows))
    box = [min((r[0] for r in rows), default=0), min((r[1] for r in rows), default=0), max((r[0] for r in rows), default=0), max((r[1] for r in rows), default=0), 0, 0, 0, 0]
    Path(path + ".shp").write_bytes(struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<II8d", 1000, 1, *box) + body)
    names = sorted({k for r in rows for k in r[2]})
    width = {k: max(1, *(len(r[2].get(k, "").encode()) for r in rows)) for k in names}
    head = 32 + 32 * len(names) + 1
    out = struct.pack("<BBBBIHH20x", 3, 126, 1, 1, len(rows), head, 1 + sum(width.values()))
    out += b"".join(k.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width[k], 0]) + b"\0" * 14 for k in names) + b"\r"
    for _, _, a in rows:
        out += b" " + b"".join(a.get(k, "").encode().ljust(width[k]) for k in names)
    Path(path + ".dbf").write_bytes(out + b"\x1a")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        p = Path(self.path)
        found = [p] if p.is_file() else sorted([*p.rglob("*.zip"), *p.rglob("*.shp")])
        return [InputPartition(str(f)) for f in found] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        p = Path(partition.value)
        if p.suffix == ".zip":
            with zipfile.ZipFile(io.BytesIO(p.read_bytes())) as z:
                pairs = [(z.read(n), z.read(n[:-4] + ".dbf")) for n in sorted(z.namelist()) if n.lower().endswith(".shp")]
        else:
            pairs = [(p.read_bytes(), p.with_suffix(".dbf").read_bytes())]
        for shp, dbf in pairs:
            for point, row in zip(read_points(shp), read_table(dbf), strict=False):
                yield (*(point or (None, None)), row)


class PointSource(DataSource):
    @classmethod
    def name(cls):
        return "points"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PointSource)
