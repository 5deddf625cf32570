"""GeoTIFF as a Spark data source: one partition per file, one row per block and band; and a writer. Baseline TIFF with strips or tiles, no compression or DEFLATE, with or
without horizontal predictor, integer or float samples, both byte orders. NumPy and zlib only.

spark.read.format("raster").load(path) gives (path, band, y0, x0, h, w, data array<double>, gt array<double>); `df.write.format("raster")` takes blocks with a `file` column.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

DECODED = "path string, band int, y0 int, x0 int, h int, w int, data array<double>, gt array<double>, crs int, nodata double"
PROJECTED, GEOGRAPHIC = 3072, 2048  # fixed values: the geo keys that hold an EPSG code
SCHEMA = "path string, band int, y0 int, x0 int, h int, w int, data array<double>, gt array<double>"
# TIFF field types and tags.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, SCALE, TIEPOINT, GEO_KEYS, NODATA = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113,
)


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * n
        where = at + 10 + 12 * k
        if size > 4:
            where = struct.unpack_from(order + "I", raw, where)[0]
        if kind == 2:
            tags[tag] = (raw[where : where + n].split(b"\0")[0].decode("latin-1"),)
        else:
            tags[tag] = struct.unpack_from(order + (code * n if len(code) == 1 else "II" * n), raw, where)
    return order, tags


def read_blocks(raw: bytes) -> Iterator[tuple[int, int, int, np.ndarray, list[float]]]:
    """(band from 1, y0, x0, block, geotransform)."""
    order, t = _tags(raw)
    one = lambda k, d=None: t.get(k, (d,))[0]
    w, h, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(SAMPLE_FORMAT, 1)] + str(one(BITS, 8) // 8))
    scale, tie = t.get(SCALE), t.get(TIEPOINT)
    gt = [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]] if scale and tie else [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    tiled = TILE_OFFSETS in t
    bw, bh = (one(TILE_W), one(TILE_H)) if tiled else (w, min(h, one(ROWS_PER_STRIP, h)))
    offsets, sizes = (t[TILE_OFFSETS], t[TILE_BYTES]) if tiled else (t[STRIP_OFFSETS], t[STRIP_BYTES])
    across, down = -(-w // bw), -(-h // bh)
    planar = one(PLANAR, 1) == 2
    for k, (off, n) in enumerate(zip(offsets, sizes, strict=True)):
        data = raw[off : off + n]
        kind = one(COMPRESSION, 1)
        if kind in (8, 32946):
            data = zlib.decompress(data)
        elif kind != 1:
            raise ValueError(f"compression {kind} is not supported")
        plane, in_plane = divmod(k, across * down)
        by, bx = divmod(in_plane, across)
        rows = bh if tiled else min(bh, h - by * bh)
        per = 1 if planar else samples
        block = np.frombuffer(data, dtype, rows * bw * per).reshape(rows, bw, per)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        block = block[: min(bh, h - by * bh), : min(bw, w - bx * bw)]
        for s in range(per):
            yield (plane if planar else s) + 1, by * bh, bx * bw, block[:, :, s], gt


def header(raw: bytes) -> tuple[int | None, float | None]:
    """EPSG code and no-data value, as far as the file names them."""
    _, t = _tags(raw)
    keys = t.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    try:
        nodata = float(t[NODATA][0]) if NODATA in t else None
    except ValueError:
        nodata = None
    return codes.get(PROJECTED, codes.get(GEOGRAPHIC)), nodata


def block_batches(path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
    """A file's blocks, one batch each; no-data samples are null."""
    crs, nodata = header(raw)
    for band, y0, x0, block, gt in read_blocks(raw):
        data = block.astype(float).ravel()
        missing = np.isnan(data) if nodata is None or np.isnan(nodata) else (data == nodata) | np.isnan(data)
        values = pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data, mask=missing))
        cols = [pa.array([path]), *[pa.array([int(v)], pa.int32()) for v in (band, y0, x0, *block.shape)], values, pa.array([[float(g) for g in gt]], pa.list_(pa.float64())), pa.array([crs], pa.int32()), pa.array([nodata], pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in DECODED.split(", ")])


def decoded(raw: DataFrame) -> DataFrame:
    """Blocks of the files in (path, content): contents come through Spark's own source, so the files may lie wherever Spark can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from block_batches(path, content)

    return raw.select("path", "content").mapInArrow(run, DECODED)


def write_tiff(path: str, bands: np.ndarray, gt: list[float] | None = None, nodata: float | None = None, rows_per_strip: int = 64, crs: int | None = None) -> None:
    """(bands, h, w) as DEFLATE-compressed strips, band after band."""
    b, h, w = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    data = bands.astype(bands.dtype.newbyteorder("<"))
    strips = [zlib.compress(data[k, y : y + rows_per_strip].tobytes()) for k in range(b) for y in range(0, h, rows_per_strip)]
    entries: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (bands.dtype.itemsize * 8,) * b), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (STRIP_OFFSETS, 4, (0,) * len(strips)),
        (SAMPLES, 3, (b,)), (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (2,)), (SAMPLE_FORMAT, 3, (kind,) * b),
    ]
    if gt:
        entries += [(SCALE, 12, (gt[1], -gt[5], 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, gt[0], gt[3], 0.0))]
    if crs:
        entries.append((GEO_KEYS, 3, _geo_keys(crs)))
    if nodata is not None:
        entries.append((NODATA, 2, f"{nodata:g}\0".encode()))

    def lay(offsets: tuple) -> tuple[bytes, int]:
        head, tail, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
        for tag, k, v in sorted(entries):
            v = offsets if tag == STRIP_OFFSETS else v
            raw = v if isinstance(v, bytes) else struct.pack("<" + TYPES[k] * len(v), *v)
            if len(raw) <= 4:
                head += struct.pack("<HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, k, len(v), at + len(tail))
                tail += raw
        return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + head + b"\0" * 4 + tail, at + len(tail)

    _, start = lay((0,) * len(strips))
    offsets = tuple(start + sum(map(len, strips[:k])) for k in range(len(strips))) if len(strips) < 2000 else tuple((start + np.concatenate([[0], np.cumsum([len(s) for s in strips])[:-1]])).tolist())
    Path(path).write_bytes(lay(offsets)[0] + b"".join(strips))


def _geo_keys(crs: int) -> tuple[int, ...]:
    geographic = crs == 4326
    return (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, crs)


def create_empty(path: str, bands: int, height: int, width: int, dtype: str = "uint8", gt: list[float] | None = None, nodata: float | None = None, crs: int | None = None) -> None:
    """A file of zeros (or of `nodata`) whose samples lie uncompressed, band after band, so that windows can be written into it. path: on a file system that every task sees as one."""
    kind = np.dtype(dtype).newbyteorder("<")
    if bands * height * width * kind.itemsize >= 2**32 - 4096:
        raise ValueError("a TIFF file holds less than 4 GB")
    rows = max(1, min(height, 2**20 // max(1, width * kind.itemsize)))
    strips = [(b * height + y) * width * kind.itemsize for b in range(bands) for y in range(0, height, rows)]
    sizes = [min(rows, height - y) * width * kind.itemsize for _ in range(bands) for y in range(0, height, rows)]
    entries: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (kind.itemsize * 8,) * bands), (COMPRESSION, 3, (1,)), (PHOTOMETRIC, 3, (1,)), (STRIP_OFFSETS, 4, tuple(strips)),
        (SAMPLES, 3, (bands,)), (ROWS_PER_STRIP, 4, (rows,)), (STRIP_BYTES, 4, tuple(sizes)), (PLANAR, 3, (2,)), (SAMPLE_FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands),
    ]
    if gt:
        entries += [(SCALE, 12, (gt[1], -gt[5], 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, gt[0], gt[3], 0.0))]
    if crs:
        entries.append((GEO_KEYS, 3, _geo_keys(crs)))
    if nodata is not None:
        entries.append((NODATA, 2, f"{nodata:g}\0".encode()))
    packed = {tag: v if isinstance(v, bytes) else struct.pack("<" + TYPES[k] * len(v), *v) for tag, k, v in entries}
    start = 8 + 2 + 12 * len(entries) + 4 + sum(len(x) for x in packed.values() if len(x) > 4)
    packed[STRIP_OFFSETS] = struct.pack("<" + "I" * len(strips), *[start + x for x in strips])
    head, tail = b"", b""
    for tag, k, v in sorted(entries):
        raw = packed[tag]
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, k, len(v), 8 + 2 + 12 * len(entries) + 4 + len(tail))
            tail += raw
    with open(f"{path}.part", "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + head + b"\0" * 4 + tail)
        f.truncate(start + bands * height * width * kind.itemsize)
    if nodata:
        np.memmap(f"{path}.part", kind, "r+", start, (bands, height, width))[:] = nodata
    os.replace(f"{path}.part", path)


def write_window(path: str, band: int, y0: int, x0: int, block: np.ndarray) -> None:
    """A window of one band (from 1) into a file of `create_empty`. Windows that don't overlap may be written at the same time."""
    with open(path, "rb") as f:
        raw = f.read(2**20)
    order, t = _tags(raw)
    w, h, samples = t[WIDTH][0], t[HEIGHT][0], t[SAMPLES][0]
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[t[SAMPLE_FORMAT][0]] + str(t[BITS][0] // 8))
    if t[COMPRESSION][0] != 1 or t.get(PLANAR, (1,))[0] != 2:
        raise ValueError("windows go into files of create_empty")
    if not (1 <= band <= samples and 0 <= y0 and y0 + block.shape[0] <= h and 0 <= x0 and x0 + block.shape[1] <= w):
        raise ValueError("the window isn't within the file")
    np.memmap(path, kind, "r+", t[STRIP_OFFSETS][0], (samples, h, w))[band - 1, y0 : y0 + block.shape[0], x0 : x0 + block.shape[1]] = _fitted(block, kind)


def _fitted(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    return np.clip(np.rint(values), np.iinfo(kind).min, np.iinfo(kind).max).astype(kind) if kind.kind in "ui" else values.astype(kind)


def write_windows(blocks: DataFrame, path: str, dtype: str = "uint8", nodata: float = 0.0) -> int:
    """Writes (band, y0, x0, h, w, data) blocks into a file of `create_empty`, each from the task that holds it; null samples become nodata. The number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for r in b.to_pylist():
                write_window(path, r["band"], r["y0"], r["x0"], np.array([nodata if v is None else v for v in r["data"]], float).reshape(r["h"], r["w"]))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return blocks.select("band", "y0", "x0", "h", "w", "data").mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.paths = options.get("path"), options.get("paths")

    def partitions(self):
        if self.paths is not None:
            return [InputPartition(p) for p in self.paths.split("\n") if p] or [InputPartition("")]
        p = Path(self.path)
        return [InputPartition(str(f)) for f in ([p] if p.is_file() else sorted([*p.rglob("*.tif"), *p.rglob("*.tiff")]))] or [InputPartition("")]

    def read(self, partition):
        if partition.value:
            for band, y0, x0, block, gt in read_blocks(Path(partition.value).read_bytes()):
                yield partition.value, band, y0, x0, block.shape[0], block.shape[1], block.astype(float).ravel().tolist(), [float(g) for g in gt]


class _Writer(DataSourceWriter):
    """All blocks of a `file` must be in one partition: repartition("file") before writing (or `write_windows`, which needs no such thing). An existing file is left alone.

    Options: dtype, nodata (the value that null samples and pixels without a block get, and the file's no-data tag; without it NaN for floats, 0 for integers, no tag), crs (an EPSG code)."""

    def __init__(self, schema, options):
        self.names, self.path, self.kind = schema.fieldNames(), options["path"], options.get("dtype", "float32")
        self.nodata, self.crs = (float(options["nodata"]) if "nodata" in options else None), (int(options["crs"]) if "crs" in options else None)

    def write(self, rows):
        files: dict[str, list[dict]] = {}
        for r in rows:
            d = dict(zip(self.names, r, strict=True))
            files.setdefault(d["file"], []).append(d)
        os.makedirs(self.path, exist_ok=True)
        for name, blocks in files.items():
            to = os.path.join(self.path, name)
            if os.path.exists(to):
                continue
            bands = sorted({d["band"] for d in blocks})
            kind = np.dtype(self.kind)
            empty = self.nodata if self.nodata is not None else np.nan if kind.kind == "f" else 0.0
            out = np.full((len(bands), max(d["y0"] + d["h"] for d in blocks), max(d["x0"] + d["w"] for d in blocks)), empty)
            for d in blocks:
                data = np.array([empty if v is None else v for v in d["data"]]).reshape(d["h"], d["w"])
                out[bands.index(d["band"]), d["y0"] : d["y0"] + d["h"], d["x0"] : d["x0"] + d["w"]] = data
            write_tiff(f"{to}.part", _fitted(out, kind), blocks[0].get("gt"), self.nodata, crs=self.crs)
            os.replace(f"{to}.part", to)
        return WriterCommitMessage()

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class RasterSource(DataSource):
    @classmethod
    def name(cls):
        return "raster"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options)


def register(spark) -> None:
    spark.dataSource.register(RasterSource)


def sanity(spark, path: str):
    """(path, ok, message) for every TIFF below path: the first band is read."""
    from pyspark.sql import functions as F

    @F.udf("struct<ok boolean, message string>")
    def look(raw):
        try:
            next(read_blocks(bytes(raw)))
            return True, None
        except Exception as e:  # noqa: BLE001
            return False, str(e)[:200]

    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path)
    return d.select("path", look("content").alias("r")).select("path", "r.ok", "r.message")
