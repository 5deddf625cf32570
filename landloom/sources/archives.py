"""Band files inside scene archives: zip files and unpacked SAFE folders. Members are chosen by a pattern on their names before anything is decoded.

Contents come through Spark's binary source, so archives may lie on any file system Spark reads; a task holds one archive at a time (2 GB at most). There is no JPEG 2000 decoder: such members are
listed, with their names and sizes, but have no blocks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.sources import geotiff

LISTING = "path string, member string, bytes bigint"
BLOCKS = "path string, member string, band int, y0 int, x0 int, h int, w int, data array<double>, gt array<double>, crs int, nodata double"


def archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, content), an archive per task."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").repartition(max(1, len(paths)), "path")


def members(raw: DataFrame, pattern: str = ".*") -> DataFrame:
    """(path, member, bytes) of the members whose names hold a match; a file that is no zip archive has none."""
    look = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i.filename, i.file_size) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in _infos(c) if look.search(i.filename)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "member", "bytes"])

    return raw.mapInArrow(run, LISTING)


def _infos(content: bytes) -> list[zipfile.ZipInfo]:
    try:
        return zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile:
        return []


def band_blocks(raw: DataFrame, pattern: str) -> DataFrame:
    """Blocks of the TIFF members whose names hold a match, with the member they come from."""
    look = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for info in _infos(content):
                    if look.search(info.filename) and info.filename.lower().endswith((".tif", ".tiff")):
                        for part in geotiff.block_batches(path, zipfile.ZipFile(io.BytesIO(content)).read(info)):
                            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([info.filename] * part.num_rows), *part.columns[1:]], [x.split()[0] for x in BLOCKS.split(", ")])

    return raw.mapInArrow(run, BLOCKS)


def safe_members(files: DataFrame, pattern: str) -> DataFrame:
    """(path, name, product, member) of files within unpacked .SAFE folders whose path in the folder holds a match. files: of `names.list_files`."""
    inner = F.regexp_extract("path", r"\.SAFE/(.*)$", 1)
    return files.withColumns({"product": F.regexp_extract("path", r"([^/]*)\.SAFE/", 1), "member": inner}).where((F.col("member") != "") & F.col("member").rlike(pattern))


def band_group(blocks: DataFrame, bands: Sequence[str], name: str = "member") -> DataFrame:
    """blocks with `label`, the band that the member's name gives (`_B02.`, `_SCL_20m.`); others go."""
    label = F.regexp_extract(name, rf"_({'|'.join(bands)})(?:_\d+m)?\.[A-Za-z]+$", 1)
    return blocks.withColumn("label", label).where("label <> ''")
