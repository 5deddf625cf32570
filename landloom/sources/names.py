"""File pruning by name and reading of catalogues, before anything is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions.scalars import composite_name, dem_name, month_start, scene_name


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name) of files, by the binary source's listing; contents are never read. Files of zero length are not listed."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    return d.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))


def prune_scenes(files: DataFrame, year: int, tile: str, sensor: str) -> DataFrame:
    n = scene_name(F.col("name"))
    out = files.where(F.substring(n["day"], 1, 4).eqNullSafe(F.lit(str(year))) & n["tile"].eqNullSafe(F.lit(tile)) & F.contains(n["sensor"], F.lit(sensor)))
    return out.withColumns({"acquired": F.try_to_timestamp(n["day"], F.lit("yyyyMMdd")).cast("date"), "tile": n["tile"], "product": n["product"]})


def prune_composites(files: DataFrame, year: str | None = None, tile: str | None = None, month: str | None = None) -> DataFrame:
    """Each filter is optional; months compare as text, as they are written."""
    n = composite_name(F.col("name"))
    d = files.withColumns({"tile": n["tile"], "year": n["year"], "month": n["month"]})
    for c, v in (("year", year), ("tile", tile), ("month", month)):
        if v is not None:
            d = d.where(F.col(c) == str(v))
    return d.withColumn("time", month_start(F.col("year"), F.col("month")))


def prune_dems(files: DataFrame, year: str | None = None, tile: str | None = None) -> DataFrame:
    n = dem_name(F.col("name"))
    d = files.withColumns({"tile": n["tile"], "year": n["year"]})
    for c, v in (("year", year), ("tile", tile)):
        if v is not None:
            d = d.where(F.col(c) == str(v))
    return d


def require(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} match")
    return df


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Product listings saved as JSON (a `value` array per page), without those of zero length."""
    pages = spark.read.schema("value array<struct<Id string, Name string, ContentLength string, ContentDate struct<Start string>>>").option("multiLine", "true").json(path)
    p = pages.select(F.explode("value").alias("v")).select("v.*").where(F.col("ContentLength") != "0")
    return p.select(F.col("Id").alias("id"), F.col("Name").alias("name"), F.col("ContentLength").cast("bigint").alias("bytes"), F.to_timestamp("ContentDate.Start").alias("start"))


def metadata_scrape(lines: DataFrame, tags: dict[str, str], keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Values of XML tags found line by line: (keys, one column per tag), the first hit of each. lines: (keys, value)."""
    return lines.groupBy(*keys).agg(*[F.first(F.nullif(F.regexp_extract("value", rf"<{t}[^>]*>([^<]*)</{t}>", 1), F.lit("")), True).alias(c) for c, t in tags.items()])


def kml_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(tile, ring) from KML placemarks: the first polygon of each."""
    d = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, MultiGeometry struct<Polygon array<struct<outerBoundaryIs struct<LinearRing struct<coordinates string>>>>>, Polygon struct<outerBoundaryIs struct<LinearRing struct<coordinates string>>>").load(path)
    text = F.coalesce(F.get(F.col("MultiGeometry.Polygon"), 0)["outerBoundaryIs"]["LinearRing"]["coordinates"], F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"))
    pairs = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("x"), F.split(p, ",")[1].try_cast("double").alias("y")))
    return d.select(F.trim("name").alias("tile"), pairs.alias("ring"))


def find_files(files: DataFrame, date: str | None = None, tile: str | None = None, kind: str | None = None) -> DataFrame:
    """Files whose names hold a date (yyyymmdd), a tile (T and five characters) and a word such as a mask's kind, each where given; with the date and tile that were read."""
    d = files.withColumns({"file_date": F.try_to_timestamp(F.regexp_extract("name", r"(?:^|[^0-9])(\d{8})(?:[^0-9]|$)", 1), F.lit("yyyyMMdd")).cast("date"), "file_tile": F.nullif(F.regexp_extract("name", r"(?:^|_)T([0-9]{2}[A-Z]{3})(?:[_.0-9]|$)", 1), F.lit(""))})
    if date is not None:
        d = d.where(F.contains("name", F.lit(date)))
    if tile is not None:
        d = d.where(F.col("file_tile") == tile)
    return d if kind is None else d.where(F.contains(F.lower("name"), F.lit(kind.lower())))


def metadata_table(lines: DataFrame, tags: dict[str, str], cloud: str, most: float, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """`metadata_scrape` of the products with a cloud share of at most `most`, the number as a double; ready for `write.csv(header=True)`."""
    return metadata_scrape(lines, tags, keys).withColumn(cloud, F.col(cloud).try_cast("double")).where(F.col(cloud) <= most)


def month_ranges(first: str, last: str) -> list[tuple[str, str]]:
    """The months between two dates (yyyy-mm-dd, the last one not included) as ranges of days, cut at both ends: one catalogue request each."""
    import datetime as dt

    a, z = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    out = []
    while a < z:
        b = min(z, dt.date(a.year + a.month // 12, a.month % 12 + 1, 1))
        out.append((a.isoformat(), b.isoformat()))
        a = b
    return out


def catalogue_filter(collection: str, tile: str, start: str, end: str, product: str = "") -> str:
    """The OData filter of one request, for a client of the user's own: nothing here opens a connection."""
    parts = [f"Collection/Name eq '{collection}'", f"contains(Name,'{tile}')", f"ContentDate/Start ge {start}T00:00:00.000Z", f"ContentDate/Start lt {end}T00:00:00.000Z"]
    return " and ".join([*parts, f"contains(Name,'{product}')"] if product else parts)
