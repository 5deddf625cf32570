"""Scalar column functions: sensor codes, seasons, quantisation, names, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene classification codes.
SCL_CLOUD = (8, 9, 10)
SCL_SHADOW = (3,)
QA_FILL, QA_CLOUD, QA_SHADOW, QA_SNOW = 1, 2, 3, 4  # classes of qa_class


def dn_offset(dn: Column, offset: Column | int) -> Column:
    """Removes a (negative) radiometric offset; numbers below it become 0. Values stay within 0..65535."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    return F.least(F.lit(65535), F.greatest(dn, -off) + off)


def scl_mask(scl: Column, codes: tuple[int, ...]) -> Column:
    return scl.isin(*codes)


def qa_class(qa: Column) -> Column:
    """Landsat pixel quality bits to 1 fill, 2 cloud, 3 shadow, 4 snow, 0 clear. Fill wins over cloud over shadow over snow.

    Fixed values: bit 0 fill; 1 dilated cloud, 3 cloud, 14-15 cirrus confidence high; 4 shadow, 10-11 shadow confidence high; 5 snow.
    """
    bit = lambda k: F.shiftright(qa, k).bitwiseAND(F.lit(1)) == 1
    return F.when(bit(0), 1).when(bit(1) | bit(3) | (bit(14) & bit(15)), 2).when(bit(4) | (bit(10) & bit(11)), 3).when(bit(5), 4).otherwise(0)


def season_id(tile: Column, ts: Column) -> Column:
    """Calendar quarter: tile, year, '_', quarter."""
    return F.concat(tile, F.year(ts).cast("string"), F.lit("_"), F.quarter(ts).cast("string"))


def met_season(ts: Column) -> Column:
    """DJF, MAM, JJA or SON with the date's own year."""
    m = F.month(ts)
    name = F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isin(9, 10, 11), "SON")
    return F.concat(name, F.lit(" "), F.year(ts).cast("string"))


def season_number(ts: Column) -> Column:
    """1 for December to February, 2 for March to May, and so on."""
    return F.floor((F.month(ts) % 12 + 3) / 3).cast("int")


def quantise(p: Column) -> Column:
    """Probability to 0..255, towards zero."""
    return (p * 255).cast("int")


def quantise_old(p: Column) -> Column:
    """Probability to 1..255, half to even."""
    return F.rint(p * 254 + 1).cast("int")


def degree_to_sin(a: Column) -> Column:
    return F.sin(F.radians(a))


def degree_to_cos(a: Column) -> Column:
    return F.cos(F.radians(a))


def composite_name(name: Column) -> dict[str, Column]:
    """`<prefix>_T<tile><year>_<month>.tif`: the tile follows one leading character."""
    part = F.split(name, "_")[1]
    tile = F.substring(part, 2, 1000)
    return {
        "tile": F.regexp_extract(tile, r"^(.*)....$", 1),
        "year": F.regexp_extract(part, r"(....)$", 1),
        "month": F.regexp_extract(name, r"_([^_]*)\.[^.]*$", 1),
    }


def month_start(year: Column, month: Column) -> Column:
    return F.try_to_timestamp(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")


def scene_name(name: Column) -> dict[str, Column]:
    """Sentinel-2 product names: sensor, day of acquisition, tile, and the name without the sensor."""
    return {"sensor": F.substring(name, 1, 3), "day": F.regexp_extract(name, r"(\d{8})", 1), "tile": F.substring(name, 40, 5), "product": F.substring(name, 5, 10000)}


def dem_name(name: Column) -> dict[str, Column]:
    return {"tile": F.substring(name, 1, 5), "year": F.substring(name, 28, 4)}


def layer_name(name: Column) -> Column:
    """Feature files of one prefix belong to one layer."""
    return F.split(name, "_")[0]


def numeric_suffix_key(name: Column) -> Column:
    """Sort key of file names that end in `_<month>.<ext>`."""
    return F.concat(F.regexp_extract(name, r"^(.*_)[^_]*$", 1), F.lpad(F.regexp_extract(name, r"_([0-9]+)\.[^.]*$", 1), 2, "0"))


def point_to_pixel(x: Column, y: Column, ox: float, oy: float, rx: float, ry: float) -> tuple[Column, Column]:
    """Column and row by the inverse affine map, half to even; ry counts downwards."""
    return F.rint((x - F.lit(ox)) / F.lit(rx)).cast("int"), F.rint((y - F.lit(oy)) / F.lit(-abs(ry))).cast("int")


def point_to_pixel_floor(x: Column, y: Column, ox: float, oy: float, rx: float, ry: float) -> tuple[Column, Column]:
    return F.floor((x - F.lit(ox)) / F.lit(rx)).cast("int"), F.floor((y - F.lit(oy)) / F.lit(-abs(ry))).cast("int")


def pixel_to_point(col: Column, row: Column, gt: Column) -> tuple[Column, Column]:
    """Map coordinates of a pixel's centre by a six-number geotransform."""
    c, r = col + F.lit(0.5), row + F.lit(0.5)
    return gt[0] + c * gt[1] + r * gt[2], gt[3] + c * gt[4] + r * gt[5]


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """WGS84 degrees to UTM metres by Krueger's series to the third order (below a millimetre within a zone)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k0, e = 0.9996, 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6.0 - 183.0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + F.lit(c) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(c) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return F.lit(500000.0) + F.lit(k0 * big) * east, F.lit(10000000.0 if south else 0.0) + F.lit(k0 * big) * north


def inverse_utm(e: Column, n_: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """UTM metres to WGS84 degrees (longitude, latitude)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi0, eta0 = (n_ - F.lit(10000000.0 if south else 0.0)) / F.lit(0.9996 * big), (e - F.lit(500000.0)) / F.lit(0.9996 * big)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - F.lit(c) * F.sin(xi0 * (2 * j)) * F.cosh(eta0 * (2 * j))
        eta = eta - F.lit(c) * F.cos(xi0 * (2 * j)) * F.sinh(eta0 * (2 * j))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, c in enumerate(delta, 1):
        phi = phi + F.lit(c) * F.sin(chi * (2 * j))
    return F.lit(zone * 6.0 - 183.0) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


WEB_RADIUS = 6378137.0  # fixed value: the sphere of EPSG:3857


def _utm_zone(epsg: int) -> tuple[int, bool] | None:
    zone = epsg % 100
    return (zone, epsg // 100 == 327) if epsg // 100 in (326, 327) and 1 <= zone <= 60 else None


def to_degrees(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Map coordinates to WGS84 longitude and latitude. EPSG 4326, 3857, and every UTM zone (32601 to 32660, 32701 to 32760); others are an error."""
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return F.degrees(x / F.lit(WEB_RADIUS)), F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(WEB_RADIUS)))) - F.lit(90.0)
    if (zone := _utm_zone(epsg)) is None:
        raise ValueError(f"EPSG:{epsg} is not known here")
    return inverse_utm(x, y, *zone)


def from_degrees(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return F.radians(lon) * F.lit(WEB_RADIUS), F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * F.lit(WEB_RADIUS)
    if (zone := _utm_zone(epsg)) is None:
        raise ValueError(f"EPSG:{epsg} is not known here")
    return utm(lon, lat, *zone)


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one EPSG code in another, by way of degrees."""
    return (x, y) if source == target else from_degrees(*to_degrees(x, y, source), target)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone that a place is in."""
    return F.when(lat < 0, F.lit(32700)).otherwise(F.lit(32600)) + F.least(F.lit(60), F.floor((lon + 180.0) / 6.0).cast("int") + 1)
