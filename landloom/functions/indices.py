"""Spectral indices as column expressions over digital numbers, by composite band label.

Fixed values: labels 1 red, 2 green, 3 blue, 4 near infrared, 5 red edge, 9 and 10 short-wave infrared; scale 10000; a tiny term keeps
denominators from zero. Null bands give null. `INDICES` is the registry by name: register your own builder under a new name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10000.0
TINY = 1e-40
EVI2_GAIN = 2.4
SAVI_L = 0.5
Bands = Mapping[int, Column]


def scaled(bands: Mapping[int, Column]) -> dict[int, Column]:
    return {k: v.cast("double") / F.lit(SCALE) for k, v in bands.items()}


def ratio(a: Column, b: Column) -> Column:
    """Normalised difference."""
    return (a - b) / (a + b + F.lit(TINY))


def _pair(p: int, q: int) -> Callable[[Bands], Column]:
    def build(dn: Bands) -> Column:
        b = scaled({p: dn[p], q: dn[q]})
        return ratio(b[p], b[q])

    return build


def evi2(dn: Bands) -> Column:
    b = scaled({k: dn[k] for k in (1, 4)})
    return F.lit(EVI2_GAIN) * (b[4] - b[1]) / (b[4] + b[1] + F.lit(1.0) + F.lit(TINY))


def gli(dn: Bands) -> Column:
    b = scaled({k: dn[k] for k in (1, 2, 3)})
    g = F.lit(2.0) * b[2]
    return (g - b[1] - b[3]) / (g + b[1] + b[3] + F.lit(TINY))


def savi(dn: Bands, soil: float = SAVI_L) -> Column:
    b = scaled({k: dn[k] for k in (1, 4)})
    return (b[4] - b[1]) / (b[4] + b[1] + F.lit(soil) + F.lit(TINY)) * F.lit(1.0 + soil)


def ndli(dn: Bands) -> Column:
    """On raw numbers, clipped from below."""
    a, b = (F.ln(F.greatest(dn[k].cast("double"), F.lit(TINY))) for k in (10, 9))
    return (a - b) / (a + b + F.lit(TINY))


def bsi(dn: Bands) -> Column:
    b = scaled({k: dn[k] for k in (1, 3, 4, 9)})
    soil, leaf = b[9] + b[1], b[4] + b[3]
    return (soil - leaf) / (soil + leaf + F.lit(TINY))


def csi(dn: Bands) -> Column:
    """Mean of near and short-wave infrared, on raw numbers."""
    return (dn[4] + dn[9]) / F.lit(2.0)


INDICES: dict[str, Callable[[Bands], Column]] = {
    "ndvi": _pair(4, 1), "gndvi": _pair(4, 2), "ndvi705": _pair(4, 5), "ndyi": _pair(2, 3), "evi2": evi2, "gli": gli, "savi": savi, "ndmi": _pair(4, 9),
    "ndli": ndli, "ndwi": _pair(2, 4), "ndbi": _pair(9, 4), "ndsi": _pair(2, 9), "bsi": bsi, "csi": csi,
}


def ndvi_clipped(nir: Column, red: Column, cloudy: Column | None = None, tiny: float = 1e-6) -> Column:
    """The older form: clipped to -1..1, exact zero and cloud are missing."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (nir.cast("double") - red) / (nir + red + F.lit(tiny))))
    v = F.when(v != 0, v)
    return v if cloudy is None else F.when(~cloudy, v)


def display(dn: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dn.cast("double") / F.lit(SCALE)))
