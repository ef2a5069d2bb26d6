"""Coordinates that a text states, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: degrees with a hemisphere, and degrees, minutes and seconds
DECIMAL = r"(\d{1,3}(?:\.\d+)?)[ ]{0,3}°?[ ]{0,3}([NSns])[ ,]{1,3}(\d{1,3}(?:\.\d+)?)[ ]{0,3}°?[ ]{0,3}([EWew])"
SEXAGESIMAL = r"(\d{1,3})[ ]{0,2}°[ ]{0,2}(\d{1,2})[ ]{0,2}['′][ ]{0,2}([\d.]+)?[ ]{0,2}[\"″]?[ ]{0,2}([NSns])[ ,]{1,3}(\d{1,3})[ ]{0,2}°[ ]{0,2}(\d{1,2})[ ]{0,2}['′][ ]{0,2}([\d.]+)?[ ]{0,2}[\"″]?[ ]{0,2}([EWew])"
#: A grid reference: zone, band, two letters of a square of 100 km, and as many digits of easting as of northing.
GRID = r"\b\d{1,2}[C-HJ-NP-X][A-HJ-NP-Z]{2}(?:\d{2}){1,5}\b"
#: Words near which numbers may be a place, and how near (fixed values).
CONTEXT, NEAR = ("grid", "coord", "coordinate", "coordinates", "mgrs", "utm", "position", "located", "location", "lat", "lon", "long", "latitude", "longitude", "geo", "geolocat"), 45

# The ellipsoid of WGS 84 and the series of the transverse Mercator projection (Krüger), to the fourth order in its third flattening.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_E = math.sqrt(_F * (2 - _F))
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)
_BANDS, _ROWS, _COLUMNS = "CDEFGHJKLMNPQRSTUVWX", "ABCDEFGHJKLMNPQRSTUV", "ABCDEFGHJKLMNPQRSTUVWXYZ"


def _northing(lat: float) -> float:
    """Of a latitude on a zone's middle meridian, from 10,000 km south of the equator for the south."""
    phi = math.radians(lat)
    chi = math.atan(math.sinh(math.asinh(math.tan(phi)) - _E * math.atanh(_E * math.sin(phi))))
    return _K0 * _RADIUS * (chi + sum(a * math.sin(2 * (j + 1) * chi) for j, a in enumerate(_ALPHA))) + (10_000_000 if lat < 0 else 0)


def _let(value: Column, use) -> Column:
    """use(value), in which value is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grid_place(raw: Column) -> Column:
    """(lat, lng) of the middle of a grid reference's square; null if its letters name no square of its zone.

    The square's row comes back every 2,000 km; it is the first one that isn't
    below the band. Latitude and longitude are the projection's inverse series.
    """
    zone = F.regexp_extract(raw, r"^(\d{1,2})", 1).cast("int")
    letters, digits = F.regexp_extract(raw, r"^\d{1,2}([A-Z]{3})", 1), F.regexp_extract(raw, r"[A-Z](\d+)$", 1)
    start = F.struct(zone.alias("zone"), F.instr(F.lit(_BANDS), F.substring(letters, 1, 1)).alias("band"), F.instr(F.lit(_COLUMNS), F.substring(letters, 2, 1)).alias("column"), F.instr(F.lit(_ROWS), F.substring(letters, 3, 1)).alias("row"), digits.alias("digits"), (F.length(digits) / 2).cast("int").alias("half"))

    def metres(v: Column) -> Column:
        size = F.pow(F.lit(10.0), F.lit(5) - v["half"])  # of the square
        column = v["column"] - 8 * F.pmod(v["zone"] - 1, F.lit(3))  # 1 to 8 in the zone's own letters
        row = F.pmod(v["row"] - 1 - F.when(v["zone"] % 2 == 0, 5).otherwise(0), F.lit(20))
        east = column * 100_000 + F.substring(v["digits"], F.lit(1), v["half"]).cast("double") * size
        north = row * 100_000 + F.substring(v["digits"], v["half"] + 1, v["half"]).cast("double") * size
        bottom = F.element_at(F.array(*[F.lit(math.floor(_northing(-80 + 8 * i) / 100_000) * 100_000.0) for i in range(20)]), v["band"])
        north = north + F.greatest(F.lit(0.0), F.ceil((bottom - north) / 2_000_000.0).cast("double")) * 2_000_000.0
        ok = v["zone"].between(1, 60) & column.between(1, 8) & (v["row"] > 0) & (v["band"] > 0)
        return F.when(ok, F.struct(((east + size / 2 - 500_000) / (_K0 * _RADIUS)).alias("x"), ((north + size / 2 - F.when(v["band"] <= 10, 10_000_000).otherwise(0)) / (_K0 * _RADIUS)).alias("y"), v["zone"].alias("zone")))

    def unbent(v: Column) -> Column:
        y = v["y"] - sum((F.sin(2 * j * v["y"]) * F.cosh(2 * j * v["x"]) * b for j, b in enumerate(_BETA, 1)), F.lit(0.0))
        x = v["x"] - sum((F.cos(2 * j * v["y"]) * F.sinh(2 * j * v["x"]) * b for j, b in enumerate(_BETA, 1)), F.lit(0.0))
        return F.when(v.isNotNull(), F.struct(x.alias("x"), y.alias("y"), v["zone"].alias("zone")))

    def place(v: Column) -> Column:
        chi = F.asin(F.sin(v["y"]) / F.cosh(v["x"]))
        lat = _let(chi, lambda c: c + sum((F.sin(2 * j * c) * d for j, d in enumerate(_DELTA, 1)), F.lit(0.0)))
        return F.when(v.isNotNull(), F.struct(F.degrees(lat).alias("lat"), (v["zone"] * 6 - 183 + F.degrees(F.atan2(F.sinh(v["x"]), F.cos(v["y"])))).alias("lng")))

    return _let(_let(_let(start, metres), unbent), place)


def _in_context(pattern: str) -> str:
    """pattern where one of CONTEXT begins at most NEAR characters before it, or ends at most as many after it."""
    after = "|".join(rf"(?s:.){{0,{NEAR - len(w)}}}\b{w}" for w in CONTEXT)
    return rf"(?:(?<=(?=\b(?i:{'|'.join(CONTEXT)}))(?s:.){{0,{NEAR}}}){pattern}|{pattern}(?=(?i:{after})))"


def coordinates(text: Column) -> Column:
    """An array of (raw, lat, lng, format): grid references, degrees with minutes, and decimal degrees with a hemisphere, each spelling once, those out of range left out.

    Grid references count near a word of CONTEXT alone, as part numbers look
    like them; and so do decimal degrees without a degree sign or a fraction,
    as sizes do.
    """

    def part(raw: Column, pattern: str, group: int) -> Column:
        return F.coalesce(F.regexp_extract(raw, pattern, group).try_cast("double"), F.lit(0.0))

    def sign(raw: Column, pattern: str, group: int) -> Column:
        return F.when(F.lower(F.regexp_extract(raw, pattern, group)).isin("s", "w"), -1.0).otherwise(1.0)

    def decimal(raw: Column) -> Column:
        return F.struct(raw.alias("raw"), (part(raw, DECIMAL, 1) * sign(raw, DECIMAL, 2)).alias("lat"), (part(raw, DECIMAL, 3) * sign(raw, DECIMAL, 4)).alias("lng"), F.lit("decimal").alias("format"))

    def sexagesimal(raw: Column) -> Column:
        half = lambda g: (part(raw, SEXAGESIMAL, g) + part(raw, SEXAGESIMAL, g + 1) / 60 + part(raw, SEXAGESIMAL, g + 2) / 3600) * sign(raw, SEXAGESIMAL, g + 3)
        return F.struct(raw.alias("raw"), half(1).alias("lat"), half(5).alias("lng"), F.lit("dms").alias("format"))

    spelt = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
    grid = lambda raw: _let(grid_place(raw), lambda p: F.struct(raw.alias("raw"), p["lat"].alias("lat"), p["lng"].alias("lng"), F.lit("mgrs").alias("format")))
    signed = F.filter(spelt(DECIMAL), lambda x: F.contains(x, F.lit("°")) | F.contains(x, F.lit(".")))
    plain = F.array_distinct(F.concat(signed, spelt(_in_context(DECIMAL))))
    every = F.concat(F.transform(spelt(_in_context(GRID)), grid), F.transform(spelt(SEXAGESIMAL), sexagesimal), F.transform(plain, decimal))
    return F.filter(every, lambda c: c["lat"].between(-90, 90) & c["lng"].between(-180, 180))
