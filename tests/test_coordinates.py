"""Grid references against a projection written otherwise, and the rule of context."""

import math

from pyspark.sql import functions as F

from sleuthgrid.functions import coordinates as c


def project(lat, lng):
    """Zone, easting and northing by the textbook power series in the distance from the middle meridian."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    zone = int((lng + 180) // 6) + 1
    phi, lam = math.radians(lat), math.radians(lng - (zone * 6 - 183))
    n, t, cc, aa = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, ep * math.cos(phi) ** 2, math.cos(phi) * lam
    steps = 20_000  # the meridian's length by Simpson's rule
    g = lambda x: a * (1 - e2) / (1 - e2 * math.sin(x) ** 2) ** 1.5
    h = phi / steps
    m = h / 3 * (g(0) + g(phi) + sum((4 if i % 2 else 2) * g(i * h) for i in range(1, steps)))
    east = k0 * n * (aa + (1 - t + cc) * aa**3 / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep) * aa**5 / 120) + 500_000
    north = k0 * (m + n * math.tan(phi) * (aa**2 / 2 + (5 - t + 9 * cc + 4 * cc * cc) * aa**4 / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep) * aa**6 / 720))
    return zone, east, north + (10_000_000 if lat < 0 else 0)


def name(lat, lng):
    zone, east, north = project(lat, lng)
    column = "ABCDEFGH JKLMNPQR STUVWXYZ".split()[(zone - 1) % 3][int(east // 100_000) - 1]
    row = "ABCDEFGHJKLMNPQRSTUV"[(int(north // 100_000) + (5 if zone % 2 == 0 else 0)) % 20]
    band = "CDEFGHJKLMNPQRSTUVWX"[min(19, int((lat + 80) // 8))]
    return f"{zone}{band}{column}{row}{int(east % 100_000):05d}{int(north % 100_000):05d}"


def test_grid_references_within_a_metre(spark):
    places = [(33.33, 44.39), (-33.86, 151.21), (0.5, 3.1), (-0.5, -78.5), (59.91, 10.75), (-79.5, 0.4), (83.5, 20.2), (21.4, -157.9), (48.86, 2.35), (-54.8, -68.3), (71.9, 179.5), (16.01, -90.2)]
    df = spark.createDataFrame([(name(*p), *p) for p in places], "raw string, lat double, lng double")
    for r in df.select("raw", "lat", "lng", c.grid_place(F.col("raw")).alias("p")).collect():
        assert abs(r["p"]["lat"] - r["lat"]) * 111_000 < 1 and abs(r["p"]["lng"] - r["lng"]) * 111_000 * math.cos(math.radians(r["lat"])) < 1, r


def test_formats_and_context(spark):
    texts = {
        "bolts of 10N 20E size": [],
        "the position is 10N 20E today": [("decimal", 10.0, 20.0)],
        "10N 20E is its Location": [("decimal", 10.0, 20.0)],
        "10N 20E, " + "x" * 60 + " location": [],
        "at 10.5N 20W": [("decimal", 10.5, -20.0)],
        "at 10° S, 20° E": [("decimal", -10.0, 20.0)],
        "part 38SMB4483 of the build": [],
        "grid 38SMB4483 seen": [("mgrs", 33.3, 44.4)],
        "MGRS 61SMB4483 and 38SAB4483": [],
        "34°01'12\"N 118°15'30\"W": [("dms", 34.02, -118.2583)],
        "": [],
        None: [],
    }
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.coordinates(F.col("t")).alias("found")).collect():
        got = [(x["format"], x["lat"], x["lng"]) for x in r["found"] or []]
        want = texts[r["t"]]
        assert len(got) == len(want), r
        for g, w in zip(got, want, strict=True):
            assert g[0] == w[0] and abs(g[1] - w[1]) < 0.05 and abs(g[2] - w[2]) < 0.05, r
