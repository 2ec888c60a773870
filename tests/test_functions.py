"""Golden pairs of text, keys and geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from acrelane.functions import geo, survey, text
from acrelane.operators import grid, parcels, routing


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v).cast("string") if v is None or isinstance(v, str) else F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [(" two   bins ", "two bins"), ("dry\r\n\tcorn", "dry corn"), (" \n", None), (None, None)])
def test_norm_text(spark, value, want):
    assert one(spark, text.norm_text(F.col("v")), v=value) == want


@pytest.mark.parametrize("value, want", [("77  c.r. 9 N", "77 County Road. 9 N"), ("C.R.10", "County Road10"), ("7 Co.Rd.9", "7 County Road9"), ("5 County  rd 12", "5 County Road 12"), ("4 Co Rd 812", "4 County Road 812"), ("Cty. Rd K", "County Road K"), ("1 county  road 3", "1 county road 3"), ("Unknown", ""), (" - ", ""), (None, "")])
def test_street(spark, value, want):
    assert one(spark, text.clean_street(F.col("v")), v=value) == want


@pytest.mark.parametrize("value, want", [("Prairie Grain, L.L.C.", "prairie grain"), ("Corporation of Plains Co.", "of plains"), ("Hill & Dale Incorporated", "hill & dale"), ("Limited Feeds Ltd.", "limited feeds"), ("Ström-Mühle", "ström-mühle"), (" ", ""), (None, "")])
def test_company(spark, value, want):
    assert one(spark, text.norm_company(F.col("v")), v=value) == want


@pytest.mark.parametrize("value, want", [("http:/x.com", "https://x.com"), ("http:///x.com", "http:///x.com"), ("https:/", "https://"), (" www.x.com ", "https://www.x.com"), ("http://x.com/a", "http://x.com/a"), ("x.com/a", "https://x.com/a"), ("HTTPS://x.com", "https://HTTPS://x.com"), (" ", None)])
def test_url(spark, value, want):
    assert one(spark, text.normalize_url(F.col("v")), v=value) == want


@pytest.mark.parametrize("value, want", [("http://x.com", ("https://x.com", "")), ("https://x.com/", ("https://x.com", "/")), ("http://x.com/a?b", ("https://x.com", "/a?b")), ("www.x.com/a", ("https://www.x.com/a", None)), ("x.com/a/", ("https://x.com/a/", None)), ("HTTP://x.com/a", ("https://HTTP://x.com/a", None)), (" ", None), (None, None)])
def test_site(spark, value, want):
    got = one(spark, text.split_site(F.col("v")), v=value)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("values, want", [(["a", "b"], "a\n\n---\n\nb"), (["a", None], "a"), (["a", "a"], "a"), ([None, None], None), (["Long text", "long"], "Long text"), (["x", "an X here"], "an X here"), (["Two  words", "two words"], "two words"), (["  a \n b "], "a b")])
def test_text_fold(spark, values, want):
    df = spark.createDataFrame([(values,)], "v array<string>")
    assert df.select(text.text_fold(F.col("v")).alias("x")).first()["x"] == want


def test_longest(spark):
    df = spark.createDataFrame([(["East bin", "Elevator at the crossing", "Mill"],)], "v array<string>")
    assert df.select(text.longest(F.col("v")).alias("x")).first()["x"] == "Elevator at the crossing"


def test_survey_keys(spark):
    df = spark.createDataFrame([("T10S-R10E",), ("S22-T4S-R37W",), ("05S19E02SENW",), ("x",), (None,)], "label string")
    assert [r["township_key"] for r in survey.parse_township(df).collect()] == ["T10S R10E"]
    assert [r["plss_key"] for r in survey.parse_section(df).collect()] == ["S22 T4S R37W"]
    got = survey.parse_quarter(df).first()
    assert (got["quarter"], got["sixteenth"], got["section_key"]) == ("SE", "NW", "S2 T05S R19E")


def vincenty(lon1, lat1, lon2, lat2):
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    dl = lam = math.radians(lon2 - lon1)
    for _ in range(100):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma, sa = math.atan2(s, c), math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        c2 = 1 - sa * sa
        cm = c - 2 * math.sin(u1) * math.sin(u2) / c2 if c2 else 0
        k = f / 16 * c2 * (4 + f * (4 - 3 * c2))
        old, lam = lam, dl + (1 - k) * f * sa * (sigma + k * s * (cm + k * c * (2 * cm * cm - 1)))
        if abs(lam - old) < 1e-13:
            break
    us = c2 * (a * a - b * b) / (b * b)
    big = 1 + us / 16384 * (4096 + us * (us * (320 - 175 * us) - 768))
    small = us / 1024 * (256 + us * (us * (74 - 47 * us) - 128))
    ds = small * s * (cm + small / 4 * (c * (2 * cm * cm - 1)))
    return b * big * (sigma - ds)


def test_geodesic_is_close_to_vincenty(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-102, -95), rng.uniform(37, 40), rng.uniform(-0.9, 0.9), rng.uniform(-0.7, 0.7)) for _ in range(300)] + [(-98.0, 38.0, 0.0, 0.0)]
    df = spark.createDataFrame([(x, y, x + a, y + b) for x, y, a, b in points], "a double, b double, c double, d double")
    for r in df.withColumn("m", geo.geodesic_miles("a", "b", "c", "d")).collect():
        assert abs(r["m"] * 1609.344 - vincenty(r["a"], r["b"], r["c"], r["d"])) < 0.3


def test_geodesic_nearest_is_brute_force(spark):
    rng = random.Random(2)
    sites = [(i, rng.uniform(-102, -95), rng.uniform(37, 40)) for i in range(60)]
    stops = [(i, rng.choice([-98.0, rng.uniform(-102, -95)]), rng.choice([38.5, rng.uniform(37, 40)])) for i in range(25)]
    s = spark.createDataFrame([*sites, (99, None, 38.0)], "site long, lon double, lat double")
    f = spark.createDataFrame(stops, "stop long, facility_lon double, facility_lat double")
    for metric in ("planar", "geodesic"):
        got = {r["site"]: r["stop"] for r in grid.nearest(s, f, "site", "stop", metric=metric).collect()}
        for i, x, y in sites:
            far = (lambda p: (p[1] - x) ** 2 + (p[2] - y) ** 2) if metric == "planar" else (lambda p: vincenty(x, y, p[1], p[2]))
            assert got[i] == min(stops, key=lambda p: (round(far(p), 9), p[0]))[0]
    assert grid.nearest(s, f.limit(0), "site", "stop").count() == 0


def test_edge_speed_rules(spark):
    rows = [(["x", "Primary "], ["gravel"]), (["x"], ["earth"]), ([], ["Compacted"]), (None, None), (["y"], ["asphalt", "gravel", "dirt"]), (["living_street", "motorway"], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, highway array<string>, surface array<string>").withColumn("length_m", F.lit(1609.344))
    own = routing.SPEEDS | {"dirt_road": 22.0, "gravel_road": 33.0}
    assert [r["mph"] for r in routing.edge_times(df, own).orderBy("i").collect()] == [55.0, 22.0, 33.0, 40.0, 33.0, 25.0]
    assert [r["mph"] for r in routing.edge_times(df).orderBy("i").collect()] == [55.0, 40.0, 40.0, 40.0, 40.0, 25.0]
    with pytest.raises(Exception, match="positive"):
        routing.edge_times(df, {"unknown_road": 0.0}).collect()


def test_filters_check_their_arguments(spark):
    df = spark.createDataFrame([(-1.0, 38.0)], "lon double, lat double")
    for call in (lambda: parcels.bbox_filter(df, 1, 0, 0, 1), lambda: parcels.hash_slice(df, "lon", 0, 0)):
        with pytest.raises(ValueError):
            call()
    assert parcels.latitude_band(df, 3, 8).count() == 1


def test_centroid_is_worked_out_once(spark):
    from acrelane.functions import geo

    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    rows = spark.range(2).select(geo.polygon_centroid(F.array(ring)).alias("c"), geo.polygon_centroid(F.array(F.slice(ring, 1, 2))).alias("none"))
    assert [(r["c"]["lon"], r["c"]["lat"], r["none"]) for r in rows.collect()] == [(1.0, 1.0, None)] * 2
    # two aggregates over rings and points for each column, and no more
    assert rows._jdf.queryExecution().analyzed().toString().count("aggregate(") == 4
