"""Distance joins and customers over crowds of rows at one point, against every pair."""

import random

from pyspark.sql import functions as F

from acrelane.functions.geo import geodesic_miles
from acrelane.operators import grid, parcels


def crowds(spark):
    """Parcels and facilities, 150 of each at one point and some more at a few others; some have none."""
    rng = random.Random(3)
    spots = [(-98.0, 38.5), (-98.1, 38.55), (-97.9, 38.4), (-98.147, 38.5), (None, 38.0), (-0.0, 0.0)]
    near = lambda i: spots[0] if i < 150 else (round(-98 + rng.uniform(-0.4, 0.4), 3), round(38.5 + rng.uniform(-0.4, 0.4), 3)) if i < 250 else spots[i % 6]
    own = [(i, *near(i), f"Owner {i % 7}" if i % 11 else " ", None if i % 5 else f"{i} St", f"Town {i % 3}", "KS", "67001", "Agricultural Use" if i % 2 else "Other", i % 40 / 8) for i in range(300)]
    stops = [(i, f"Stop {i % 60}", i % 3, *near(i), "ACTIVE" if i % 9 else "INACTIVE", 1 + (i % 13 == 0)) for i in range(300)]
    p = spark.createDataFrame(own, "id long, lon double, lat double, owner string, mailadd string, mail_city string, mail_state2 string, mail_zip string, usedesc string, ll_gisacre double")
    f = spark.createDataFrame(stops, "facility_id long, name string, company_id long, lon double, lat double, status string, facility_type_id int")
    return p.withColumn("ll_gisacre", F.col("ll_gisacre").cast("decimal(12,3)")), f


def rows(df):
    return sorted(map(str, df.select(*[F.round(c, 9).alias(c) if kind == "double" else c for c, kind in sorted(df.dtypes)]).collect()))


def test_pairs_of_crowds(spark):
    p, f = crowds(spark)
    stops = parcels.grain_facilities(f, [0, 2])
    every = p.filter("lon is not null").crossJoin(stops.filter("facility_lon is not null")).withColumn("miles", geodesic_miles("lon", "lat", "facility_lon", "facility_lat"))
    for miles in (0.0, 8.0, 30.0):
        got = grid.within_distance(p, stops, miles)
        assert got.columns == [*p.columns, *stops.columns, "miles"]
        assert rows(got) == rows(every.filter(F.col("miles") <= miles))
    met = grid.candidate_pairs(p.withColumnRenamed("id", "field_id"), stops, 8.0)
    want = {(r["id"], r["facility_id"]) for r in every.filter("miles <= 8").collect()}
    got = [(r["field_id"], r["facility_id"], r["status"]) for r in met.collect()]
    alone = {r["id"] for r in p.collect()} - {i for i, _ in want}
    assert sorted(got, key=str) == sorted([(*x, None) for x in want] + [(i, None, "no_facility_within_prefilter_miles") for i in alone], key=str) and alone


def test_the_formula_is_not_in_the_join(spark):
    p, f = crowds(spark)
    plan = grid.within_distance(p, parcels.grain_facilities(f), 8.0)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("ASIN" in line or "ATAN" in line for line in joins)


def test_customers_are_those_of_all_pairs(spark):
    p, f = crowds(spark)
    pairs = parcels.facility_parcels(p, f)
    for ag in (False, True):
        got = parcels.facility_customers(p, f, ag=ag)
        want = parcels.customers(pairs, ag=ag)
        as_told = [F.col("acres").cast("double").alias("acres")]
        assert rows(got.select(*[c for c in got.columns if c != "acres"], *as_told)) == rows(want.select(*[c for c in want.columns if c != "acres"], *as_told))
        assert got.columns == want.columns and got.filter("n_parcels > 5").count()
