"""Filters on parcels and facilities, and customers of facilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelane.functions.geo import geodesic_miles
from acrelane.functions.text import usable_street
from acrelane.operators.grid import point_radius, within_distance

#: Boxes (west, south, east, north) that facility candidates are taken from.  Fixed values.
PLAINS_BOX = (-103.5, 36.0, -94.0, 40.5)
STATE_BOX = (-102.4, 36.85, -94.0, 40.3)


def haul_parcel_filter(parcels: DataFrame, min_acres: float | None = None, ag_only: bool = False, exclude: Sequence[str] = (), counties: Sequence[str] | None = None) -> DataFrame:
    """Parcels with a point that pass the given limits; uses and counties are compared trimmed and in lower case, null as ''."""
    keep = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    if ag_only:
        keep &= F.col("usedesc").ilike("Agricultural%")
    if exclude:
        keep &= ~F.lower(F.trim(F.coalesce("usedesc", F.lit("")))).isin(*[x.strip().lower() for x in exclude])
    if min_acres is not None:
        keep &= F.greatest(F.coalesce("gisacre", F.lit(0)), F.coalesce("ll_gisacre", F.lit(0))) >= min_acres
    if counties is not None:
        keep &= F.lower(F.trim("county")).isin(*[x.strip().lower() for x in counties])
    return parcels.filter(keep)


def bbox_filter(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Points in the box, borders included."""
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("the box needs west < east and south < north within the globe")
    return df.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def facility_candidates(facility: DataFrame, facility_type: int = 1, mode: str = "all") -> DataFrame:
    """Active facilities with a point: of one type, and for mode 'plains' or 'state' inside that box."""
    kept = facility.filter((F.col("status") == "ACTIVE") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    if mode == "all":
        return kept
    return bbox_filter(kept.filter(F.col("facility_type_id") == facility_type), *{"plains": PLAINS_BOX, "state": STATE_BOX}[mode])


def ag_use(parcels: DataFrame) -> DataFrame:
    return parcels.filter(F.col("usedesc").isin("Agricultural Use", "Farm Homesite"))


def hash_slice(df: DataFrame, id_col: str, modulus: int, remainder: int) -> DataFrame:
    """Rows whose id leaves the remainder; negative ids too leave one from 0 up."""
    if modulus < 1 or not 0 <= remainder < modulus:
        raise ValueError("need modulus >= 1 and 0 <= remainder < modulus")
    return df.filter(F.pmod(F.col(id_col), F.lit(modulus)) == remainder)


def latitude_band(df: DataFrame, band: int, bands: int, lat: str = "lat") -> DataFrame:
    """Rows of one of equally high stripes of latitude, 0 the southernmost; a single latitude is all of them."""
    span = df.agg(F.min(lat).alias("_lo"), (F.max(lat) - F.min(lat)).alias("_span"))
    no = F.least(F.floor((F.col(lat) - F.col("_lo")) / F.col("_span") * bands), F.lit(bands - 1))
    return df.join(F.broadcast(span)).filter((F.col("_span") == 0) | (F.when(F.col("_span") > 0, no) == band)).drop("_lo", "_span")


def valid_coordinates(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (lon, lat)]
    return df.filter(ok[0] & ok[1])


def facet_search(df: DataFrame, facets: dict | None = None, words: str = "", fields: Sequence[str] = ()) -> DataFrame:
    """Rows with the given values and every word, case ignored, in some of the fields."""
    for name, value in (facets or {}).items():
        df = df.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    for word in words.split():
        some = F.lit(False)
        for f in fields:
            some = some | F.coalesce(F.contains(F.lower(F.col(f).cast("string")), F.lit(word.lower())), F.lit(False))
        df = df.filter(some)
    return df


def membership_filter(df: DataFrame, column: str, values: Sequence, empty: str = "none") -> DataFrame:
    """Rows with a chosen value; no choice gives no rows, or all with empty='all'."""
    if not values:
        return df if empty == "all" else df.filter(F.lit(False))
    return df.filter(F.col(column).isin(*values))


def needs_geocode(facility: DataFrame, mode: str = "default_point", flag: str = "geocoded") -> DataFrame:
    """'default_point': noted as from the member list and still at the default point; 'address': a usable street and not flagged."""
    if mode == "default_point":
        return facility.filter(F.col("notes").like("%KGFA%") & (F.col("lat") == 38.5) & (F.col("lon") == -98.0))
    flagged = F.coalesce(F.col(flag), F.lit(False)) if flag in facility.columns else F.lit(False)
    return facility.filter(usable_street(F.col("address")) & ~flagged)


def within_distance_anchor(parcels: DataFrame, anchor_id: int, miles: float = 8.0, ag: bool = False) -> DataFrame:
    """Parcels within miles of one parcel, itself included; ag: agricultural ones only, with the distance."""
    anchor = parcels.filter((F.col("id") == anchor_id) & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("lon", "lat").first()
    if anchor is None:
        return parcels.filter(F.lit(False)).withColumn("miles", F.lit(0.0)) if ag else parcels.filter(F.lit(False))
    near = point_radius(parcels, anchor["lon"], anchor["lat"], miles)
    return ag_use(near) if ag else near.drop("miles")


def grain_facilities(facility: DataFrame, companies: Sequence[int] | None = None) -> DataFrame:
    """Active grain facilities (type 1), of given companies if any, under the names that distance joins take."""
    own = facility.filter((F.col("status") == "ACTIVE") & (F.col("facility_type_id") == 1))
    if companies is not None:
        own = own.filter(F.col("company_id").isin(*companies))
    return own.select("facility_id", F.col("name").alias("facility_name"), "company_id", F.col("lon").alias("facility_lon"), F.col("lat").alias("facility_lat"))


def facility_parcels(parcels: DataFrame, facility: DataFrame, companies: Sequence[int] | None = None, miles: float = 8.0) -> DataFrame:
    """Parcels within miles of active grain facilities (type 1), of given companies if any, with the distance."""
    return within_distance(parcels, grain_facilities(facility, companies), miles)


_MAIL = ("mailadd", "mail_city", "mail_state2", "mail_zip")


def _with_owner(rows: DataFrame, ag: bool) -> DataFrame:
    rows = rows.filter(F.trim(F.coalesce("owner", F.lit(""))) != "")
    return ag_use(rows) if ag else rows


def _customer_keys(ag: bool) -> list[str]:
    return [*(["facility_id"] if ag else []), "facility_name", "owner"]


def customers(pairs: DataFrame, ag: bool = False) -> DataFrame:
    """Owners near each facility with mail address, acres and number of parcels; ag: agricultural uses only, by facility id too."""
    rows = _with_owner(pairs, ag)
    mail = [F.max(c).alias(c) for c in _MAIL]
    return rows.groupBy(*_customer_keys(ag)).agg(*mail, F.sum(F.coalesce("ll_gisacre", F.lit(0))).alias("acres"), F.count("*").alias("n_parcels"))


def facility_customers(parcels: DataFrame, facility: DataFrame, companies: Sequence[int] | None = None, miles: float = 8.0, ag: bool = False) -> DataFrame:
    """customers() of facility_parcels(), without its pairs: an owner's parcels at a point are added up before they meet facilities, and facilities of one
    name at a point, unless their ids are asked for, meet them as one."""
    mail = [F.max(c).alias(c) for c in _MAIL]
    own = _with_owner(parcels, ag).groupBy("lon", "lat", "owner").agg(*mail, F.sum(F.coalesce("ll_gisacre", F.lit(0))).alias("acres"), F.count("*").alias("n_parcels"))
    keys = _customer_keys(ag)
    places = grain_facilities(facility, companies).groupBy(*keys[:-1], "facility_lon", "facility_lat").agg(F.count("*").alias("_n"))
    pairs = within_distance(own, places, miles)
    return pairs.groupBy(*keys).agg(*mail, F.sum(F.col("acres") * F.col("_n")).alias("acres"), F.sum(F.col("n_parcels") * F.col("_n")).alias("n_parcels"))


def first_n(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows with the least ids (a top-n report)."""
    return df.orderBy(id_col).limit(n)


def haul_count(parcels: DataFrame, slices: int = 1, **limits) -> DataFrame:
    """One row: eligible parcels and their number a slice."""
    n = haul_parcel_filter(parcels, **limits).agg(F.count("*").alias("n_parcels"))
    return n.withColumn("per_slice", F.ceil(F.col("n_parcels") / slices).cast("long"))


def geom_mismatch(df: DataFrame, tolerance: float = 1e-6, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with coordinates whose point is missing or differs, with kind MISSING or MISMATCH."""
    kind = F.when(F.col(x).isNull() | F.col(y).isNull(), "MISSING").when((F.abs(F.col(x) - F.col("lon")) > tolerance) | (F.abs(F.col(y) - F.col("lat")) > tolerance), "MISMATCH")
    return df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("kind", kind).filter("kind is not null")


def geom_mismatch_counts(df: DataFrame, tolerance: float = 1e-6, x: str = "x", y: str = "y") -> DataFrame:
    given = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    has = F.col(x).isNotNull() & F.col(y).isNotNull()
    off = (F.abs(F.col(x) - F.col("lon")) > tolerance) | (F.abs(F.col(y) - F.col("lat")) > tolerance)
    return df.agg(F.count("*").alias("total"), F.count_if(given).alias("with_coordinates"), F.count_if(given & ~has).alias("missing"), F.count_if(given & has & off).alias("mismatched"))


def with_feature_id(df: DataFrame, order: Sequence[str | Column], name: str = "feature_no", within: str | None = None) -> DataFrame:
    """Row numbers from 1 over an order that must be total.

    Rows are cut into ranges of the first order column's value and numbered there; each range adds the rows before it, so no task sees all.
    """
    first = order[0]
    ranged = df.withColumn("_range", F.floor(F.col(first) / 10000)) if within is None else df.withColumn("_range", F.col(within))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(before, "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def distance_between(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str, name: str = "miles") -> DataFrame:
    return df.withColumn(name, geodesic_miles(lon1, lat1, lon2, lat2))
