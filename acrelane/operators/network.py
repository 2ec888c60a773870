"""Facilities with their companies: named views, hierarchy, hubs and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def facility_with_names(facility: DataFrame, company: DataFrame, ftype: DataFrame) -> DataFrame:
    """Facilities with the names of company and type, null where there is none."""
    c = company.select("company_id", F.col("name").alias("company_name"))
    t = ftype.select("facility_type_id", F.col("name").alias("facility_type_name"))
    return facility.join(c, "company_id", "left").join(t, "facility_type_id", "left")


def with_labels(named: DataFrame) -> DataFrame:
    """Blank and missing names replaced by the fixed labels."""
    for column, label in (("company_name", "Unknown Company"), ("facility_type_name", "Unknown Type"), ("name", "Unnamed Facility")):
        named = named.withColumn(column, F.coalesce(F.nullif(column, F.lit("")), F.lit(label)))
    return named


def facility_by_service(facility: DataFrame, bridge: DataFrame, service: DataFrame, name: str) -> DataFrame:
    """Active facilities that offer the named service."""
    wanted = service.filter(F.col("name") == name).select("service_id", F.col("name").alias("service_name"))
    return facility.filter("status = 'ACTIVE'").join(bridge, "facility_id").join(wanted, "service_id").select("facility_id", "name", "city", "service_name")


def company_products(company: DataFrame, facility: DataFrame, bridge: DataFrame, product: DataFrame, name: str | None = None) -> DataFrame:
    """Products by company and facility, in order of names."""
    c = company.select("company_id", F.col("name").alias("company_name"))
    if name is not None:
        c = c.filter(F.col("company_name") == name)
    p = product.select("product_id", F.col("name").alias("product_name"))
    rows = c.join(facility.select("facility_id", "company_id", F.col("name").alias("facility_name")), "company_id").join(bridge, "facility_id").join(p, "product_id")
    return rows.select("company_name", "facility_name", "product_name", "flow_role").orderBy("company_name", "facility_name", "product_name")


def facility_profile(facility: DataFrame, company: DataFrame, ftype: DataFrame, bridges: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Active facilities with the distinct names of each bridge, joined by ', '; bridges: column -> (bridge, dimension, id column).

    Each bridge is brought to one row a facility before it is joined, so bridges do not multiply.
    """
    out = facility_with_names(facility.filter("status = 'ACTIVE'"), company, ftype).select("facility_id", "name", "company_name", "facility_type_name")
    for column, (bridge, dim, key) in bridges.items():
        names = bridge.join(dim.select(key, F.col("name").alias("_n")), key).groupBy("facility_id").agg(F.array_join(F.array_sort(F.collect_set("_n")), ", ").alias(column))
        out = out.join(names, "facility_id", "left")
    return out


def facility_hierarchy(named: DataFrame) -> DataFrame:
    """Counts by company, company and type, and facility (levels 1 to 3; 0 is all), with names null above their level."""
    rows = with_labels(named).rollup("company_name", "facility_type_name", "facility_id").agg(F.count("*").alias("n_facilities"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 7, 0).when(F.col("_g") == 3, 1).when(F.col("_g") == 1, 2).otherwise(3)
    return rows.withColumn("level", level).drop("_g").orderBy("level", F.desc("n_facilities"), "company_name", "facility_type_name", "facility_id")


def counts_by_type(named: DataFrame) -> DataFrame:
    return with_labels(named).groupBy("facility_type_name").agg(F.count("*").alias("n_facilities"))


def company_list(named: DataFrame) -> DataFrame:
    return with_labels(named).groupBy("company_name").agg(F.count("*").alias("n_facilities")).orderBy("company_name")


def top_companies(named: DataFrame, n: int = 10) -> DataFrame:
    """The n companies with most facilities (ties by name), with a last row '<k> more' for the rest."""
    counts = company_list(named)
    top = counts.orderBy(F.desc("n_facilities"), "company_name").limit(n)
    rest = counts.agg((F.count("*") - n).alias("k"), F.sum("n_facilities").alias("s")).crossJoin(top.agg(F.sum("n_facilities").alias("t")))  # one row each
    more = rest.filter("k > 0").select(F.concat(F.col("k").cast("string"), F.lit(" more")).alias("company_name"), (F.col("s") - F.col("t")).alias("n_facilities"))
    return top.unionAll(more)


def company_hubs(named: DataFrame, hq_types: Sequence[int], order: str = "facility_id", suffix: str = " (HQ)") -> DataFrame:
    """(company_id, hub_facility_id, hub_name, hub_lon, hub_lat): the first facility of a headquarters type, else the mean of all places."""
    placed = named.filter("lon is not null and lat is not null")
    hq = F.col("facility_type_id").isin(*hq_types)
    first = F.min(F.when(hq, F.struct(F.col(order).alias("o"), "facility_id", "name", "lon", "lat")))
    rows = placed.groupBy("company_id").agg(first.alias("h"), F.avg("lon").alias("x"), F.avg("lat").alias("y"), F.min("company_name").alias("c"))
    name = F.coalesce("h.name", F.concat(F.coalesce(F.nullif("c", F.lit("")), F.lit("Unknown Company")), F.lit(suffix)))
    return rows.select("company_id", F.col("h.facility_id").alias("hub_facility_id"), name.alias("hub_name"), F.coalesce("h.lon", "x").alias("hub_lon"), F.coalesce("h.lat", "y").alias("hub_lat"))


def hub_spokes(named: DataFrame, hubs: DataFrame) -> DataFrame:
    """A line from each company's hub to each of its placed facilities but the hub itself."""
    rows = named.filter("lon is not null and lat is not null").select("company_id", "facility_id", "lon", "lat").join(hubs, "company_id")
    return rows.filter("not (facility_id <=> hub_facility_id)").select("company_id", "facility_id", "hub_lon", "hub_lat", "lon", "lat")


def label_ids(df: DataFrame, lookup: DataFrame, id_col: str, missing: str = "Unknown", name: str = "label") -> DataFrame:
    """df with the label of its id from lookup(id, label); the default where there is none."""
    known = lookup.select(F.col("id").cast("string").alias("_id"), F.col("label").alias("_label")).dropDuplicates(["_id"])
    return df.join(known, F.col(id_col).cast("string") == F.col("_id"), "left").withColumn(name, F.coalesce("_label", F.lit(missing))).drop("_id", "_label")


def address_queries(df: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """(id, pos, query, mode): all parts of the address (address2 too, if there is that column) if the street is usable, as mode address, then city, state and
    postal code, if city and state are there, as mode city_state.  Streets are cleaned, the state is in capitals, parts are joined by ', '."""
    from acrelane.functions.text import blank_null, clean_street, norm_text, usable_street

    street, city, state, zip_ = F.nullif(clean_street(F.col("address")), F.lit("")), norm_text(F.col("city")), blank_null(F.upper(F.col("state"))), norm_text(F.col("postal_code"))
    second = [F.nullif(clean_street(F.col("address2")), F.lit(""))] if "address2" in df.columns else []
    full = F.when(usable_street(street), F.struct(F.concat_ws(", ", street, *second, city, state, zip_).alias("query"), F.lit("address").alias("mode")))
    near = F.when(city.isNotNull() & state.isNotNull(), F.struct(F.concat_ws(", ", city, state, zip_).alias("query"), F.lit("city_state").alias("mode")))
    return df.select(id_col, F.posexplode(F.array_compact(F.array(full, near))).alias("pos", "q")).select(id_col, "pos", "q.query", "q.mode")


def cascade_lookup(candidates: DataFrame, gazetteer: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """The first candidate query of each id that gazetteer(query, lon, lat) knows; ids without any are left out."""
    met = candidates.join(gazetteer.dropDuplicates(["query"]), "query")
    best = met.groupBy(id_col).agg(F.min(F.struct("pos", "query", "mode", "lon", "lat")).alias("b"))
    return best.select(id_col, "b.query", "b.mode", "b.lon", "b.lat")


def numbered(df: DataFrame, partition: str, *order) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
