"""Staged ingest, upserts and imports.  Every operator returns the new version of its table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrelane.functions.text import FALSE_WORDS, TRUE_WORDS, blank_null, split_site
from acrelane.shared import dropped, shared_path, with_ordinal, written


def typed_projection(df: DataFrame, schema: T.StructType, sources: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """All-text columns as typed ones: trimmed, blank as null, booleans by words; sources names the columns to take the first value of.

    A text that is no value of its type is an error, as in the reference.
    """
    sources = sources or {}
    out = []
    for field in schema:
        text = F.coalesce(*[blank_null(F.col(c)) for c in sources.get(field.name, [field.name])])
        if isinstance(field.dataType, T.BooleanType):
            word = F.lower(text)
            value = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
        else:
            value = text.cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def dedupe_first(df: DataFrame, keys: Sequence[str], seq: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by an explicit order; keys are trimmed texts, nulls are equal."""
    trimmed = [F.trim(F.col(k).cast("string")) for k in keys]
    w = Window.partitionBy(*trimmed).orderBy(*seq)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def partition_replace(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """old without the rows of the condition (null counts as no), and all rows of new."""
    return old.filter(~F.coalesce(condition, F.lit(False))).unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], seq: str | None = None) -> DataFrame:
    """old and those rows of new whose key it lacks, the first of each key (by seq).  Null keys never conflict."""
    fresh = new.join(old.select(*key).distinct(), [*key], "left_anti")
    if seq is not None:
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        w = Window.partitionBy(*key).orderBy(seq)
        fresh = fresh.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") == 1) | ~whole).drop("_rn")
    return old.unionByName(fresh.select(*old.columns))


def seed_bridge(bridge: DataFrame, facility: DataFrame, dim: DataFrame, names: Sequence[str], key: str, constants: dict | None = None) -> DataFrame:
    """bridge and a row for the facility (a frame of one or few) with each named member of dim, unless there."""
    rows = facility.select("facility_id").join(dim.filter(F.col("name").isin(*names)).select(key), F.lit(True))
    rows = rows.withColumns({k: F.lit(v) for k, v in (constants or {}).items()})
    return insert_ignore(bridge, rows.select(*bridge.columns), bridge.columns)


def last_by(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key by seq."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(*[F.max_by(F.struct(*rest), seq).alias("x")]).select(*key, "x.*")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], seq: str, stamp: Column | None = None) -> DataFrame:
    """Rows of new replace rows of old with their key or are added; of several the last by seq; stamp goes to updated_at of those."""
    fresh = last_by(new, key, seq).drop(seq) if seq not in old.columns else last_by(new, key, seq)
    if stamp is not None:
        fresh = fresh.withColumn("updated_at", stamp)
    return old.join(fresh.select(*key), [*key], "left_anti").unionByName(fresh.select(*old.columns))


def keyed_part(key: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def create_keyed_table(df: DataFrame, table: str, key: Sequence[str], parts: int = 64, buckets: int = 8) -> None:
    """A table of the catalogue for upsert_into: _part, a hash of the key, divides it into folders, which are bucketed by the key."""
    rows = df.withColumn("_part", keyed_part(key, parts))
    rows.repartition(buckets, *key).write.partitionBy("_part").bucketBy(buckets, *key).sortBy(*key).mode("overwrite").option("path", shared_path(df.sparkSession, table)).saveAsTable(table)


def upsert_merge(base: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """base without the keys of fresh, and fresh.  A base bucketed by the key is not shuffled: fresh comes to its buckets."""
    return base.join(fresh.select(*key).hint("shuffle_hash"), [*key], "left_anti").unionByName(fresh)


def upsert_into(new: DataFrame, table: str, key: Sequence[str], seq: str, parts: int = 64, stamp: Column | None = None) -> int:
    """upsert() on a table of create_keyed_table (with the same parts): only folders that hold a key of new are read and written again.

    Returns the number of these folders.  Each is exchanged as a whole at the end of the job, so a lost executor leaves no half-written one.
    """
    spark = new.sparkSession
    columns = spark.table(table).columns
    fresh = last_by(new, key, seq)
    if stamp is not None:
        fresh = fresh.withColumn("updated_at", stamp)
    fresh = written(fresh.withColumn("_part", keyed_part(key, parts)).select(*columns), "fresh")
    touched = [r[0] for r in fresh.select("_part").distinct().collect()]  # at most parts numbers
    if touched:
        merged = upsert_merge(spark.table(table).filter(F.col("_part").isin(touched)), fresh, key)
        # the writer's own option does not reach tables of the catalogue
        mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            merged.select(*columns).write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    dropped(fresh)
    return len(touched)


def upsert_acres(acres: DataFrame, counts: DataFrame, crop: DataFrame) -> DataFrame:
    """crop_acres with measured counts(region_id, code, year, pixel_count, acres) put in by region, crop and year; unknown codes are left out."""
    rows = counts.join(crop.select("crop_type_id", F.col("cdl_code").alias("code")), "code").select(*acres.columns)
    key = ["region_id", "crop_type_id", "year"]
    return acres.join(rows.select(*key), key, "left_anti").unionByName(rows)


def last_filled(column: str, seq: str) -> Column:
    """Aggregate: the last value by seq that is not blank."""
    return F.max_by(column, F.when(F.nullif(F.trim(column), F.lit("")).isNotNull(), F.col(seq)))


def upsert_fill(old: DataFrame, new: DataFrame, key: Sequence[str], fill: Sequence[str], seq: str, note: str | None = None) -> DataFrame:
    """(key, fill columns[, notes]): for each key of either side the last value of new that is not blank, else old's.

    note is put behind the notes of keys that new has, once.
    """
    got = new.groupBy(*key).agg(*[last_filled(c, seq).alias(f"_{c}") for c in fill], F.lit(True).alias("_new"))
    both = old.join(got, [*key], "full")
    out = [*key, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in fill]]
    if note is not None:
        add = F.when(F.col("_new").isNull() | F.contains(F.coalesce("notes", F.lit("")), F.lit(note)), F.col("notes")).otherwise(F.concat_ws("\n", "notes", F.lit(note)))
        out.append(add.alias("notes"))
    return both.select(*out)


def directory_to_facilities(directory: DataFrame, company: DataFrame, default_point: tuple[float, float] = (-98.0, 38.5)) -> DataFrame:
    """(company_id, name, city, state, street, zip, website, phone, lon, lat): one facility for each company, name, city and state of the
    directory; the last value that is not blank fills each field.  Companies that the table lacks are left out."""
    rows = directory.join(company.select("company_id", F.col("name").alias("company")), "company")
    city = blank_null(F.col("city"))
    rows = rows.withColumns({"facility_name": F.coalesce(city, F.col("company")), "city_": city, "state_": F.coalesce(blank_null(F.col("state")), F.lit("KS"))})
    fill = ["street", "zip", "website", "phone"]
    out = rows.groupBy("company_id", "facility_name", "city_", "state_").agg(*[last_filled(c, "seq").alias(c) for c in fill])
    return out.select("company_id", F.col("facility_name").alias("name"), F.col("city_").alias("city"), F.col("state_").alias("state"), *fill, F.lit(default_point[0]).alias("lon"), F.lit(default_point[1]).alias("lat"))


def insert_contacts(contacts: DataFrame, directory: DataFrame, facility: DataFrame) -> DataFrame:
    """contacts(facility_id, name, is_primary) and the directory's named persons at facilities (company, city) that lack them."""
    people = directory.filter(blank_null(F.col("contact")).isNotNull()).select("company", blank_null(F.col("city")).alias("_city"), F.trim("contact").alias("name"))
    at = facility.select("facility_id", F.col("company").alias("_company"), F.col("city").alias("_fcity"))
    rows = people.join(at, (F.col("company") == F.col("_company")) & F.col("_city").eqNullSafe(F.col("_fcity"))).select("facility_id", "name").distinct()
    return insert_ignore(contacts, rows.withColumn("is_primary", F.lit(True)), ["facility_id", "name"])


def shape_plants(df: DataFrame) -> DataFrame:
    """(seq, name, company, city, state, notes) of a list of plants with variant columns already coalesced: plant_name, company, location, feedstock, rins,
    capacity, and city, state, notes and description where they are there.

    The location is the code of a state: it stands for a state that is not given, before KS.  A plant is named by the list, or by company and
    location; without a location by its company alone.  What is known of its production makes the notes, else those of the list.
    """
    def value(c: str) -> Column:
        return blank_null(F.col(c)) if c in df.columns else F.lit(None).cast("string")

    def part(label: str, c: str, unit: str = "") -> Column:
        return F.concat(F.lit(f"{label}: "), value(c), F.lit(unit))

    company, location = F.coalesce(value("company"), F.lit("Unknown Company")), value("location")
    both = F.regexp_replace(F.concat(company, F.lit(" - "), location), r"^[ -]+|[ -]+$", "")
    name = F.when(location.isNotNull(), F.coalesce(value("plant_name"), both)).otherwise(company)
    made = F.nullif(F.concat_ws("; ", part("Feedstock", "feedstock"), part("RINs", "rins"), part("Capacity", "capacity", " MMgy")), F.lit(""))
    state, notes = F.coalesce(value("state"), location, F.lit("KS")), F.coalesce(made, value("notes"), value("description"))
    return df.select("seq", name.alias("name"), value("company").alias("company"), value("city").alias("city"), state.alias("state"), notes.alias("notes"))


def import_plants(plants: DataFrame, company: DataFrame, facility: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New companies (company_id, name) by exact name, and new facilities (name, company, city, state, notes) that (name, city or '', state) lacks."""
    fresh = plants.filter("company is not null").select(F.col("company").alias("name")).distinct().join(company.select("name"), "name", "left_anti")
    start = company.agg(F.coalesce(F.max("company_id"), F.lit(0)).alias("_m"))
    # start is one row
    companies = with_ordinal(fresh, "name", "_no").join(F.broadcast(start)).select((F.col("_m") + F.col("_no")).alias("company_id"), "name")
    known = facility.select("name", F.coalesce("city", F.lit("")).alias("_city"), "state").distinct()
    rows = plants.withColumn("_city", F.coalesce("city", F.lit(""))).join(known, ["name", "_city", "state"], "left_anti")
    first = rows.groupBy("name", "_city", "state").agg(F.min(F.struct("seq", "company", "city", "notes")).alias("x"))
    return companies, first.select("name", "x.company", "x.city", "state", "x.notes")


def seed_urls(company: DataFrame, facility: DataFrame, scrape_url: DataFrame) -> DataFrame:
    """New rows (company_id, facility_id, site, bid_page_path) for websites that scrape_url lacks: first companies', then facilities', each site
    once for the lowest id."""
    def sites(df, ids):
        return df.select(*ids, split_site(F.col("website")).alias("s")).filter("s is not null").select(*ids, "s.site", "s.bid_page_path")

    first = sites(company.withColumn("facility_id", F.lit(None).cast("bigint")), ["company_id", "facility_id"]).join(scrape_url.select("site").distinct(), "site", "left_anti")
    first = first.groupBy("site").agg(F.min(F.struct("company_id", "facility_id", "bid_page_path")).alias("x"))
    second = sites(facility, ["company_id", "facility_id"]).join(scrape_url.select("site").distinct(), "site", "left_anti").join(first.select("site"), "site", "left_anti")
    second = second.groupBy("site").agg(F.min(F.struct("facility_id", "company_id", "bid_page_path")).alias("x"))
    names = ["x.company_id", "x.facility_id", "site", "x.bid_page_path"]
    return first.select(*names).unionByName(second.select(*names))


def audit_log(before: DataFrame, after: DataFrame, queries: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """(id, query, old and new lon and lat, status): NO_QUERY, NO_RESULT, UNCHANGED or UPDATED for every row of before."""
    old = before.select(id_col, F.col("lon").alias("old_lon"), F.col("lat").alias("old_lat"))
    new = after.select(id_col, F.col("query"), F.col("lon").alias("new_lon"), F.col("lat").alias("new_lat"))
    asked = queries.groupBy(id_col).agg(F.min_by("query", "pos").alias("first_query"))
    rows = old.join(asked, id_col, "left").join(new, id_col, "left")
    same = F.col("old_lon").eqNullSafe(F.col("new_lon")) & F.col("old_lat").eqNullSafe(F.col("new_lat"))
    status = F.when(F.col("first_query").isNull(), "NO_QUERY").when(F.col("new_lon").isNull(), "NO_RESULT").when(same, "UNCHANGED").otherwise("UPDATED")
    return rows.select(id_col, F.coalesce("query", "first_query").alias("query"), "old_lon", "old_lat", "new_lon", "new_lat", status.alias("status"))
