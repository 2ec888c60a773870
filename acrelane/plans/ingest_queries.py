"""Queries on staged ingest, upserts and imports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrelane.operators import ingest
from acrelane.plans.facility_queries import path_of, site_of
from acrelane.plans.registry import query
from acrelane.shared import shared_path

_STAGED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("geoid", T.StringType()), T.StructField("acres", T.DoubleType()), T.StructField("homestead", T.BooleanType()), T.StructField("any_id", T.StringType()), T.StructField("yearbuilt", T.IntegerType())])


@query("typed_projection", "SELECT seq, nullif(trim(geoid), '') AS geoid, CAST(nullif(trim(acres), '') AS DOUBLE) AS acres, CASE WHEN lower(trim(homestead)) IN ('t', 'true', 'y', 'yes', '1') THEN TRUE WHEN lower(trim(homestead)) IN ('f', 'false', 'n', 'no', '0') THEN FALSE END AS homestead, coalesce(nullif(trim(alt_id), ''), nullif(trim(main_id), '')) AS any_id, CAST(nullif(trim(yearbuilt), '') AS INT) AS yearbuilt FROM {staged} s")
def typed_projection(t):
    return ingest.typed_projection(t("staged").withColumn("seq", F.col("seq").cast("string")), _STAGED, {"any_id": ["alt_id", "main_id"]})


@query("dedupe_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(qty AS DOUBLE) AS qty, CAST(price AS DOUBLE) AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, qty, price) AS rn FROM {repeats} r) x WHERE rn = 1")
def dedupe_first(t):
    return ingest.dedupe_first(t("repeats"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "qty", "price"]).withColumns({c: F.col(c).cast("double") for c in ("qty", "price")})


@query("partition_replace", "SELECT id, owner, trim(county) AS county FROM {parcels} p WHERE county IS NULL OR trim(county) <> 'Rush' UNION ALL SELECT id + 1000000, owner, 'Rush' FROM {parcels} p WHERE id % 4 = 0")
def partition_replace(t):
    old = t("parcels").select("id", "owner", F.trim("county").alias("county"))
    new = t("parcels").filter("id % 4 = 0").select((F.col("id") + 1000000).alias("id"), "owner", F.lit("Rush").alias("county"))
    return ingest.partition_replace(old, new, F.col("county") == "Rush")


@query("insert_ignore", "SELECT id, owner FROM {parcels} p WHERE id % 2 = 0 UNION ALL SELECT id, 'new' FROM {parcels} p WHERE id % 3 = 0 AND id % 2 <> 0")
def insert_ignore(t):
    old = t("parcels").filter("id % 2 = 0").select("id", "owner")
    return ingest.insert_ignore(old, t("parcels").filter("id % 3 = 0").select("id", F.lit("new").alias("owner")), ["id"], "id")


@query("seed_bridge", "SELECT facility_id, product_id, flow_role FROM {facility_product} b UNION SELECT 5, product_id, 'SELL' FROM {product} p WHERE name IN ('Product 1', 'Product 2', 'Product 8')")
def seed_bridge(t):
    return ingest.seed_bridge(t("facility_product"), t("facility").filter("facility_id = 5"), t("product"), ["Product 1", "Product 2", "Product 8"], "product_id", {"flow_role": "SELL"})


_DIR = "(SELECT detail_url, company, city, phone, seq FROM {directory} d)"


_UPSERT = f"SELECT detail_url, company, city, phone, updated_at FROM (SELECT *, 'old' AS updated_at, row_number() OVER (PARTITION BY detail_url ORDER BY seq DESC) AS rn FROM {_DIR} d WHERE seq < 600) o WHERE rn = 1 AND detail_url NOT IN (SELECT detail_url FROM {_DIR} d WHERE seq >= 500) UNION ALL SELECT detail_url, company, city, phone, 'now' FROM (SELECT *, row_number() OVER (PARTITION BY detail_url ORDER BY seq DESC) AS rn FROM {_DIR} d WHERE seq >= 500) n WHERE rn = 1"


@query("upsert_replace", _UPSERT)
def upsert_replace(t):
    rows = t("directory").select("detail_url", "company", "city", "phone", "seq")
    old = ingest.last_by(rows.filter("seq < 600"), ["detail_url"], "seq").drop("seq").withColumn("updated_at", F.lit("old"))
    return ingest.upsert(old, rows.filter("seq >= 500"), ["detail_url"], "seq", F.lit("now"))


@query("upsert_stored", _UPSERT)
def upsert_stored(t):
    """The same rows by a stored table, of which the folders of new keys are exchanged."""
    rows = t("directory").select("detail_url", "company", "city", "phone", "seq")
    old = ingest.last_by(rows.filter("seq < 600"), ["detail_url"], "seq").drop("seq").withColumn("updated_at", F.lit("old"))
    table = "upsert_" + shared_path(t.spark, "t").rpartition("-")[2]
    ingest.create_keyed_table(old, table, ["detail_url"], parts=16)
    ingest.upsert_into(rows.filter("seq >= 500"), table, ["detail_url"], "seq", 16, F.lit("now"))
    return t.spark.table(table).drop("_part")


_LAST = "arg_max({c}, seq) FILTER (WHERE trim({c}) <> '')"


def _fill(*names):
    return ", ".join(f"{_LAST.replace('{c}', c)} AS n_{c}" for c in names)


@query("upsert_fill", f"""WITH o AS (SELECT company, min(website) AS website, min(phone) AS phone, CASE WHEN min(seq) % 2 = 0 THEN 'from list' WHEN min(seq) % 3 = 0 THEN 'kept' END AS notes FROM {{directory}} d WHERE seq % 3 = 0 GROUP BY company),
 n AS (SELECT company, {_fill('website', 'phone')} FROM {{directory}} d WHERE seq % 3 = 1 GROUP BY company)
 SELECT coalesce(o.company, n.company) AS company, coalesce(n_website, website) AS website, coalesce(n_phone, phone) AS phone, CASE WHEN n.company IS NULL OR contains(coalesce(notes, ''), 'from list') THEN notes ELSE concat_ws(chr(10), notes, 'from list') END AS notes FROM o FULL JOIN n ON o.company = n.company""")
def upsert_fill(t):
    d = t("directory")
    notes = F.when(F.min("seq") % 2 == 0, "from list").when(F.min("seq") % 3 == 0, "kept")
    old = d.filter("seq % 3 = 0").groupBy("company").agg(F.min("website").alias("website"), F.min("phone").alias("phone"), notes.alias("notes"))
    return ingest.upsert_fill(old, d.filter("seq % 3 = 1"), ["company"], ["website", "phone"], "seq", "from list")


_COOPS = "(SELECT row_number() OVER (ORDER BY company) AS company_id, company AS name FROM (SELECT DISTINCT company FROM {directory} d WHERE seq % 4 <> 3) c)"
_DFAC = f"(SELECT c.company_id, coalesce(nullif(trim(city), ''), d.company) AS name, nullif(trim(city), '') AS city, coalesce(nullif(trim(state), ''), 'KS') AS state, {_fill('street', 'zip', 'website', 'phone')} FROM {{directory}} d JOIN (SELECT min(seq) AS company_id, company FROM {{directory}} k GROUP BY company) c ON d.company = c.company GROUP BY 1, 2, 3, 4)"


def _coops(t):
    return t("directory").groupBy(F.col("company").alias("name")).agg(F.min("seq").alias("company_id"))


@query("directory_to_facilities", f"SELECT company_id, name, city, state, n_street AS street, n_zip AS zip, n_website AS website, n_phone AS phone, -98e0 AS lon, 38.5e0 AS lat FROM {_DFAC} f")
def directory_to_facilities(t):
    return ingest.directory_to_facilities(t("directory"), _coops(t))


@query("contact_insert", """WITH f AS (SELECT company, nullif(trim(city), '') AS city, min(seq) AS facility_id FROM {directory} d GROUP BY 1, 2), c AS (SELECT facility_id, 'Person ' || CAST(facility_id % 5 AS VARCHAR) AS name, FALSE AS is_primary FROM f WHERE facility_id % 2 = 0)
 SELECT * FROM c UNION ALL SELECT DISTINCT f.facility_id, trim(contact), TRUE FROM {directory} d JOIN f ON d.company = f.company AND nullif(trim(d.city), '') IS NOT DISTINCT FROM f.city WHERE trim(contact) <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.facility_id = f.facility_id AND c.name = trim(contact))""")
def contact_insert(t):
    d = t("directory")
    facility = d.groupBy("company", F.nullif(F.trim("city"), F.lit("")).alias("city")).agg(F.min("seq").alias("facility_id"))
    contacts = facility.filter("facility_id % 2 = 0").select("facility_id", F.concat(F.lit("Person "), (F.col("facility_id") % 5).cast("string")).alias("name"), F.lit(False).alias("is_primary"))
    return ingest.insert_contacts(contacts, d, facility)


# the location is a state's code; the row's name is used only where there is a location
_PLANTS = """(SELECT seq, CASE WHEN trim(location) <> '' THEN coalesce(nullif(trim(plant_name), ''), coalesce(nullif(trim(company), ''), 'Unknown Company') || ' - ' || trim(location)) ELSE coalesce(nullif(trim(company), ''), 'Unknown Company') END AS name,
 nullif(trim(company), '') AS company, nullif(trim(city), '') AS city, coalesce(nullif(trim(state), ''), nullif(trim(location), ''), 'KS') AS state,
 coalesce(nullif(concat_ws('; ', CASE WHEN trim(feedstock) <> '' THEN 'Feedstock: ' || trim(feedstock) END, CASE WHEN trim(rins) <> '' THEN 'RINs: ' || trim(rins) END, CASE WHEN trim(capacity) <> '' THEN 'Capacity: ' || trim(capacity) || ' MMgy' END), ''), nullif(trim(notes), ''), nullif(trim(description), '')) AS notes FROM {plants} p)"""


@query("plant_row_shape", f"SELECT seq, name, company, city, state, notes FROM {_PLANTS} p")
def plant_row_shape(t):
    return ingest.shape_plants(t("plants"))


def _imported(t):
    company = t("company").select("company_id", "name").unionAll(t("plants").filter("seq % 7 = 0").select((F.col("seq") + 100).alias("company_id"), F.col("company").alias("name")))
    rows = ingest.shape_plants(t("plants"))
    facility = rows.filter("seq % 9 = 0").select("name", "city", "state")
    return ingest.import_plants(rows, company, facility)


@query("plants_to_entities", f"SELECT name, company, city, state, notes FROM (SELECT *, row_number() OVER (PARTITION BY name, coalesce(city, ''), state ORDER BY seq) AS rn FROM {_PLANTS} p) x WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {_PLANTS} k WHERE k.seq % 9 = 0 AND k.name = x.name AND coalesce(k.city, '') = coalesce(x.city, '') AND k.state = x.state)")
def plants_to_entities(t):
    return _imported(t)[1]


@query("plants_new_companies", f"SELECT m + row_number() OVER (ORDER BY name) AS company_id, name FROM (SELECT DISTINCT company AS name FROM {_PLANTS} p WHERE company IS NOT NULL AND company NOT IN (SELECT company FROM {{plants}} k WHERE seq % 7 = 0) AND company NOT IN (SELECT name FROM {{company}} c)) n, (SELECT greatest((SELECT max(company_id) FROM {{company}} c), (SELECT max(seq) + 100 FROM {{plants}} k WHERE seq % 7 = 0)) AS m) g")
def plants_new_companies(t):
    return _imported(t)[0]


@query("site_seed_urls", f"""WITH u AS (SELECT {site_of('website')} AS site FROM {{facility}} f WHERE website IS NOT NULL AND facility_id % 13 = 2),
 a AS (SELECT company_id, CAST(NULL AS BIGINT) AS facility_id, {site_of('website')} AS site, {path_of('website')} AS bid_page_path, row_number() OVER (PARTITION BY {site_of('website')} ORDER BY company_id) AS rn FROM {{company}} c WHERE website IS NOT NULL AND {site_of('website')} NOT IN (SELECT site FROM u)),
 b AS (SELECT company_id, facility_id, {site_of('website')} AS site, {path_of('website')} AS bid_page_path, row_number() OVER (PARTITION BY {site_of('website')} ORDER BY facility_id) AS rn FROM {{facility}} f WHERE website IS NOT NULL AND {site_of('website')} NOT IN (SELECT site FROM u UNION ALL SELECT site FROM a))
 SELECT company_id, facility_id, site, bid_page_path FROM a WHERE rn = 1 UNION ALL SELECT company_id, facility_id, site, bid_page_path FROM b WHERE rn = 1""")
def site_seed_urls(t):
    from acrelane.functions.text import split_site

    there = t("facility").filter("facility_id % 13 = 2").select(split_site(F.col("website"))["site"].alias("site")).filter("site is not null")
    return ingest.seed_urls(t("company"), t("facility"), there)
