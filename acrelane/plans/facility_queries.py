"""Queries on facilities, companies and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrelane.functions.text import clean_street, norm_company, norm_text, normalize_url, split_site
from acrelane.operators import network, parcels, quality
from acrelane.plans.registry import query

_NAMED = "(SELECT f.*, c.name AS company_name, t.name AS facility_type_name FROM {facility} f LEFT JOIN {company} c ON f.company_id = c.company_id LEFT JOIN {facility_type} t ON f.facility_type_id = t.facility_type_id)"
_LABELLED = f"(SELECT facility_id, company_id, coalesce(nullif(name, ''), 'Unnamed Facility') AS name, coalesce(nullif(company_name, ''), 'Unknown Company') AS company_name, coalesce(nullif(facility_type_name, ''), 'Unknown Type') AS facility_type_name FROM {_NAMED} n)"


def named(t):
    return network.facility_with_names(t("facility"), t("company"), t("facility_type"))


@query("facility_with_names", f"SELECT facility_id, name, company_name, facility_type_name, city, status FROM {_NAMED} n")
def facility_with_names(t):
    return named(t).select("facility_id", "name", "company_name", "facility_type_name", "city", "status")


@query("null_labels", f"SELECT facility_id, name, company_name, facility_type_name FROM {_LABELLED} l")
def null_labels(t):
    return network.with_labels(named(t)).select("facility_id", "name", "company_name", "facility_type_name")


@query("facility_by_service", "SELECT f.facility_id, f.name, f.city, s.name AS service_name FROM {facility} f JOIN {facility_service} b ON f.facility_id = b.facility_id JOIN {service} s ON b.service_id = s.service_id WHERE s.name = 'Service ASIA' AND status = 'ACTIVE'")
def facility_by_service(t):
    return network.facility_by_service(t("facility"), t("facility_service"), t("service"), "Service ASIA")


@query("company_products", "SELECT c.name AS company_name, f.name AS facility_name, p.name AS product_name, flow_role FROM {company} c JOIN {facility} f ON c.company_id = f.company_id JOIN {facility_product} b ON f.facility_id = b.facility_id JOIN {product} p ON b.product_id = p.product_id")
def company_products(t):
    return network.company_products(t("company"), t("facility"), t("facility_product"), t("product"))


def _list(bridge, dim, key):
    return f"(SELECT b.facility_id, string_agg(DISTINCT d.name, ', ' ORDER BY d.name) AS xs FROM {{{bridge}}} b JOIN {{{dim}}} d ON b.{key} = d.{key} GROUP BY b.facility_id)"


@query("facility_profile", f"SELECT n.facility_id, n.name, n.company_name, n.facility_type_name, a.xs AS services, b.xs AS products, c.xs AS modes FROM {_NAMED} n LEFT JOIN {_list('facility_service', 'service', 'service_id')} a ON n.facility_id = a.facility_id LEFT JOIN {_list('facility_product', 'product', 'product_id')} b ON n.facility_id = b.facility_id LEFT JOIN {_list('facility_mode', 'mode', 'mode_id')} c ON n.facility_id = c.facility_id WHERE n.status = 'ACTIVE'")
def facility_profile(t):
    return network.facility_profile(t("facility"), t("company"), t("facility_type"), {"services": (t("facility_service"), t("service"), "service_id"), "products": (t("facility_product"), t("product"), "product_id"), "modes": (t("facility_mode"), t("mode"), "mode_id")})


@query("facility_hierarchy", f"SELECT company_name, facility_type_name, facility_id, count(*) AS n_facilities, CASE grouping(company_name, facility_type_name, facility_id) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level FROM {_LABELLED} l GROUP BY ROLLUP (company_name, facility_type_name, facility_id)")
def facility_hierarchy(t):
    return network.facility_hierarchy(named(t))


@query("facility_counts_by_type", f"SELECT facility_type_name, count(*) AS n_facilities FROM {_LABELLED} l GROUP BY 1")
def facility_counts_by_type(t):
    return network.counts_by_type(named(t))


@query("company_filter_list", f"SELECT company_name, count(*) AS n_facilities FROM {_LABELLED} l GROUP BY 1")
def company_filter_list(t):
    return network.company_list(named(t))


@query("top_n_companies", f"WITH c AS (SELECT company_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, company_name) AS rn FROM {_LABELLED} l GROUP BY 1) SELECT company_name, n AS n_facilities FROM c WHERE rn <= 10 UNION ALL SELECT count(*) || ' more', CAST(sum(n) AS BIGINT) FROM c WHERE rn > 10 HAVING count(*) > 0")
def top_n_companies(t):
    return network.top_companies(named(t))


_HUBS = f"""(SELECT company_id, h.facility_id AS hub_facility_id, coalesce(h.name, coalesce(nullif(c, ''), 'Unknown Company') || ' (HQ)') AS hub_name, coalesce(h.lon, x) AS hub_lon, coalesce(h.lat, y) AS hub_lat FROM (
 SELECT company_id, arg_min({{{{'facility_id': facility_id, 'name': name, 'lon': lon, 'lat': lat}}}}, facility_id) FILTER (WHERE facility_type_id = 3) AS h, avg(lon) AS x, avg(lat) AS y, min(company_name) AS c FROM {_NAMED} n WHERE lon IS NOT NULL GROUP BY company_id) g)"""


@query("company_hub", f"SELECT company_id, hub_facility_id, hub_name, round(hub_lon, 6) AS hub_lon, round(hub_lat, 6) AS hub_lat FROM {_HUBS} h")
def company_hub(t):
    return network.company_hubs(named(t), [3]).withColumns({c: F.round(c, 6) for c in ("hub_lon", "hub_lat")})


@query("hub_spokes", f"SELECT f.company_id, f.facility_id, round(hub_lon, 6) AS hub_lon, round(hub_lat, 6) AS hub_lat, lon, lat FROM {{facility}} f JOIN {_HUBS} h ON f.company_id = h.company_id WHERE lon IS NOT NULL AND f.facility_id IS DISTINCT FROM h.hub_facility_id")
def hub_spokes(t):
    return network.hub_spokes(named(t), network.company_hubs(named(t), [3])).withColumns({c: F.round(c, 6) for c in ("hub_lon", "hub_lat")})


@query("lookup_labels", "SELECT f.facility_id, coalesce(c.name, 'Unknown Company') AS label FROM {facility} f LEFT JOIN (SELECT * FROM {company} k WHERE company_id % 2 = 0) c ON f.company_id = c.company_id")
def lookup_labels(t):
    known = t("company").filter("company_id % 2 = 0").select(F.col("company_id").alias("id"), F.col("name").alias("label"))
    return network.label_ids(t("facility"), known, "company_id", "Unknown Company").select("facility_id", "label")


@query("facet_search", f"SELECT facility_id, name FROM {_NAMED} n WHERE state = 'KS' AND facility_type_id = 2 AND (contains(lower(coalesce(name, '')), 'supp') OR contains(lower(coalesce(company_name, '')), 'supp')) AND (contains(lower(coalesce(name, '')), '_1') OR contains(lower(coalesce(company_name, '')), '_1'))")
def facet_search(t):
    return parcels.facet_search(named(t), {"state": "KS", "facility_type_id": 2}, "SUPP _1", ["name", "company_name"]).select("facility_id", "name")


@query("membership_filter", "SELECT facility_id, 'some' AS choice FROM {facility} f WHERE company_id IN (1, 4, 7) UNION ALL SELECT facility_id, 'all' FROM {facility} f")
def membership_filter(t):
    f = t("facility")
    parts = {"some": parcels.membership_filter(f, "company_id", [1, 4, 7]), "none": parcels.membership_filter(f, "company_id", []), "all": parcels.membership_filter(f, "company_id", [], empty="all")}
    out = None
    for label, df in parts.items():
        part = df.select("facility_id", F.lit(label).alias("choice"))
        out = part if out is None else out.unionAll(part)
    return out


_USABLE = "(lower(trim(coalesce(address, ''))) NOT IN ('n/a', 'na', 'none', 'unknown', 'null', '-', '--') AND trim(coalesce(address, '')) <> '' AND (regexp_matches(address, '[0-9]') OR length(trim(address)) >= 6))"


@query("needs_geocode", f"SELECT facility_id, 'default_point' AS mode FROM {{facility}} f WHERE notes LIKE '%KGFA%' AND lat = 38.5 AND lon = -98 UNION ALL SELECT facility_id, 'address' FROM {{facility}} f WHERE {_USABLE}")
def needs_geocode(t):
    return parcels.needs_geocode(t("facility")).select("facility_id", F.lit("default_point").alias("mode")).unionAll(parcels.needs_geocode(t("facility"), "address").select("facility_id", F.lit("address").alias("mode")))


# streets as the geocoding tool cleans them, parts joined by commas
_ROADS = (r"\bC\.?\s*R\.?\b", r"\bCo\.?\s*Rd\.?\b", r"\bCty\.?\s*Rd\.?\b", r"\bCounty\s+Rd\b")


def _street(c):
    text = clean = rf"coalesce(trim(regexp_replace({c}, '\s+', ' ', 'g')), '')"
    for road in _ROADS:
        clean = f"regexp_replace({clean}, '{road}', 'County Road', 'gi')"
    return f"CASE WHEN lower({text}) IN ('n/a', 'na', 'none', 'unknown', 'null', '-', '--') THEN '' ELSE trim({clean}) END"


CLEAN_STREET = _street("address")
_LINES = "(SELECT f.*, CASE WHEN facility_id % 8 = 3 THEN '  Dock 4 c.r. 2' WHEN facility_id % 8 = 5 THEN '--' END AS address2 FROM {facility} f)"
_PARTS = f"(SELECT facility_id, nullif({CLEAN_STREET}, '') AS street, nullif({_street('address2')}, '') AS street2, nullif(trim(city), '') AS city, nullif(trim(upper(state)), '') AS state, nullif(trim(postal_code), '') AS zip FROM {_LINES} l)"
_FULL = "street IS NOT NULL AND (regexp_matches(street, '[0-9]') OR length(street) >= 6)"
_QUERIES = f"(SELECT facility_id, CAST(0 AS INT) AS pos, concat_ws(', ', street, street2, city, state, zip) AS query, 'address' AS mode FROM {_PARTS} p WHERE {_FULL} UNION ALL SELECT facility_id, CASE WHEN {_FULL} THEN 1 ELSE 0 END, concat_ws(', ', city, state, zip), 'city_state' FROM {_PARTS} p WHERE city IS NOT NULL AND state IS NOT NULL)"


def address_lines(t):
    k = F.col("facility_id") % 8
    return t("facility").withColumn("address2", F.when(k == 3, "  Dock 4 c.r. 2").when(k == 5, "--"))


@query("address_query_build", f"SELECT facility_id, pos, query, mode FROM {_QUERIES} q")
def address_query_build(t):
    return network.address_queries(address_lines(t))


_GAZ = f"(SELECT query, min(facility_id) / 100e0 AS lon, max(facility_id) / 100e0 AS lat FROM {_QUERIES} q WHERE (mode = 'city_state') OR facility_id % 3 = 0 GROUP BY query)"


def gazetteer(t):
    known = network.address_queries(address_lines(t)).filter("mode = 'city_state' or facility_id % 3 = 0")
    return known.groupBy("query").agg((F.min("facility_id") / 100.0).alias("lon"), (F.max("facility_id") / 100.0).alias("lat"))


_CASCADE = f"(SELECT facility_id, query, mode, lon, lat FROM (SELECT q.*, g.lon, g.lat, row_number() OVER (PARTITION BY facility_id ORDER BY pos) AS rn FROM {_QUERIES} q JOIN {_GAZ} g USING (query)) x WHERE rn = 1)"


@query("cascade_lookup", f"SELECT facility_id, query, mode, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {_CASCADE} c")
def cascade_lookup(t):
    return network.cascade_lookup(network.address_queries(address_lines(t)), gazetteer(t)).withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@query("sink_audit_log", f"""SELECT f.facility_id, coalesce(c.query, a.query) AS query, f.lon AS old_lon, f.lat AS old_lat, round(c.lon, 6) AS new_lon, round(c.lat, 6) AS new_lat,
 CASE WHEN a.query IS NULL THEN 'NO_QUERY' WHEN c.lon IS NULL THEN 'NO_RESULT' WHEN f.lon IS NOT DISTINCT FROM c.lon AND f.lat IS NOT DISTINCT FROM c.lat THEN 'UNCHANGED' ELSE 'UPDATED' END AS status
 FROM {{facility}} f LEFT JOIN (SELECT facility_id, query FROM {_QUERIES} q WHERE pos = 0) a USING (facility_id) LEFT JOIN {_CASCADE} c USING (facility_id)""")
def sink_audit_log(t):
    from acrelane.operators.ingest import audit_log

    asked = network.address_queries(address_lines(t))
    log = audit_log(t("facility"), network.cascade_lookup(asked, gazetteer(t)), asked)
    return log.withColumns({c: F.round(c, 6) for c in ("new_lon", "new_lat")})


@query("text_normalize", r"SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name || ' ' || c_mktsegment END AS text FROM {customer} c")
def text_normalize(t):
    raw = F.when(F.col("c_custkey") % 9 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" \t\n"), "c_mktsegment", F.lit("  ")))
    return t("customer").select(F.col("c_custkey").alias("id"), norm_text(raw).alias("text"))


@query("street_normalize", f"SELECT facility_id, {CLEAN_STREET} AS street FROM {{facility}} f")
def street_normalize(t):
    return t("facility").select("facility_id", clean_street(F.col("address")).alias("street"))


COMPANY_KEY = r"array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(coalesce(name, '')), '[^\w\s&-]', '', 'g')), '\s+'), lambda w: w NOT IN ('inc', 'incorporated', 'corp', 'corporation', 'llc', 'ltd', 'co', 'company', '')), ' ')"


@query("company_name_normalize", f"SELECT company_id, {COMPANY_KEY} AS key FROM {{company_dup}} c")
def company_name_normalize(t):
    return t("company_dup").select("company_id", norm_company(F.col("name")).alias("key"))


# a single slash behind the scheme is repaired; sites of full URLs in small letters are cut at the host, all else is taken whole
def site_of(c):
    return f"CASE WHEN trim({c}) = '' THEN NULL WHEN {c} LIKE 'http://%' OR {c} LIKE 'https://%' THEN regexp_replace({c}, '^https?://([^/]+).*$', 'https://\\1', 'i') ELSE 'https://' || {c} END"


def path_of(c):
    return f"CASE WHEN {c} LIKE 'http://%' OR {c} LIKE 'https://%' THEN regexp_replace({c}, '^https?://[^/]+(.*)$', '\\1', 'i') END"


_URL = "CASE WHEN regexp_matches(website, '^https?:/([^/]|$)') THEN regexp_replace(website, '^https?:/', 'https://') WHEN website LIKE 'http://%' OR website LIKE 'https://%' THEN website ELSE 'https://' || website END"


@query("url_normalize", f"SELECT facility_id, {_URL} AS url, {site_of('website')} AS site, {path_of('website')} AS bid_page_path FROM {{facility}} f")
def url_normalize(t):
    site = split_site(F.col("website"))
    return t("facility").select("facility_id", normalize_url(F.col("website")).alias("url"), site["site"].alias("site"), site["bid_page_path"].alias("bid_page_path"))


_TABLES = ("company", "facility", "facility_product", "parcels")


@query("orphan_check", "SELECT 'facility.company_id' AS label, count(*) AS n FROM {facility} f WHERE company_id NOT IN (SELECT company_id FROM {company} c WHERE company_id % 5 <> 0) UNION ALL SELECT 'facility_product.product_id', count(*) FROM {facility_product} b WHERE product_id NOT IN (SELECT product_id FROM {product} p WHERE product_id > 1)")
def orphan_check(t):
    tables = {"facility": t("facility"), "company": t("company").filter("company_id % 5 <> 0"), "facility_product": t("facility_product"), "product": t("product").filter("product_id > 1")}
    return quality.orphans(tables, [("facility", "company_id", "company", "company_id"), ("facility_product", "product_id", "product", "product_id")])


@query("unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {repeats} r GROUP BY ALL HAVING count(*) > 1")
def unique_check(t):
    return quality.duplicates(t("repeats"), ["l_orderkey", "l_linenumber"])


@query("range_check", "SELECT count(*) FILTER (WHERE abs(lat * 2.3) > 90 OR abs(lon) > 180) AS n_outside, count(*) FILTER (WHERE abs(x - lon) > 1e-4 AND abs(y - lat * 2.3) > 1e-4) AS n_drifted, count(*) FILTER (WHERE lon IS NULL OR abs(lat * 2.3) > 90) AS n_bad FROM (SELECT *, CASE WHEN facility_id % 4 = 0 THEN lon + 1 ELSE lon END AS x, lat AS y FROM {facility} f) f")
def range_check(t):
    rows = t("facility").withColumns({"x": F.when(F.col("facility_id") % 4 == 0, F.col("lon") + 1).otherwise(F.col("lon")), "y": F.col("lat")})
    return quality.range_check(rows.withColumn("lat", F.col("lat") * 2.3))


_RULES = {
    "facility": {"no_city": "city IS NULL", "no_point": "lon IS NULL OR lat IS NULL", "outside": "abs(lat) > 90 OR abs(lon) > 180", "bad_zip": "NOT (length(postal_code) = 5)"},
    "parcels": {"blank_owner": "trim(owner) = ''", "no_use": "usedesc IS NULL", "acres_differ": "abs(ll_gisacre - gisacre) > 100"},
    "company": {"no_name": "coalesce(trim(name), '') = ''"},
}


@query("check_suite", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) AS n FROM {{{t}}} t WHERE {c}" for t, rules in _RULES.items() for r, c in ({"n_rows": "TRUE"} | rules).items()))
def check_suite(t):
    return quality.check_suite({n: t(n) for n in _RULES}, {n: {r: F.expr(c) for r, c in rules.items()} for n, rules in _RULES.items()})


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {{{n}}} t" for n in _TABLES)


@query("baseline_counts", f"SELECT table_name, n AS n_before, CASE table_name WHEN 'parcels' THEN (SELECT count(*) FROM {{parcels}} p WHERE id % 7 <> 0) ELSE n END AS n_after, CASE table_name WHEN 'parcels' THEN (SELECT count(*) FROM {{parcels}} p WHERE id % 7 <> 0) ELSE n END - n AS diff FROM ({_COUNTS}) c")
def baseline_counts(t):
    old = {n: t(n) for n in _TABLES}
    return quality.baseline_diff(quality.baseline(old), quality.baseline(old | {"parcels": t("parcels").filter("id % 7 <> 0")}))


@query("summary_union", f"SELECT table_name AS label, n FROM ({_COUNTS}) c")
def summary_union(t):
    return quality.summary_union({n: t(n) for n in _TABLES})


@query("import_summary", "SELECT count(*) AS n_records, count(DISTINCT company_id) AS n_companies, count(*) FILTER (WHERE notes LIKE '%KGFA%') AS n_tagged FROM {facility} f")
def import_summary(t):
    return quality.import_summary(t("facility"), "company_id", "notes", "KGFA")
