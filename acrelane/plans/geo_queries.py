"""Queries on geometry, parcels and survey keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrelane.functions import geo, survey
from acrelane.functions.geo import geodesic_miles_sql
from acrelane.functions.text import norm_join_key
from acrelane.operators import grid, parcels, sections
from acrelane.plans.registry import query

MILES = geodesic_miles_sql
#: Parcels x active type-1 facilities of some companies within eight miles, for oracles.
_PAIRS = f"""(SELECT p.*, f.facility_id, f.name AS facility_name, f.company_id, {MILES('p.lon', 'p.lat', 'f.lon', 'f.lat')} AS miles
  FROM {{parcels}} p JOIN {{facility}} f ON abs(p.lat - f.lat) < 0.2 AND abs(p.lon - f.lon) < 0.2
  WHERE f.status = 'ACTIVE' AND f.facility_type_id = 1 AND {MILES('p.lon', 'p.lat', 'f.lon', 'f.lat')} <= 8)"""


@query("within_distance_join", f"SELECT id, facility_id, facility_name, company_id, round(miles, 6) AS miles FROM {_PAIRS} x")
def within_distance_join(t):
    return parcels.facility_parcels(t("parcels").select("id", "lon", "lat"), t("facility")).select("id", "facility_id", "facility_name", "company_id", F.round("miles", 6).alias("miles"))


_CUSTOMERS = "max(mailadd) AS mailadd, max(mail_city) AS mail_city, max(mail_state2) AS mail_state2, max(mail_zip) AS mail_zip, CAST(sum(coalesce(ll_gisacre, 0)) AS DOUBLE) AS acres, count(*) AS n_parcels"


@query("customers_by_facility", f"SELECT facility_name, owner, {_CUSTOMERS} FROM {_PAIRS} x WHERE trim(coalesce(owner, '')) <> '' GROUP BY facility_name, owner")
def customers_by_facility(t):
    return parcels.facility_customers(t("parcels"), t("facility")).withColumn("acres", F.col("acres").cast("double"))


@query("customers_by_facility_ag", f"SELECT facility_id, facility_name, owner, {_CUSTOMERS} FROM {_PAIRS} x WHERE trim(coalesce(owner, '')) <> '' AND usedesc IN ('Agricultural Use', 'Farm Homesite') GROUP BY facility_id, facility_name, owner")
def customers_by_facility_ag(t):
    return parcels.facility_customers(t("parcels"), t("facility"), ag=True).withColumn("acres", F.col("acres").cast("double"))


@query("point_radius", f"SELECT facility_id, name, round({MILES('lon', 'lat', '-98.5', '38.3')}, 6) AS miles FROM {{facility}} f WHERE {MILES('lon', 'lat', '-98.5', '38.3')} <= 50")
def point_radius(t):
    return grid.point_radius(t("facility"), -98.5, 38.3, 50).select("facility_id", "name", F.round("miles", 6).alias("miles")).orderBy("miles", "facility_id")


@query("within_distance_anchor", f"SELECT p.id, p.usedesc, round({MILES('p.lon', 'p.lat', 'a.lon', 'a.lat')}, 6) AS miles FROM {{parcels}} p, (SELECT lon, lat FROM {{parcels}} q WHERE id = 17) a WHERE p.usedesc IN ('Agricultural Use', 'Farm Homesite') AND {MILES('p.lon', 'p.lat', 'a.lon', 'a.lat')} <= 40")
def within_distance_anchor(t):
    return parcels.within_distance_anchor(t("parcels"), 17, 40, ag=True).select("id", "usedesc", F.round("miles", 6).alias("miles"))


def fields(t, columns=()):
    own = t("parcels").filter("id % 10 = 3 and lon is not null")  # the fields of the haul job: parcels of one kind
    return own.select(F.col("id").alias("field_id"), F.col("owner").alias("owner_name"), "lon", "lat", *columns)


def stops(t):
    return t("facility").filter("status = 'ACTIVE' and facility_type_id = 1 and lon is not null").select("facility_id", F.col("name").alias("facility_name"), F.col("lon").alias("facility_lon"), F.col("lat").alias("facility_lat"))


@query("candidate_pairs", f"""WITH p AS (SELECT id AS field_id, lon, lat FROM {{parcels}} q WHERE lon IS NOT NULL),
 f AS (SELECT facility_id, lon, lat FROM {{facility}} q WHERE status = 'ACTIVE' AND facility_type_id = 1 AND lon IS NOT NULL),
 x AS (SELECT field_id, facility_id, {MILES('p.lon', 'p.lat', 'f.lon', 'f.lat')} AS d FROM p JOIN f ON abs(p.lat - f.lat) < 0.4 AND abs(p.lon - f.lon) < 0.5)
 SELECT p.field_id, x.facility_id, round(x.d, 6) AS crow_miles, CASE WHEN x.d IS NULL THEN 'no_facility_within_prefilter_miles' END AS status FROM p LEFT JOIN x ON p.field_id = x.field_id AND x.d <= 20""")
def candidate_pairs(t):
    own = t("parcels").filter("lon is not null").select(F.col("id").alias("field_id"), "lon", "lat")
    return grid.candidate_pairs(own, stops(t).drop("facility_name"), 20).select("field_id", "facility_id", F.round("crow_miles", 6).alias("crow_miles"), "status")


_NEAREST = f"""WITH f AS (SELECT facility_id, lon, lat FROM {{facility}} q WHERE facility_type_id = 1 AND (status = 'ACTIVE' OR status IS NULL) AND lon IS NOT NULL),
 s AS (SELECT feature_id, lon, lat FROM {{section_sites}} q WHERE lon IS NOT NULL),
 x AS (SELECT s.feature_id, f.facility_id, s.lon AS sx, s.lat AS sy, f.lon AS fx, f.lat AS fy, row_number() OVER (PARTITION BY s.feature_id ORDER BY pow(s.lon - f.lon, 2) + pow(s.lat - f.lat, 2), f.facility_id) AS rn FROM s, f)
 SELECT feature_id, facility_id, round({MILES('sx', 'sy', 'fx', 'fy')}, 6) AS miles, 'LINESTRING (' || printf('%.6f %.6f, %.6f %.6f', sx, sy, fx, fy) || ')' AS line FROM x WHERE rn = 1"""


@query("nearest_neighbor", _NEAREST)
def nearest_neighbor(t):
    own = t("facility").filter("facility_type_id = 1 and (status = 'ACTIVE' or status is null)").select("facility_id", F.col("lon").alias("facility_lon"), F.col("lat").alias("facility_lat"))
    sites = t("section_sites")
    got = grid.nearest(sites, own, "feature_id", "facility_id").drop("d2").join(sites.select("feature_id", "lon", "lat"), "feature_id")
    line = geo.line_wkt(geo.connector_line(F.col("lon"), F.col("lat"), F.col("facility_lon"), F.col("facility_lat")))
    return got.select("feature_id", "facility_id", F.round(geo.geodesic_miles("lon", "lat", "facility_lon", "facility_lat"), 6).alias("miles"), line.alias("line"))


@query("node_snap", """WITH p AS (SELECT id AS field_id, lon, lat FROM {parcels} q),
 n AS (SELECT node, lon, lat FROM {nodes} q), k AS (SELECT cos(radians(avg(lat))) AS c FROM n),
 x AS (SELECT field_id, node, row_number() OVER (PARTITION BY field_id ORDER BY pow(p.lon * c - n.lon * c, 2) + pow(p.lat - n.lat, 2), node) AS rn FROM p, n, k WHERE p.lon IS NOT NULL) SELECT p.field_id, x.node FROM p LEFT JOIN x ON p.field_id = x.field_id AND rn = 1""")
def node_snap(t):
    own = t("parcels").select(F.col("id").alias("field_id"), "lon", "lat")
    return grid.snap_nodes(own, t("nodes"), "field_id").select("field_id", "node")


@query("geodesic_miles", f"SELECT id, round({MILES('lon', 'lat', '-98.5', '38.5')}, 6) AS miles FROM {{parcels}} p")
def geodesic_miles(t):
    return parcels.distance_between(t("parcels").withColumns({"_x": F.lit(-98.5), "_y": F.lit(38.5)}), "lon", "lat", "_x", "_y").select("id", F.round("miles", 6).alias("miles"))


@query("mercator_meters", "SELECT id, round(sqrt(pow((radians(lon) - radians(-98.5)) * 6378137e0, 2) + pow(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0 - ln(tan(pi() / 4 + radians(38.5) / 2)) * 6378137e0, 2)), 3) AS metres FROM {parcels} p")
def mercator_meters(t):
    return t("parcels").select("id", F.round(geo.mercator_metres(F.col("lon"), F.col("lat"), F.lit(-98.5), F.lit(38.5)), 3).alias("metres"))


@query("connector_line", "SELECT id, CASE WHEN lon IS NOT NULL THEN 'LINESTRING (' || printf('%.6f %.6f, %.6f %.6f', lon, lat, lon + 0.5, lat + 0.25) || ')' END AS line FROM {parcels} p")
def connector_line(t):
    line = geo.connector_line(F.col("lon"), F.col("lat"), F.col("lon") + 0.5, F.col("lat") + 0.25)
    return t("parcels").select("id", F.when(F.col("lon").isNotNull(), geo.line_wkt(line)).alias("line"))


@query("point_from_lonlat", "SELECT facility_id, lon AS x, lat AS y, lon IS NOT NULL AND lat IS NOT NULL AS placed FROM {facility} f")
def point_from_lonlat(t):
    rows = t("facility").withColumn("p", geo.point(F.col("lon"), F.col("lat")))
    return rows.select("facility_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p").isNotNull().alias("placed"))


_MOVED = "(SELECT facility_id, lon, lat, CASE WHEN facility_id % 8 = 1 THEN NULL WHEN facility_id % 8 = 2 THEN lon + 0.01 ELSE lon END AS x, CASE WHEN facility_id % 8 = 1 THEN NULL WHEN facility_id % 16 = 2 THEN lat + 0.01 ELSE lat END AS y FROM {facility} f)"


def moved(t):
    i = F.col("facility_id")
    x = F.when(i % 8 == 1, None).when(i % 8 == 2, F.col("lon") + 0.01).otherwise(F.col("lon"))
    y = F.when(i % 8 == 1, None).when(i % 16 == 2, F.col("lat") + 0.01).otherwise(F.col("lat"))
    return t("facility").select("facility_id", "lon", "lat", x.alias("x"), y.alias("y"))


@query("geom_mismatch", f"SELECT facility_id, kind FROM (SELECT facility_id, CASE WHEN x IS NULL OR y IS NULL THEN 'MISSING' WHEN abs(x - lon) > 1e-6 OR abs(y - lat) > 1e-6 THEN 'MISMATCH' END AS kind FROM {_MOVED} m WHERE lon IS NOT NULL AND lat IS NOT NULL) k WHERE kind IS NOT NULL")
def geom_mismatch(t):
    return parcels.geom_mismatch(moved(t)).select("facility_id", "kind")


@query("geom_mismatch_counts", f"SELECT count(*) AS total, count(*) FILTER (WHERE lon IS NOT NULL) AS with_coordinates, count(*) FILTER (WHERE lon IS NOT NULL AND x IS NULL) AS missing, count(*) FILTER (WHERE x IS NOT NULL AND (abs(x - lon) > 1e-6 OR abs(y - lat) > 1e-6)) AS mismatched FROM {_MOVED} m")
def geom_mismatch_counts(t):
    return parcels.geom_mismatch_counts(moved(t))


@query("bad_latlon", "SELECT facility_id, lon IS NULL OR lat IS NULL OR abs(lat * 2.3) > 90 AS bad FROM {facility} f")
def bad_latlon(t):
    return t("facility").select("facility_id", geo.bad_latlon(F.col("lat") * 2.3, F.col("lon")).alias("bad"))


# squares with a square hole off the middle: the centroid follows from the two areas
@query("polygon_centroid", "SELECT id, round((lon * 16 - (lon + 1) * 1) / 15, 6) AS lon, round((lat * 16 - (lat - 1) * 1) / 15, 6) AS lat FROM {parcels} p")
def polygon_centroid(t):
    def square(x, y, half):
        return F.array(*[F.struct((x + dx * half).alias("x"), (y + dy * half).alias("y")) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])

    rings = F.array(square(F.col("lon"), F.col("lat"), 2.0), square(F.col("lon") + 1, F.col("lat") - 1, 0.5))
    rows = t("parcels").withColumn("c", geo.polygon_centroid(rings))
    return rows.select("id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query("expand_bbox", "SELECT round(w - d, 6) AS west, round(s - 23 / 69e0, 6) AS south, round(e + d, 6) AS east, round(n + 23 / 69e0, 6) AS north FROM (SELECT *, 23 / (69e0 * greatest(0.2, cos(radians((s + n) / 2)))) AS d FROM (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM {parcels} p) b) c")
def expand_bbox(t):
    box = geo.expand_bbox(t("parcels"), 5, max_miles=20)
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@query("layer_extent", "SELECT round(w - (e - w) * 0.1, 6) AS west, round(s - (n - s) * 0.1, 6) AS south, round(e + (e - w) * 0.1, 6) AS east, round(n + (n - s) * 0.1, 6) AS north FROM (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM {facility} f) b")
def layer_extent(t):
    box = geo.layer_extent(t("facility"))
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@query("plss_township_parse", r"""SELECT feature_id, CAST(regexp_extract(label, '^T([0-9]+)', 1) AS INT) AS township, regexp_extract(label, '([NS])-', 1) AS township_dir, CAST(regexp_extract(label, 'R([0-9]+)', 1) AS INT) AS range, right(label, 1) AS range_dir, replace(label, '-', ' ') AS township_key FROM {townships} s WHERE label LIKE 'T%-R%'""")
def plss_township_parse(t):
    return survey.parse_township(t("townships")).drop("label")


@query("plss_section_parse", r"""SELECT feature_id, CAST(regexp_extract(label, '^S([0-9]+)', 1) AS INT) AS section, CAST(regexp_extract(label, 'T([0-9]+)', 1) AS INT) AS township, regexp_extract(label, '([NS])-R', 1) AS township_dir, CAST(regexp_extract(label, 'R([0-9]+)', 1) AS INT) AS range, right(label, 1) AS range_dir, replace(label, '-', ' ') AS plss_key FROM {sections} s WHERE label <> 'bad'""")
def plss_section_parse(t):
    return survey.parse_section(t("sections")).drop("label")


@query("plss_qq_parse", r"""SELECT feature_id, substr(label, 1, 2) AS township, substr(label, 3, 1) AS township_dir, substr(label, 4, 2) AS range, substr(label, 6, 1) AS range_dir, substr(label, 7, 2) AS section, substr(label, 9, 4) AS aliquot, substr(label, 9, 2) AS quarter, substr(label, 11, 2) AS sixteenth,
 'S' || CAST(CAST(substr(label, 7, 2) AS INT) AS VARCHAR) || ' T' || substr(label, 1, 3) || ' R' || substr(label, 4, 3) AS section_key,
 'S' || CAST(CAST(substr(label, 7, 2) AS INT) AS VARCHAR) || ' T' || substr(label, 1, 3) || ' R' || substr(label, 4, 3) || ' ' || substr(label, 9, 2) || ' ' || substr(label, 11, 2) AS quarter_key FROM {quarters} s WHERE label <> ''""")
def plss_qq_parse(t):
    return survey.parse_quarter(t("quarters")).drop("label")


_PKEY = "'S' || regexp_replace(plss_section, '[^0-9]', '', 'g') || '-T' || upper(ltrim(plss_township, '0')) || '-R' || upper(ltrim(plss_range, '0'))"


@query("plss_key_normalize", f"SELECT id, {_PKEY} AS section_key FROM {{parcels}} p")
def plss_key_normalize(t):
    return t("parcels").select("id", survey.parcel_section_key(F.col("plss_section"), F.col("plss_township"), F.col("plss_range")).alias("section_key"))


@query("join_key_normalize", "SELECT feature_id, regexp_replace(upper(trim(' ' || lower(label) || '_x ')), '[ _-]+', '', 'g') AS join_key FROM {sections} s")
def join_key_normalize(t):
    return t("sections").select("feature_id", norm_join_key(F.concat(F.lit(" "), F.lower("label"), F.lit("_x "))).alias("join_key"))


@query("section_sites_from_parcels", f"""WITH p AS (SELECT {_PKEY} AS section_key, lon, lat FROM {{parcels}} p0 WHERE lon IS NOT NULL AND lat IS NOT NULL), s AS (SELECT label AS section_key, min(feature_id) AS feature_id FROM {{sections}} s0 WHERE label <> 'bad' GROUP BY label)
 SELECT s.feature_id, section_key, replace(section_key, '-', ' ') AS plss_key, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS n_parcels FROM p JOIN s USING (section_key) GROUP BY s.feature_id, section_key""")
def section_sites_from_parcels(t):
    got = sections.section_sites(t("parcels"), t("sections"))
    return got.select("feature_id", "section_key", "plss_key", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "n_parcels")


_LAYER = "(SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN ' ' || lower(lab) || ' ' WHEN c_custkey % 7 = 1 THEN 'zz' ELSE lab END AS site_key FROM (SELECT c_custkey, 'S' || CAST(c_custkey % 36 + 1 AS STRING) || '-T' || CAST(c_custkey % 35 + 1 AS STRING) || 'S-R' || CAST(c_custkey % 43 + 1 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN 'E' ELSE 'W' END AS lab FROM {customer}) c)"


def _layer(t):
    k = F.col("c_custkey")
    label = F.concat(F.lit("S"), (k % 36 + 1).cast("string"), F.lit("-T"), (k % 35 + 1).cast("string"), F.lit("S-R"), (k % 43 + 1).cast("string"), F.when(k % 2 == 0, "E").otherwise("W"))
    return t("customer").select(k.alias("row_id"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower(label), F.lit(" "))).when(k % 7 == 1, "zz").otherwise(label).alias("site_key"))


@query("section_key_join", f"""WITH s AS (SELECT min(feature_id) AS feature_id, regexp_replace(upper(trim(label)), '[ _-]+', '', 'g') AS k FROM {{sections}} s0 GROUP BY 2) SELECT row_id, s.feature_id FROM {_LAYER} l LEFT JOIN s ON regexp_replace(upper(trim(site_key)), '[ _-]+', '', 'g') = s.k""")
def section_key_join(t):
    return sections.join_sections(_layer(t), t("sections").select("feature_id", F.col("label").alias("section_key")), "site_key", ["section_key"]).select("row_id", "feature_id")


@query("section_id_join", "SELECT feature_id, site_id, feature_id IS NOT NULL AS matched FROM (SELECT a.feature_id, s.feature_id + 3 AS site_id FROM {section_sites} s LEFT JOIN {sections} a ON s.feature_id + 3 = a.feature_id) x")
def section_id_join(t):
    pages = t("section_sites").select((F.col("feature_id") + 3).alias("site_id"), "lon", "lat")
    return sections.join_section_ids(pages, t("sections"), "site_id").select("feature_id", "site_id", "matched")


@query("site_enrich", "SELECT s.feature_id, s.site_label, CASE WHEN k.label <> 'bad' THEN replace(k.label, '-', ' ') ELSE s.site_label END AS plss_key FROM {section_sites} s LEFT JOIN {sections} k USING (feature_id)")
def site_enrich(t):
    keys = survey.parse_section(t("sections")).select("feature_id", "plss_key")
    base = t("section_sites").select("feature_id", F.col("site_label").alias("plss_key"))
    return sections.enrich_sites(t("section_sites").select("feature_id", "site_label"), keys, base)


@query("haul_parcel_filter", "SELECT id, usedesc, county FROM {parcels} p WHERE lon IS NOT NULL AND usedesc ILIKE 'Agricultural%' AND lower(trim(coalesce(usedesc, ''))) NOT IN ('other') AND greatest(coalesce(gisacre, 0), coalesce(ll_gisacre, 0)) >= 200 AND lower(trim(county)) IN ('rush', 'ness')")
def haul_parcel_filter(t):
    return parcels.haul_parcel_filter(t("parcels"), 200, True, [" Other "], ["Rush", "ness"]).select("id", "usedesc", "county")


@query("haul_count", "SELECT count(*) AS n_parcels, CAST(ceil(count(*) / 48e0) AS BIGINT) AS per_slice FROM {parcels} p WHERE lon IS NOT NULL AND greatest(coalesce(gisacre, 0), coalesce(ll_gisacre, 0)) >= 30")
def haul_count(t):
    return parcels.haul_count(t("parcels"), 48, min_acres=30)


@query("bbox_filter", "SELECT id FROM {parcels} p WHERE lon BETWEEN -100 AND -98 AND lat BETWEEN 38 AND 39")
def bbox_filter(t):
    return parcels.bbox_filter(t("parcels"), -100, 38, -98, 39).select("id")


@query("facility_candidate_filter", "SELECT facility_id, 'all' AS mode FROM {facility} f WHERE status = 'ACTIVE' AND lon IS NOT NULL UNION ALL SELECT facility_id, 'plains' FROM {facility} f WHERE status = 'ACTIVE' AND facility_type_id = 1 AND lon BETWEEN -103.5 AND -94 AND lat BETWEEN 36 AND 40.5 UNION ALL SELECT facility_id, 'state' FROM {facility} f WHERE status = 'ACTIVE' AND facility_type_id = 1 AND lon BETWEEN -102.4 AND -94 AND lat BETWEEN 36.85 AND 40.3")
def facility_candidate_filter(t):
    out = None
    for mode in ("all", "plains", "state"):
        part = parcels.facility_candidates(t("facility"), 1, mode).select("facility_id", F.lit(mode).alias("mode"))
        out = part if out is None else out.unionAll(part)
    return out


@query("ag_use_filter", "SELECT id, usedesc FROM {parcels} p WHERE usedesc IN ('Agricultural Use', 'Farm Homesite')")
def ag_use_filter(t):
    return parcels.ag_use(t("parcels")).select("id", "usedesc")


@query("hash_slice", "SELECT id FROM (SELECT id - 500 AS id FROM {parcels} p) x WHERE ((id % 48) + 48) % 48 = 7")
def hash_slice(t):
    return parcels.hash_slice(t("parcels").select((F.col("id") - 500).alias("id")), "id", 48, 7)


@query("latitude_band", "WITH b AS (SELECT min(lat) AS lo, max(lat) - min(lat) AS span FROM {parcels} q) SELECT id, lat FROM {parcels} p, b WHERE least(floor((lat - lo) / span * 8), 7) = 7")
def latitude_band(t):
    return parcels.latitude_band(t("parcels").select("id", "lat"), 7, 8)


@query("valid_coordinates", "SELECT id FROM {parcels} p WHERE lon IS NOT NULL AND lat IS NOT NULL")
def valid_coordinates(t):
    return parcels.valid_coordinates(t("parcels")).select("id")


@query("parcel_sample", "SELECT id, owner FROM {parcels} p WHERE usedesc IN ('Agricultural Use', 'Farm Homesite') ORDER BY id LIMIT 25")
def parcel_sample(t):
    return parcels.first_n(parcels.ag_use(t("parcels")), "id", 25).select("id", "owner")


@query("qgis_row_id", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, price) AS feature_no, l_orderkey, l_linenumber FROM {repeats} r")
def qgis_row_id(t):
    return parcels.with_feature_id(t("repeats"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "price"]).select("feature_no", "l_orderkey", "l_linenumber")
