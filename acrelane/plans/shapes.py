"""Domain tables derived from the driver's tables by integer arithmetic.

One text serves both engines: a name in braces is a driver table or another shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

SHAPES: dict[str, str] = {
    "facility": """
        SELECT s_suppkey AS facility_id, CAST(s_nationkey AS BIGINT) AS company_id, s_suppkey % 4 + 1 AS facility_type_id,
          s_name AS name, CASE WHEN s_suppkey % 6 = 0 THEN 'n/a' WHEN s_suppkey % 6 = 1 THEN NULL
            ELSE CAST(s_suppkey % 90 + 10 AS STRING) || CASE s_suppkey % 5 WHEN 0 THEN ' Co. Rd. ' WHEN 1 THEN '  County Rd ' WHEN 2 THEN ' C.R.' WHEN 3 THEN ' Co.Rd.' ELSE ' cr ' END || CAST(s_suppkey % 17 AS STRING) END AS address,
          CASE WHEN s_suppkey % 11 = 3 THEN NULL ELSE 'City ' || CAST(s_suppkey % 23 AS STRING) END AS city,
          'KS' AS state, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(67000 + s_suppkey % 900 AS STRING) END AS postal_code,
          CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '620-555-' || CAST(1000 + s_suppkey % 9000 AS STRING) END AS phone,
          CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 12 = 1 THEN 'http:/grain' || CAST(s_suppkey % 31 AS STRING) || '.example.com/' WHEN s_suppkey % 12 = 2 THEN 'http:///grain' || CAST(s_suppkey % 31 AS STRING) || '.example.com' WHEN s_suppkey % 12 = 3 THEN 'https://grain' || CAST(s_suppkey % 31 AS STRING) || '.example.com/' WHEN s_suppkey % 12 = 6 THEN 'HTTP://grain' || CAST(s_suppkey % 31 AS STRING) || '.example.com' WHEN s_suppkey % 4 = 1 THEN 'http://grain' || CAST(s_suppkey % 31 AS STRING) || '.example.com/bids/today'
            ELSE 'www.grain' || CAST(s_suppkey % 31 AS STRING) || '.example.com' END AS website,
          CASE WHEN s_suppkey % 7 = 0 THEN 'From KGFA list' END AS notes,
          CASE WHEN s_suppkey % 10 = 9 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
          CASE WHEN s_suppkey % 29 = 28 THEN NULL WHEN s_suppkey % 7 = 0 THEN -98E0 ELSE CAST((s_suppkey * 7919) % 7400 AS DOUBLE) / 1000E0 - 102E0 END AS lon,
          CASE WHEN s_suppkey % 29 = 28 THEN NULL WHEN s_suppkey % 7 = 0 THEN 385E-1 ELSE CAST((s_suppkey * 10473) % 3000 AS DOUBLE) / 1000E0 + 37E0 END AS lat
        FROM {supplier}""",
    "company": "SELECT CAST(n_nationkey AS BIGINT) AS company_id, CASE WHEN n_nationkey % 12 = 11 THEN '' ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'nation' || CAST(n_nationkey AS STRING) || '.example.com' ELSE 'https://www.nation' || CAST(n_nationkey AS STRING) || '.example.com/prices' END AS website FROM {nation}",
    "facility_type": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS facility_type_id, CASE WHEN r_regionkey = 3 THEN NULL ELSE r_name END AS name FROM {region}",
    "company_dup": "SELECT s_suppkey AS company_id, 'Grain ' || CAST(s_suppkey % 40 AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN ' Co.' WHEN s_suppkey % 3 = 1 THEN ', LLC' ELSE '' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'grain' || CAST(s_suppkey % 40 AS STRING) || '.example.com' END AS website, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE '620-555-' || CAST(1000 + s_suppkey % 7 AS STRING) END AS phone, CASE WHEN s_suppkey % 3 = 1 THEN 'Note ' || CAST(s_suppkey % 4 AS STRING) END AS notes FROM {supplier}",
    "parcels": """
        SELECT c_custkey AS id, '20' || CAST(100 + c_custkey % 105 AS STRING) AS geoid, CAST(c_custkey % 700 AS STRING) AS parcelnumb,
          CASE WHEN c_custkey % 50 = 7 THEN ' ' ELSE 'Owner ' || CAST(c_custkey % 300 AS STRING) END AS owner,
          CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 999 AS STRING) || ' Main St' END AS mailadd, 'Town ' || CAST(c_custkey % 60 AS STRING) AS mail_city, 'KS' AS mail_state2, CAST(67000 + c_custkey % 99 AS STRING) AS mail_zip,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 'Agricultural Use' WHEN c_mktsegment = 'MACHINERY' THEN 'Farm Homesite' WHEN c_custkey % 13 = 0 THEN NULL ELSE 'Other' END AS usedesc,
          CASE WHEN c_nationkey % 4 = 0 THEN ' Rush ' WHEN c_nationkey % 4 = 1 THEN 'NESS' WHEN c_nationkey % 4 = 2 THEN 'Trego' END AS county,
          CAST(CAST(c_custkey * 37 % 6400 AS DECIMAL(12,1)) / 10 AS DECIMAL(12,1)) AS ll_gisacre, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(CAST(c_custkey * 41 % 6400 AS DECIMAL(12,1)) / 10 AS DECIMAL(12,1)) END AS gisacre,
          CASE WHEN c_custkey % 97 = 5 THEN NULL ELSE CAST((c_custkey * 104729) % 7400 AS DOUBLE) / 1000E0 - 102E0 END AS lon,
          CASE WHEN c_custkey % 97 = 5 THEN NULL ELSE CAST((c_custkey * 7907) % 3000 AS DOUBLE) / 1000E0 + 37E0 END AS lat,
          'S' || CAST(c_custkey % 36 + 1 AS STRING) AS plss_section, '0' || CAST(c_custkey % 35 + 1 AS STRING) || 's' AS plss_township, CAST(c_custkey % 43 + 1 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN 'E' ELSE 'W' END AS plss_range
        FROM {customer}""",
    "crop_region": "SELECT CAST(n_nationkey AS BIGINT) AS region_id, n_name AS name, 'county' AS region_type FROM {nation}",
    "crop_type": "SELECT crop_idx AS crop_type_id, CAST(crop_idx * 7 + 1 AS BIGINT) AS cdl_code, 'Crop ' || CAST(crop_idx AS STRING) AS name, CASE WHEN crop_idx % 3 = 0 THEN 'Hay' ELSE 'Grain' END AS category, crop_idx % 3 <> 0 AS is_row_crop FROM (SELECT DISTINCT CAST(p_size % 8 AS BIGINT) AS crop_idx FROM {part}) t",
    "crop_acres": """
        SELECT CAST(c_nationkey AS BIGINT) AS region_id, CAST(p_size % 8 AS BIGINT) AS crop_type_id, CAST(year(o_orderdate) AS INT) AS year,
          sum(CAST(l_quantity AS DECIMAL(12,2))) AS acres, count(*) AS pixel_count
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
        GROUP BY c_nationkey, p_size % 8, year(o_orderdate)""",
    "pixels": "SELECT CAST(event_id % 100 AS INT) AS col_no, CAST(floor(event_id / 100) AS INT) AS row_no, CAST(CASE user_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 24 WHEN 4 THEN 111 WHEN 5 THEN 121 WHEN 6 THEN 176 WHEN 7 THEN 255 ELSE 4 END AS INT) AS code FROM {events}",
    "nodes": "SELECT p_partkey AS node, -99E0 + CAST(p_partkey % 40 AS DOUBLE) / 100E0 AS lon, 38E0 + CAST(floor(p_partkey / 40) AS DOUBLE) / 100E0 AS lat FROM {part}",
    "edges_one": """
        SELECT p_partkey AS src, p_partkey + 1 AS dst, 0 AS k, 800 + p_partkey * 37 % 900 AS length_m, p_size FROM {part} WHERE p_partkey % 40 <> 39 AND p_partkey + 1 IN (SELECT p_partkey FROM {part})
        UNION ALL SELECT p_partkey, p_partkey + 40, 0, 800 + p_partkey * 53 % 900, p_size FROM {part} WHERE p_partkey + 40 IN (SELECT p_partkey FROM {part})""",
    "edges": """
        SELECT src, dst, k, CAST(length_m AS DOUBLE) AS length_m, highway, surface FROM (
          SELECT src, dst, k, length_m, CASE p_size % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'unclassified' WHEN 2 THEN 'primary' WHEN 3 THEN 'track' ELSE 'motorway' END AS highway, CASE p_size % 3 WHEN 0 THEN 'gravel' WHEN 1 THEN 'dirt' END AS surface FROM {edges_one}
          UNION ALL
          SELECT dst, src, k, length_m, CASE p_size % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'unclassified' WHEN 2 THEN 'primary' ELSE 'track' END, CASE p_size % 3 WHEN 0 THEN 'gravel' WHEN 1 THEN 'dirt' END FROM {edges_one} WHERE p_size % 5 <> 4) t""",
    "sections": "SELECT p_partkey AS feature_id, CASE WHEN p_partkey % 17 = 0 THEN 'bad' ELSE 'S' || CAST(p_partkey % 36 + 1 AS STRING) || '-T' || CAST(p_partkey % 35 + 1 AS STRING) || 'S-R' || CAST(p_partkey % 43 + 1 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN 'E' ELSE 'W' END END AS label FROM {part}",
    "townships": "SELECT p_partkey AS feature_id, CASE WHEN p_partkey % 13 = 0 THEN 'T?' ELSE 'T' || CAST(p_partkey % 35 + 1 AS STRING) || 'S-R' || CAST(p_partkey % 43 + 1 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN 'E' ELSE 'W' END END AS label FROM {part}",
    "quarters": "SELECT p_partkey AS feature_id, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE lpad(CAST(p_partkey % 35 + 1 AS STRING), 2, '0') || 'S' || lpad(CAST(p_partkey % 43 + 1 AS STRING), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN 'E' ELSE 'W' END || lpad(CAST(p_partkey % 36 + 1 AS STRING), 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN 'NENW' ELSE 'SESW' END END AS label FROM {part}",
    "section_sites": "SELECT p_partkey AS feature_id, 'S' || CAST(p_partkey % 36 + 1 AS STRING) AS site_label, CASE WHEN p_partkey % 23 = 1 THEN NULL ELSE CAST((p_partkey * 3571) % 7400 AS DOUBLE) / 1000E0 - 102E0 END AS lon, CAST((p_partkey * 6469) % 3000 AS DOUBLE) / 1000E0 + 37E0 AS lat FROM {part}",
    "facility_service": "SELECT s_suppkey AS facility_id, s_suppkey % 5 AS service_id FROM {supplier} UNION ALL SELECT s_suppkey, (s_suppkey + 2) % 5 FROM {supplier} WHERE s_suppkey % 2 = 0",
    "service": "SELECT CAST(r_regionkey AS BIGINT) AS service_id, 'Service ' || r_name AS name FROM {region}",
    "facility_product": "SELECT DISTINCT l_suppkey AS facility_id, l_partkey % 9 AS product_id, 'SELL' AS flow_role FROM {lineitem} WHERE l_linenumber = 1",
    "product": "SELECT DISTINCT p_partkey % 9 AS product_id, 'Product ' || CAST(p_partkey % 9 AS STRING) AS name FROM {part}",
    "facility_mode": "SELECT s_suppkey AS facility_id, s_suppkey % 3 AS mode_id FROM {supplier}",
    "mode": "SELECT CAST(r_regionkey AS BIGINT) AS mode_id, 'Mode ' || r_name AS name FROM {region}",
    "staged": "SELECT c_custkey AS seq, ' ' || CAST(c_custkey % 700 AS STRING) || ' ' AS geoid, CASE WHEN c_custkey % 40 = 0 THEN '' ELSE 'P' || CAST(c_custkey % 900 AS STRING) END AS parcelnumb, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey % 5000 AS STRING) || '.5' END AS acres, CASE c_custkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' f ' WHEN 2 THEN 'true' WHEN 3 THEN 'maybe' WHEN 4 THEN '0' END AS homestead, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'A' || CAST(c_custkey AS STRING) END AS alt_id, 'B' || CAST(c_custkey AS STRING) AS main_id, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '19' || CAST(10 + c_custkey % 90 AS STRING) END AS yearbuilt FROM {customer}",
    "directory": "SELECT c_custkey AS seq, 'Coop ' || CAST(c_custkey % 120 AS STRING) AS company, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Town ' || CAST(c_custkey % 35 AS STRING) END AS city, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'KS' END AS state, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 400 AS STRING) || ' Elm' END AS street, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE CAST(66000 + c_custkey % 999 AS STRING) END AS zip, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'coop' || CAST(c_custkey % 120 AS STRING) || '.example.com' END AS website, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '785-555-' || CAST(1000 + c_custkey % 9000 AS STRING) END AS phone, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'Person ' || CAST(c_custkey % 200 AS STRING) END AS contact, 'https://list.example.com/' || CAST(c_custkey % 1000 AS STRING) AS detail_url FROM {customer}",
    "plants": "SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Plant ' || CAST(s_suppkey % 50 AS STRING) END AS plant_name, 'Ethanol ' || CAST(s_suppkey % 20 AS STRING) AS company, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN ' NE ' ELSE 'IA' END AS location, CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE 'Town ' || CAST(s_suppkey % 9 AS STRING) END AS city, CASE WHEN s_suppkey % 11 = 0 THEN 'SD' END AS state, CASE WHEN s_suppkey % 10 = 0 THEN ' Idle ' END AS notes, CASE WHEN s_suppkey % 15 = 0 THEN 'Sold' END AS description, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Corn' END AS feedstock, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'D6' END AS rins, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE CAST(s_suppkey % 120 AS STRING) END AS capacity FROM {supplier}",
    "fac_dup": "SELECT c_custkey AS facility_id, CAST(floor(c_custkey / 6) AS BIGINT) AS company_id, 'Elevator ' || CAST(CAST(floor(c_custkey / 6) % 97 AS INT) AS STRING) || CASE WHEN floor(c_custkey / 6) % 7 = 3 THEN CASE WHEN c_custkey % 2 = 0 THEN ' Inc.' ELSE ', LLC' END WHEN c_custkey % 3 = 0 THEN ' East' ELSE '' END AS name, CASE WHEN c_custkey % 5 = 0 OR floor(c_custkey / 6) % 4 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN CAST(CAST(floor(c_custkey / 6) % 11 + 10 AS INT) AS STRING) || CASE WHEN c_custkey % 4 = 0 THEN ' C.R. 5' ELSE ' Co. Rd. 5' END ELSE CAST(CAST(floor(c_custkey / 6) % 11 + 10 AS INT) AS STRING) || '  county Rd 5' END AS address, 'City ' || CAST(CAST(floor(c_custkey / 6) % 7 AS INT) AS STRING) AS city, 'KS' AS state, CASE WHEN c_custkey % 12 = 9 THEN NULL ELSE CAST(67000 + CAST(floor(c_custkey / 6) % 9 AS INT) AS STRING) END AS postal_code, CASE WHEN c_custkey % 4 = 0 OR floor(c_custkey / 6) % 7 = 3 THEN NULL ELSE '620-555-' || CAST(1000 + c_custkey % 9 AS STRING) END AS phone, CASE WHEN c_custkey % 6 = 0 OR floor(c_custkey / 6) % 7 = 3 THEN NULL ELSE 'f' || CAST(c_custkey % 9 AS STRING) || '.example.com' END AS website, CASE WHEN c_custkey % 3 = 1 AND floor(c_custkey / 6) % 7 <> 3 THEN 'n  ' || CAST(c_custkey % 5 AS STRING) END AS notes, CASE WHEN c_custkey % 5 = 2 THEN 'Bldg ' || CAST(c_custkey % 3 AS STRING) END AS address2, CASE WHEN c_custkey % 5 = 2 AND floor(c_custkey / 6) % 7 <> 3 THEN 'bin' || CAST(c_custkey % 8 AS STRING) || '@example.com' END AS email, CASE WHEN c_custkey % 7 = 2 AND floor(c_custkey / 6) % 7 <> 3 THEN 'Rail  served ' || CAST(c_custkey % 3 AS STRING) END AS description, CASE WHEN c_custkey % 9 = 2 THEN NULL ELSE c_custkey % 9 = 5 AND floor(c_custkey / 6) % 7 <> 3 END AS geom_from_address, CASE WHEN c_custkey % 10 = 9 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, CASE WHEN c_custkey % 8 = 0 OR floor(c_custkey / 6) % 7 = 3 THEN NULL ELSE -98E0 + CAST(c_custkey % 40 AS DOUBLE) / 1000E0 END AS lon, CASE WHEN c_custkey % 8 IN (0, 3) OR floor(c_custkey / 6) % 7 = 3 THEN NULL ELSE 38E0 + CAST(c_custkey % 30 AS DOUBLE) / 1000E0 END AS lat FROM {customer}",
    "bid_pages": """SELECT page_id, url, html || CASE WHEN page_id % 9 = 0 THEN '<p>Cash Bids: corn $4.56</p>' WHEN page_id % 9 = 1 THEN '<table><tr><td>Grain Prices</td><td>Milo 4.10 / bu</td></tr></table>'
          WHEN page_id % 9 = 2 THEN '<p>New Crop bid for sorghum, 5.50 per Bushel</p>' WHEN page_id % 9 = 3 THEN '<p>Daily price sheet: wheat price and grain</p>' WHEN page_id % 9 = 4 THEN '<p>grain market price</p>' ELSE '' END AS html FROM {pages}""",
    "repeats": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(12,2)) AS qty, CAST(l_extendedprice AS DECIMAL(14,2)) AS price FROM {lineitem}",
}


class _Names(dict):
    def __init__(self, table):
        super().__init__()
        self.table = table

    def __missing__(self, name: str) -> str:
        if name in SHAPES:
            return f"({SHAPES[name].format_map(self)})"
        if name in TABLES:
            return self.table(name)
        raise KeyError(name)


def duck(text: str) -> str:
    """DuckDB SQL of a text with shapes in braces."""
    # a derived table needs a name in some dialects; every use gives its own
    return text.format_map(_Names(lambda t: t))


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shape, or a driver's table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SHAPES[name].format_map(_Names(lambda t: f"parquet.`{sf_dir}/{t}.parquet`")))
