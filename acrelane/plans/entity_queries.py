"""Queries on duplicate companies and facilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrelane.functions.text import text_fold
from acrelane.operators import entities
from acrelane.plans.facility_queries import CLEAN_STREET, COMPANY_KEY
from acrelane.plans.registry import query


def sql_text(c):
    return f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


def sql_fold(texts):
    """Fold of a DuckDB list of texts, white space collapsed first; the later of two where it contains the earlier."""
    rule = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    kept = f"list_filter(list_transform({texts}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x IS NOT NULL AND x <> '')"
    step = f"CASE WHEN contains(lower(b), lower(a)) THEN b WHEN contains(lower(a), lower(b)) THEN a ELSE a || {rule} || b END"
    return f"CASE WHEN len({kept}) > 0 THEN list_reduce({kept}, lambda a, b: {step}) END"


@query("text_fold", f"SELECT c_nationkey AS id, {sql_fold('list(t ORDER BY c_custkey)')} AS folded FROM (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN ' note   ' || CAST(c_custkey % 6 AS VARCHAR) ELSE 'Note ' || CAST(c_custkey % 30 AS VARCHAR) END AS t FROM {{customer}} c) x GROUP BY c_nationkey")
def text_fold_query(t):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, None).when(k % 4 == 1, F.concat(F.lit(" note   "), (k % 6).cast("string"))).otherwise(F.concat(F.lit("Note "), (k % 30).cast("string")))
    rows = t("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), text.alias("t")))).alias("xs"))
    return rows.select(F.col("c_nationkey").alias("id"), text_fold(F.transform("xs", lambda x: x["t"])).alias("folded"))


def _filled(c, w):
    return f"CASE WHEN trim({c}) <> '' THEN {w} ELSE 0 END"


_COMPANIES = f"(SELECT *, {COMPANY_KEY} AS key, {_filled('name', 3)} + {_filled('website', 2)} + {_filled('phone', 2)} + {_filled('notes', 2)} AS score FROM {{company_dup}} c)"
_ORDER = "ORDER BY score DESC, company_id"
# the base is first, the others follow by id
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY key {_ORDER}) > 1 AS other FROM {_COMPANIES} c WHERE key <> '')"


def _kept(c):
    return f"coalesce(CASE WHEN {sql_text(f'any_value({c}) FILTER (WHERE NOT other)')} IS NOT NULL THEN any_value({c}) FILTER (WHERE NOT other) END, first({sql_text(c)} ORDER BY company_id) FILTER (WHERE other AND {sql_text(c)} IS NOT NULL), any_value({c}) FILTER (WHERE NOT other)) AS {c}"


_PROPOSED = f"(SELECT key, any_value(company_id) FILTER (WHERE NOT other) AS base_id, list(company_id ORDER BY company_id) AS member_ids, any_value(name) FILTER (WHERE NOT other) AS name, {_kept('website')}, {_kept('phone')}, {sql_fold('list(notes ORDER BY other, company_id)')} AS notes FROM {_RANKED} c GROUP BY key HAVING count(*) > 1)"


@query("company_merge_proposal", f"SELECT key, base_id, array_to_string(member_ids, ',') AS members, name, website, phone, notes FROM {_PROPOSED} p")
def company_merge_proposal(t):
    return entities.propose_companies(t("company_dup")).select("key", "base_id", F.array_join("member_ids", ",").alias("members"), "name", "website", "phone", "notes")


_TRIVIAL = " AND ".join(f"count(DISTINCT coalesce({sql_text(c)}, '')) = 1 AND count({sql_text(c)}) > 0" for c in ("website", "phone", "notes"))


@query("trivial_merge_flag", f"SELECT key, ({_TRIVIAL}) AND count(DISTINCT name) > 1 AS trivial FROM (SELECT company_id, key, name, coalesce(website, 'x' || key) AS website, 'p' AS phone, coalesce(notes, CASE WHEN company_id % 2 = 0 THEN 'Note 1' ELSE 'Note 2' END) AS notes FROM {_COMPANIES} c) d WHERE key <> '' GROUP BY key HAVING count(*) > 1")
def trivial_merge_flag(t):
    from acrelane.functions.text import norm_company

    c = t("company_dup").withColumns({"website": F.coalesce("website", F.concat(F.lit("x"), norm_company(F.col("name")))), "phone": F.lit("p"), "notes": F.coalesce("notes", F.when(F.col("company_id") % 2 == 0, "Note 1").otherwise("Note 2"))})
    return entities.trivial_companies(c)


_GROUPS = f"""(WITH a AS (SELECT *, lower({CLEAN_STREET}) AS street, trim(lower(coalesce(city, ''))) AS c1, trim(upper(coalesce(state, ''))) AS s1, trim(coalesce(postal_code, '')) AS z1 FROM {{fac_dup}} f WHERE status = 'ACTIVE' AND company_id IS NOT NULL),
 b AS (SELECT *, CASE WHEN street || c1 || s1 || z1 <> '' THEN concat_ws('|', 'a', company_id, street, c1, s1, z1) END AS ka,
  CASE WHEN c1 <> '' AND s1 <> '' AND {sql_text('name')} IS NOT NULL THEN concat_ws('|', 'n', company_id, lower({sql_text('name')}), lower({sql_text('city')}), upper({sql_text('state')})) END AS kn FROM a),
 c AS (SELECT *, ka IS NOT NULL AND count(*) OVER (PARTITION BY ka) > 1 AS ina FROM b),
 d AS (SELECT *, kn IS NOT NULL AND count(*) OVER (PARTITION BY kn) > 1 AND NOT bool_or(ina) OVER (PARTITION BY kn) AS inn FROM c)
 SELECT *, CASE WHEN ina THEN ka ELSE kn END AS group_key, CASE WHEN ina THEN 'address' ELSE 'name' END AS kind FROM d WHERE ina OR inn)"""


@query("dup_groups", f"SELECT facility_id, group_key, kind FROM {_GROUPS} g")
def dup_groups(t):
    return entities.duplicate_groups(t("fac_dup")).select("facility_id", "group_key", "kind")


# a field with two values is a difference, a missing value is none but in what a merge sets
_ONE_VALUE = " AND ".join([f"count(DISTINCT {sql_text(c)}) <= 1" for c in ("address", "address2", "city", "state", "postal_code", "website", "phone", "email", "description", "notes")] + ["count(DISTINCT lat) <= 1", "count(DISTINCT lon) <= 1", "count(DISTINCT status) = 1", "count(DISTINCT geom_from_address) = 1"])


@query("trivial_facility_flag", f"SELECT group_key, {_ONE_VALUE} AND count(DISTINCT {sql_text('name')}) > 1 AND count(nullif(name, '')) > 1 AND count(DISTINCT nullif({COMPANY_KEY}, '')) = 1 AS trivial FROM (SELECT * REPLACE (CASE WHEN company_id % 7 = 3 THEN '5 Mill' ELSE address END AS address) FROM {_GROUPS} g) h GROUP BY group_key")
def trivial_facility_flag(t):
    groups = entities.duplicate_groups(t("fac_dup"))
    return entities.trivial_facilities(groups.withColumn("address", F.when(F.col("company_id") % 7 == 3, "5 Mill").otherwise(F.col("address"))))


# distances within a group differ by multiples of thousandths of a degree; the fold is checked by a recursive query
_XY = "(SELECT group_key, facility_id, lon, lat, row_number() OVER (PARTITION BY group_key ORDER BY facility_id) AS rn FROM " + _GROUPS + " g)"
_DIST = "sqrt(pow((radians(s.ax) - radians(x.lon)) * 6378137e0, 2) + pow(ln(tan(pi() / 4 + radians(s.ay) / 2)) * 6378137e0 - ln(tan(pi() / 4 + radians(x.lat) / 2)) * 6378137e0, 2))"
_CLUSTERS = f"""WITH RECURSIVE x AS (SELECT * FROM {_XY} q), s AS (SELECT group_key, facility_id, rn, 0 AS no, lon AS ax, lat AS ay FROM x WHERE rn = 1
 UNION ALL SELECT x.group_key, x.facility_id, x.rn, s.no + CASE WHEN coalesce({_DIST} > 250, FALSE) THEN 1 ELSE 0 END, CASE WHEN coalesce({_DIST} > 250, FALSE) THEN x.lon ELSE s.ax END, CASE WHEN coalesce({_DIST} > 250, FALSE) THEN x.lat ELSE s.ay END FROM s JOIN x ON x.group_key = s.group_key AND x.rn = s.rn + 1)
 SELECT group_key, cluster_no, facility_id FROM (SELECT group_key, CAST(no AS INT) AS cluster_no, facility_id, count(*) OVER (PARTITION BY group_key, no) AS n FROM s) z WHERE n > 1"""


@query("cluster_split", _CLUSTERS)
def cluster_split(t):
    return entities.split_clusters(entities.duplicate_groups(t("fac_dup")), 250.0)


_FSCORE = " + ".join(_filled(f"CAST({c} AS VARCHAR)", w) for c, w in (("description", 5), ("notes", 4), ("website", 2), ("phone", 2), ("email", 2), ("address", 3), ("city", 2), ("state", 2), ("postal_code", 2), ("lat", 2), ("lon", 2)))
_FSCORE += " + CASE WHEN lon IS NOT NULL AND lat IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN status = 'ACTIVE' THEN 2 ELSE 0 END + CASE WHEN geom_from_address THEN 1 ELSE 0 END"
_FG = f"(SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, facility_id) > 1 AS other FROM (SELECT *, {_FSCORE} AS score FROM {_GROUPS} g) h)"


def _own(c):
    return f"any_value({c}) FILTER (WHERE NOT other)"


def _ff(c):
    return f"first({sql_text(c)} ORDER BY other, facility_id) FILTER (WHERE {sql_text(c)} IS NOT NULL)"


def _at(c):
    return f"coalesce({_own(c)}, first({c} ORDER BY facility_id) FILTER (WHERE geom_from_address AND {c} IS NOT NULL), first({c} ORDER BY facility_id) FILTER (WHERE {c} IS NOT NULL)) AS {c}"


def _chunks(c):
    return f"{sql_fold(f'list({c} ORDER BY coalesce(length({sql_text(c)}), 0) DESC, facility_id)')} AS {c}"


_FPROP = f"""(SELECT * REPLACE (CASE WHEN address IS NOT NULL THEN array_to_string(list_transform(string_split({CLEAN_STREET}, ' '), lambda w: CASE WHEN lower(w) = 'ks' THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS address)
 FROM (SELECT group_key, {_own('facility_id')} AS base_id, list(facility_id ORDER BY facility_id) AS member_ids, first({sql_text('name')} ORDER BY length({sql_text('name')}) DESC NULLS LAST, facility_id) AS name,
 {', '.join(f'{_ff(c)} AS {c}' for c in ('address', 'address2', 'city', 'state', 'postal_code', 'phone', 'website', 'email'))}, {_chunks('description')}, {_chunks('notes')}, {_at('lon')}, {_at('lat')}, bool_or(coalesce(geom_from_address, FALSE)) AS geom_from_address, 'ACTIVE' AS status FROM {_FG} g GROUP BY group_key) u)"""


@query("facility_merge_proposal", f"SELECT group_key, base_id, array_to_string(member_ids, ',') AS members, name, address, address2, city, state, postal_code, phone, website, email, description, notes, lon, lat, geom_from_address, status FROM {_FPROP} p")
def facility_merge_proposal(t):
    p = entities.propose_facilities(entities.duplicate_groups(t("fac_dup")))
    return p.withColumn("members", F.array_join("member_ids", ",")).drop("member_ids")


_SAME = "f.company_id = p.company_id AND f.name = p.name AND coalesce(f.city, '') = coalesce(p.city, '') AND coalesce(f.state, '') = coalesce(p.state, '')"
_APPLY = f"""WITH p AS (SELECT q.*, b.company_id FROM {_FPROP} q JOIN {{fac_dup}} b ON b.facility_id = q.base_id WHERE {{kind}}),
 m AS (SELECT group_key, unnest(member_ids) AS facility_id FROM p),
 h AS (SELECT p.group_key, f.facility_id, list_contains(p.member_ids, f.facility_id) AS own FROM p JOIN {{fac_dup}} f ON {_SAME}),
 tg AS (SELECT group_key, coalesce(min(facility_id) FILTER (WHERE own), min(facility_id)) AS target FROM h GROUP BY group_key
  UNION ALL SELECT group_key, (SELECT max(facility_id) FROM {{fac_dup}} z) + dense_rank() OVER (ORDER BY lead) FROM (SELECT group_key, min(group_key) OVER (PARTITION BY company_id, name, city, state) AS lead FROM p WHERE group_key NOT IN (SELECT group_key FROM h)) x)"""
# half of the groups get a name that no row has, some one that another row has
_RENAMED = "CASE WHEN base_id % 4 = 0 THEN 'New elevator' WHEN base_id % 4 = 1 THEN regexp_replace(name, ' East$', '') || ' East' ELSE name END"
_APPLY = _APPLY.replace("SELECT q.*, b.company_id", f"SELECT q.* REPLACE ({_RENAMED.replace('base_id', 'q.base_id').replace('name,', 'q.name,').replace('ELSE name', 'ELSE q.name')} AS name), b.company_id").replace("{kind}", "TRUE")


@query("merge_apply", f"""{_APPLY} SELECT coalesce(f.facility_id, n.target) AS facility_id, coalesce(f.company_id, n.company_id) AS company_id, CASE WHEN n.group_key IS NOT NULL THEN n.name ELSE f.name END AS name, CASE WHEN n.group_key IS NOT NULL THEN n.address ELSE f.address END AS address, CASE WHEN n.group_key IS NOT NULL THEN n.notes ELSE f.notes END AS notes,
 CASE WHEN n.group_key IS NOT NULL THEN 'ACTIVE' WHEN o.facility_id IS NOT NULL THEN 'INACTIVE' ELSE f.status END AS status
 FROM {{fac_dup}} f FULL JOIN (SELECT p.*, target FROM p JOIN tg ON p.group_key = tg.group_key QUALIFY row_number() OVER (PARTITION BY target ORDER BY p.group_key DESC) = 1) n ON f.facility_id = n.target LEFT JOIN (SELECT m.facility_id FROM m JOIN tg ON m.group_key = tg.group_key WHERE m.facility_id <> target) o ON f.facility_id = o.facility_id""")
def merge_apply(t):
    p = entities.propose_facilities(entities.duplicate_groups(t("fac_dup")))
    p = p.withColumn("name", F.when(F.col("base_id") % 4 == 0, "New elevator").when(F.col("base_id") % 4 == 1, F.concat(F.regexp_replace("name", " East$", ""), F.lit(" East"))).otherwise(F.col("name")))
    return entities.apply_merge(t("fac_dup"), p)["facility"].select("facility_id", "company_id", "name", "address", "notes", "status")


_IDS = f"(SELECT old_id, base_id AS new_id FROM (SELECT unnest(member_ids) AS old_id, base_id FROM {_PROPOSED} p) u WHERE old_id <> base_id)"


def company_ids(t):
    return entities.id_map(entities.propose_companies(t("company_dup")))


def small_facilities(t):
    """Facilities spread over the duplicate companies."""
    return t("fac_dup").withColumn("company_id", F.col("facility_id") % 80).select("facility_id", "company_id", F.concat(F.lit("F"), (F.col("facility_id") % 9).cast("string")).alias("name"), F.when(F.col("facility_id") % 4 != 0, F.col("city")).alias("city"), "state")


_SMALL = "(SELECT facility_id, facility_id % 80 AS company_id, 'F' || CAST(facility_id % 9 AS VARCHAR) AS name, CASE WHEN facility_id % 4 <> 0 THEN city END AS city, state FROM {fac_dup} q)"
_CONFLICTS = f"(SELECT facility_id FROM (SELECT f.facility_id, row_number() OVER (PARTITION BY i.new_id, f.name, coalesce(f.city, ''), f.state ORDER BY f.facility_id) AS rn, EXISTS (SELECT 1 FROM {_SMALL} k WHERE k.company_id = i.new_id AND k.name = f.name AND coalesce(k.city, '') = coalesce(f.city, '') AND k.state = f.state) AS there FROM {_SMALL} f JOIN {_IDS} i ON f.company_id = i.old_id) x WHERE there OR rn > 1)"


@query("exists_conflict", f"SELECT facility_id, company_id, name FROM {_SMALL} f WHERE facility_id IN (SELECT facility_id FROM {_CONFLICTS} c)")
def exists_conflict(t):
    return entities.name_conflicts(small_facilities(t), company_ids(t)).select("facility_id", "company_id", "name")


@query("fk_repoint", f"SELECT f.facility_id, CASE WHEN c.facility_id IS NOT NULL THEN f.company_id ELSE coalesce(i.new_id, f.company_id) END AS company_id FROM {_SMALL} f LEFT JOIN {_IDS} i ON f.company_id = i.old_id LEFT JOIN {_CONFLICTS} c ON f.facility_id = c.facility_id")
def fk_repoint(t):
    f, ids = small_facilities(t), company_ids(t)
    kept = {"facility": ("facility_id", entities.name_conflicts(f, ids))}
    return entities.repoint({"facility": f}, [("facility", "company_id")], ids, kept)["facility"].select("facility_id", "company_id")


@query("archive_snapshot", f"SELECT company_id AS original_id, 'MERGED' AS reason, new_id, 'company merge' AS detail, '{{{{\"company_id\":' || company_id || ',\"name\":\"' || name || '\",\"phone\":' || CASE WHEN phone IS NULL THEN 'null' ELSE '\"' || phone || '\"' END || '}}}}' AS row_json FROM {{company_dup}} c JOIN {_IDS} i ON c.company_id = i.old_id")
def archive_snapshot(t):
    return entities.archive(t("company_dup").select("company_id", "name", "phone"), company_ids(t), "company_id", "company merge")


def _deactivated(rest):
    return f"SELECT company_id FROM {{company_dup}} c WHERE company_id NOT IN (SELECT old_id FROM {_IDS} i WHERE old_id NOT IN ({rest}))"


@query("company_deactivate", _deactivated(f"SELECT f.company_id FROM {_SMALL} f JOIN {_CONFLICTS} k ON f.facility_id = k.facility_id"))
def company_deactivate(t):
    return entities.deactivate(t("company_dup"), company_ids(t), small_facilities(t))[0].select("company_id")


@query("company_deactivate_delete", f"SELECT facility_id, coalesce(i.new_id, f.company_id) AS company_id FROM {_SMALL} f LEFT JOIN {_IDS} i ON f.company_id = i.old_id WHERE facility_id NOT IN (SELECT facility_id FROM {_CONFLICTS} c)")
def company_deactivate_delete(t):
    return entities.deactivate(t("company_dup"), company_ids(t), small_facilities(t), on_conflict="delete")[1].select("facility_id", "company_id")
