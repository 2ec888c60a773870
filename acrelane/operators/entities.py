"""Entity resolution: duplicate groups of companies and facilities, merge proposals, and their application.

All groups are proposed at once; a policy accepts proposals; accepted merges are applied by joins that return new table versions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelane.functions.geo import mercator_metres
from acrelane.functions.text import clean_street, longest, norm_company, norm_text, text_fold
from acrelane.operators.clusters import split_by_pointers
from acrelane.shared import with_ordinal, written

#: Weights of filled fields in a row's score.  Fixed values.
COMPANY_WEIGHTS = {"name": 3, "website": 2, "phone": 2, "notes": 2}
FACILITY_WEIGHTS = {"description": 5, "notes": 4, "website": 2, "phone": 2, "email": 2, "address": 3, "city": 2, "state": 2, "postal_code": 2, "lat": 2, "lon": 2, "geom": 3}
#: What a facility's score gains by being active, and by a place that was found from its address.  Fixed values.
ACTIVE_BONUS, FROM_ADDRESS_BONUS = 2, 1


def filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull()


def score(weights: dict[str, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(filled(c), w).otherwise(0) for c, w in weights.items()])


def facility_score(columns: Sequence[str]) -> Column:
    """A facility row's completeness by the columns that there are; without geom, a point counts as such."""
    parts = [score({c: w for c, w in FACILITY_WEIGHTS.items() if c in columns})]
    if "geom" not in columns and {"lon", "lat"} <= set(columns):
        parts.append(F.when(filled("lon") & filled("lat"), FACILITY_WEIGHTS["geom"]).otherwise(0))
    if "status" in columns:
        parts.append(F.when(F.upper(F.trim("status")) == "ACTIVE", ACTIVE_BONUS).otherwise(0))
    if "geom_from_address" in columns:
        parts.append(F.when(F.col("geom_from_address").cast("boolean"), FROM_ADDRESS_BONUS).otherwise(0))
    return reduce(lambda a, b: a + b, parts)


def _members(rows: DataFrame, group: Sequence[str], id_col: str, fields: Sequence[str], points: Column) -> DataFrame:
    """(group, xs): members of groups of two or more, first the base (best score, then lowest id), then the others by id."""
    rank = F.negative(points)
    members = F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), rank.alias("rank"), *[F.col(f) for f in fields])))
    # the base is an aggregate: searched in the array, it would be searched anew for each member wherever a filter is pushed down
    base = F.min(F.struct(rank.alias("rank"), F.col(id_col).alias("id")))["id"]
    sorted_ = rows.groupBy(*group).agg(members.alias("xs"), base.alias("_base"), F.count("*").alias("_size")).filter("_size > 1")
    return sorted_.withColumn("xs", F.concat(F.filter("xs", lambda x: x["id"] == F.col("_base")), F.filter("xs", lambda x: x["id"] != F.col("_base")))).drop("_base", "_size")


def _first_filled(field: str) -> Column:
    return F.get(F.filter(F.transform("xs", lambda x: norm_text(x[field])), lambda v: v.isNotNull()), F.lit(0))


def propose_companies(company: DataFrame) -> DataFrame:
    """(key, base_id, member_ids, name, website, phone, notes) of companies with equal normalised names.

    The base has the best score (ties: lowest id); its website and phone stay as they are if they are filled, else they are those of the first
    other, by id, that has them; notes are folded, the base's first.
    """
    rows = company.withColumn("key", norm_company(F.col("name"))).filter("key <> ''")
    g = _members(rows, ["key"], "company_id", ["name", "website", "phone", "notes"], score(COMPANY_WEIGHTS))

    def own_or_first(field: str) -> Column:
        own = F.get("xs", F.lit(0))[field]
        return F.when(norm_text(own).isNotNull(), own).otherwise(F.coalesce(_first_filled(field), own)).alias(field)

    return g.select("key", F.get("xs", F.lit(0))["id"].alias("base_id"), F.array_sort(F.transform("xs", lambda x: x["id"])).alias("member_ids"), F.get("xs", F.lit(0))["name"].alias("name"), own_or_first("website"), own_or_first("phone"), text_fold(F.transform("xs", lambda x: x["notes"])).alias("notes"))


def _ends(value: Column) -> tuple[Column, Column]:
    return F.min(value), F.max(value)


def _one(ends: tuple[Column, Column]) -> Column:
    """Whether there is exactly one value."""
    return F.coalesce(ends[0] == ends[1], F.lit(False))


def trivial_companies(company: DataFrame, fields: Sequence[str] = ("website", "phone", "notes")) -> DataFrame:
    """(key, trivial): names equal but for spelling, and each other field filled with one and the same value in all (a field that none has counts
    as a difference)."""
    rows = company.withColumn("key", norm_company(F.col("name"))).filter("key <> ''")
    same = reduce(lambda a, b: a & b, [_one(_ends(F.coalesce(norm_text(F.col(c)), F.lit("")))) for c in fields])
    none = reduce(lambda a, b: a | b, [F.count_if(filled(c)) == 0 for c in fields])
    return rows.groupBy("key").agg(F.count("*").alias("n"), (same & ~none & F.coalesce(F.min("name") < F.max("name"), F.lit(False))).alias("trivial")).filter("n > 1").drop("n")


#: Fields of a facility that a merge compares.
FACILITY_FIELDS = ("company_id", "facility_type_id", "address", "address2", "city", "county", "state", "postal_code", "website", "phone", "email", "description", "notes", "source", "lat", "lon", "status", "geom_from_address")


def trivial_facilities(groups: DataFrame, fields: Sequence[str] = FACILITY_FIELDS) -> DataFrame:
    """(group_key, trivial) of grouped facilities: the names differ, but not as names of companies, and no other field has two values.  Missing values are
    no difference, but of the status and of the flag of the place, which a merge sets."""
    there = [c for c in fields if c in groups.columns]
    texts = {c for c, kind in groups.dtypes if kind == "string"}
    # least and greatest value instead of sets, so that rows are neither kept nor copied once a field
    ends = {c: _ends(norm_text(F.col(c)) if c in texts else F.col(c)) for c in there}
    same = reduce(lambda a, b: a & b, [_one(ends[c]) if c in ("status", "geom_from_address") else ends[c][0].isNull() | _one(ends[c]) for c in there], F.lit(True))
    low, high = _ends(norm_text(F.col("name")))
    spelling = F.coalesce(low < high, F.lit(False)) & (F.count(F.nullif("name", F.lit(""))) > 1) & _one(_ends(F.nullif(norm_company(F.col("name")), F.lit(""))))
    return groups.groupBy("group_key").agg((same & spelling).alias("trivial"))


def duplicate_groups(facility: DataFrame) -> DataFrame:
    """facility rows with group_key and kind: 'address' groups share company, cleaned street, city, state and postal code, one of which is filled; 'name'
    groups share company, name, city and state, all filled, and none of their members is in an address group.  Only active rows; groups of
    one are left out, and so are rows without a company."""
    rows = facility.filter("status = 'ACTIVE'").withColumn("_street", F.lower(clean_street(F.col("address"))))
    company = F.col("company_id").cast("string")
    where = [F.coalesce(F.trim(F.lower("city")), F.lit("")), F.coalesce(F.trim(F.upper("state")), F.lit("")), F.coalesce(F.trim("postal_code"), F.lit(""))]
    address = F.when(company.isNotNull() & (F.concat("_street", *where) != ""), F.concat_ws("|", F.lit("a"), company, "_street", *where))
    named = [F.lower(norm_text(F.col("name"))), F.lower(norm_text(F.col("city"))), F.upper(norm_text(F.col("state")))]
    name = F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in (company, *named)]), F.concat_ws("|", F.lit("n"), company, *named))
    # keys are patterns over every row: dealt to all tasks, worked out once, and not again for each count and join
    rows = written(rows.repartition("facility_id").withColumns({"_a": address, "_n": name}).drop("_street"), "keys")
    big_a = rows.filter("_a is not null").groupBy("_a").agg(F.count("*").alias("_na")).filter("_na > 1")
    rows = rows.join(big_a, "_a", "left")
    big_n = rows.filter("_n is not null").groupBy("_n").agg(F.count("*").alias("_nn"), F.count("_na").alias("_in_address")).filter("_nn > 1 and _in_address = 0").select("_n", F.lit(True).alias("_alone"))
    rows = rows.join(big_n, "_n", "left")
    key = F.when(F.col("_na").isNotNull(), F.col("_a")).when(F.col("_alone"), F.col("_n"))
    kind = F.when(F.col("_na").isNotNull(), "address").when(F.col("_alone"), "name")
    return rows.withColumns({"group_key": key, "kind": kind}).filter("group_key is not null").drop("_a", "_n", "_na", "_alone")


#: Groups of at most so many members are folded in one row; larger ones go by successor pointers.
FOLDED_MEMBERS = 1000


def split_clusters(groups: DataFrame, max_metres: float = 250.0, folded: int = FOLDED_MEMBERS) -> DataFrame:
    """(group_key, cluster_no, facility_id): members in order of id; a new cluster begins where the distance to the cluster's first member is over
    max_metres; an unknown distance joins.  Clusters of one are left out, and so are rows without a group.

    Groups of at most folded members are folded each in one row, larger ones take successor pointers and spread over tasks; the result is the same.
    """
    sizes = written(groups.filter("group_key is not null").groupBy("group_key").agg(F.count("*").alias("_size")), "sizes")
    large = sizes.filter(F.col("_size") > folded).select("group_key")
    out = _folded_clusters(groups.join(sizes.filter(F.col("_size") <= folded).select("group_key"), "group_key", "left_semi"), max_metres)
    if not large.isEmpty():
        out = out.unionByName(split_by_pointers(groups.join(large, "group_key", "left_semi"), max_metres))
    big = out.groupBy("group_key", "cluster_no").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return out.join(big, ["group_key", "cluster_no"])


def _folded_clusters(groups: DataFrame, max_metres: float) -> DataFrame:
    """(group_key, cluster_no, facility_id), clusters of one included, by a fold over each group's own ids and coordinates."""
    xs = F.array_sort(F.collect_list(F.struct("facility_id", "lon", "lat")))
    rows = groups.groupBy("group_key").agg(xs.alias("xs"))

    def step(s, x):
        far = F.coalesce(mercator_metres(s["lon"], s["lat"], x["lon"], x["lat"]) > max_metres, F.lit(False)) | (s["no"] < 0)
        no = F.when(far, s["no"] + 1).otherwise(s["no"])
        return F.struct(no.alias("no"), F.when(far, x["lon"]).otherwise(s["lon"]).alias("lon"), F.when(far, x["lat"]).otherwise(s["lat"]).alias("lat"), F.concat(s["out"], F.array(F.struct(no.alias("no"), x["facility_id"].alias("id")))).alias("out"))

    zero = F.struct(F.lit(-1).alias("no"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.array().cast("array<struct<no:int,id:bigint>>").alias("out"))
    return rows.select("group_key", F.explode(F.aggregate("xs", zero, step)["out"]).alias("o")).select("group_key", F.col("o.no").alias("cluster_no"), F.col("o.id").alias("facility_id"))


def propose_facilities(groups: DataFrame) -> DataFrame:
    """(group_key, base_id, member_ids, fields): the base by weighted completeness (ties: lowest id); the longest name; the base's place and contacts, where it
    has none those of the first by id; description, notes and source folded, longest first; latitude and longitude each the base's, else of
    the first place that was found from its address, else of the first; that flag if any has it; status ACTIVE; the address in title case.

    Of address2, county, email, description, source and geom_from_address those that are columns are merged.
    """
    def there(*names: str) -> list[str]:
        return [c for c in names if c in groups.columns]

    single = there("address", "address2", "city", "county", "state", "postal_code", "phone", "website", "email")
    folded, flagged = there("description", "notes", "source"), there("geom_from_address")
    g = _members(groups, ["group_key"], "facility_id", ["name", *single, *folded, *flagged, "lon", "lat"], facility_score(groups.columns))
    base, by_id = F.get("xs", F.lit(0)), F.array_sort("xs")

    def longest_first(c: str) -> Column:
        sized = F.transform("xs", lambda x: F.struct(F.negative(F.coalesce(F.length(norm_text(x[c])), F.lit(0))).alias("l"), x["id"].alias("id"), x[c].alias("t")))
        return F.transform(F.array_sort(sized), lambda x: x["t"])

    def coordinate(c: str) -> Column:
        first = F.get(F.filter(by_id, lambda x: x[c].isNotNull()), F.lit(0))[c]
        from_address = [F.get(F.filter(by_id, lambda x: x[c].isNotNull() & F.coalesce(x["geom_from_address"], F.lit(False))), F.lit(0))[c]] if flagged else []
        return F.coalesce(base[c], *from_address, first)

    out = {c: _first_filled(c) for c in single}
    if "address" in out:
        words = F.split(clean_street(out["address"]), " ")
        out["address"] = F.array_join(F.transform(words, lambda w: F.when(F.lower(w) == "ks", F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))), " ")
        out["address"] = F.when(_first_filled("address").isNotNull(), out["address"])
    out |= {c: text_fold(longest_first(c)) for c in folded}
    out |= {c: coordinate(c) for c in ("lon", "lat")}
    out |= {c: F.exists("xs", lambda x: F.coalesce(x["geom_from_address"], F.lit(False))) for c in flagged}
    name = F.coalesce(longest(F.transform(by_id, lambda x: norm_text(x["name"]))), base["name"])
    return g.select("group_key", base["id"].alias("base_id"), F.array_sort(F.transform("xs", lambda x: x["id"])).alias("member_ids"), name.alias("name"), *[v.alias(c) for c, v in out.items()], F.lit("ACTIVE").alias("status"))


def id_map(proposals: DataFrame) -> DataFrame:
    """(old_id, new_id) of accepted proposals: every member but the base."""
    return proposals.select(F.explode("member_ids").alias("old_id"), F.col("base_id").alias("new_id")).filter("old_id <> new_id")


def name_conflicts(facility: DataFrame, ids: DataFrame) -> DataFrame:
    """Facilities of merged companies whose (name, city, state), null as '', stands under the canonical company already, or under another merged one
    with a lower facility id."""
    keys = ["name", "city", "state"]
    rows = facility.select("facility_id", "company_id", *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in keys])
    moved = rows.join(ids, F.col("company_id") == F.col("old_id")).select("facility_id", F.col("new_id").alias("_to"), *[f"_{c}" for c in keys])
    there = rows.select(F.col("company_id").alias("_to"), *[f"_{c}" for c in keys], F.lit(True).alias("_there")).distinct()
    with_base = moved.join(there, ["_to", *[f"_{c}" for c in keys]], "left")
    w = Window.partitionBy("_to", *[f"_{c}" for c in keys]).orderBy("facility_id")
    bad = with_base.withColumn("_rn", F.row_number().over(w)).filter("_there or _rn > 1").select("facility_id")
    return facility.join(bad, "facility_id", "left_semi")


def repoint(tables: dict[str, DataFrame], fks: Sequence[tuple[str, str]], ids: DataFrame, except_ids: dict[str, tuple[str, DataFrame]] | None = None) -> dict[str, DataFrame]:
    """Tables with old ids in the named columns replaced by new ones; except_ids: table -> (id column, ids left as they are)."""
    out = dict(tables)
    for name, column in fks:
        df = out[name]
        names = df.columns
        df = df.join(ids, F.col(column) == F.col("old_id"), "left")
        held = F.lit(False)
        if except_ids and name in except_ids:
            key, kept = except_ids[name]
            df = df.join(kept.select(F.col(key).alias("_held")).distinct(), F.col(key) == F.col("_held"), "left")
            held = F.col("_held").isNotNull()
        out[name] = df.withColumn(column, F.when(held, F.col(column)).otherwise(F.coalesce("new_id", column))).select(*names)
    return out


def archive(df: DataFrame, ids: DataFrame, id_col: str, detail: str) -> DataFrame:
    """(original_id, reason, new_id, detail, row_json) of merged rows; nulls stay in the JSON."""
    rows = df.join(ids, F.col(id_col) == F.col("old_id"))
    return rows.select(F.col(id_col).alias("original_id"), F.lit("MERGED").alias("reason"), "new_id", F.lit(detail).alias("detail"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_json"))


def deactivate(company: DataFrame, ids: DataFrame, facility: DataFrame, on_conflict: str = "keep") -> tuple[DataFrame, DataFrame]:
    """(company, facility) after a merge: merged companies without facilities go.  Conflicting facilities are kept with their company, or with
    on_conflict='delete' go first."""
    conflicts = name_conflicts(facility, ids)
    rest = facility if on_conflict == "keep" else facility.join(conflicts.select("facility_id"), "facility_id", "left_anti")
    moved = repoint({"facility": rest}, [("facility", "company_id")], ids, {"facility": ("facility_id", conflicts)})["facility"]
    used = moved.select(F.col("company_id").alias("old_id")).distinct()
    gone = ids.select("old_id").join(used, "old_id", "left_anti")
    return company.join(gone, company["company_id"] == gone["old_id"], "left_anti"), moved


def apply_merge(facility: DataFrame, proposals: DataFrame, accept: Column | None = None) -> dict[str, DataFrame]:
    """New versions: facility (the target with the proposed fields, the others INACTIVE), ids (old_id, new_id), archive.

    The target is the member that already holds the proposed key (the group's company, name, city, state; null city and state as ''), else another
    row that holds it, lowest ids first; else a new row with the next free id, in order of group_key; groups with one key share it.
    """
    chosen = written(proposals if accept is None else proposals.filter(accept), "chosen")
    member = chosen.select("group_key", F.explode("member_ids").alias("facility_id"), "base_id", F.col("name").alias("_name"), F.col("city").alias("_city"), F.col("state").alias("_state"))
    company = member.join(facility.select(F.col("facility_id").alias("base_id"), F.col("company_id").alias("_company")), "base_id").select("group_key", "_company").distinct()
    wanted = chosen.join(company, "group_key").select("group_key", "_company", F.col("name").alias("_name"), F.coalesce("city", F.lit("")).alias("_city"), F.coalesce("state", F.lit("")).alias("_state"))
    on = (F.col("company_id") == F.col("_company")) & (F.col("name") == F.col("_name")) & (F.coalesce("city", F.lit("")) == F.col("_city")) & (F.coalesce("state", F.lit("")) == F.col("_state"))
    holders = facility.select("facility_id", "company_id", "name", "city", "state").join(wanted, on).select("group_key", "facility_id")
    own = holders.join(member.select("group_key", "facility_id", F.lit(True).alias("_own")), ["group_key", "facility_id"], "left")
    target = own.groupBy("group_key").agg(F.min(F.struct(F.col("_own").isNull(), "facility_id"))["facility_id"].alias("target_id"))
    fresh = wanted.join(target, "group_key", "left_anti")
    key = ["_company", "_name", "_city", "_state"]
    numbered = with_ordinal(fresh.groupBy(*key).agg(F.min("group_key").alias("_lead")), "_lead", "_no").toDF(*[f"{c}_n" for c in key], "_lead", "_no")
    fresh = fresh.join(numbered, [F.col(c).eqNullSafe(F.col(f"{c}_n")) for c in key])
    last = facility.agg(F.coalesce(F.max("facility_id"), F.lit(0)).alias("_last"))
    fresh = fresh.join(F.broadcast(last)).select("group_key", (F.col("_last") + F.col("_no")).alias("target_id"))  # last is one row
    target = written(target.unionByName(fresh), "targets")
    fields = [c for c in chosen.columns if c in facility.columns]
    new = chosen.join(target, "group_key").join(company, "group_key").select(F.col("target_id").alias("facility_id"), "group_key", "_company", *[F.col(c).alias(f"_{c}") for c in fields])
    # several groups may lead to one row, which takes the fields of the last
    new = new.groupBy("facility_id").agg(F.max_by(F.struct(*new.columns[2:]), "group_key").alias("_x")).select("facility_id", "_x.*")
    ids = member.join(target, "group_key").filter("facility_id <> target_id").select(F.col("facility_id").alias("old_id"), F.col("target_id").alias("new_id"))
    rows = facility.join(new, "facility_id", "full").join(ids, F.col("facility_id") == F.col("old_id"), "left")
    values = {c: F.when(F.col("_status").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields if c != "status"}
    values["company_id"] = F.coalesce("company_id", "_company")
    values["status"] = F.when(F.col("_status").isNotNull(), F.col("_status")).when(F.col("old_id").isNotNull(), "INACTIVE").otherwise(F.col("status"))
    return {"facility": rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in facility.columns]), "ids": ids, "archive": archive(facility, ids, "facility_id", "facility merge")}
