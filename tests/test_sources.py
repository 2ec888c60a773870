"""Files that are read and written in ranges, against plain JSON."""

import json
import random

import pytest

from acrelane.sources import readers, sinks


@pytest.fixture
def small_ranges(spark):
    """Ranges of 97 bytes, and shuffles that keep their parts."""
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def random_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "é", "a", '"features": [', '"type":"Feature"']) for _ in range(rng.randrange(12)))


def random_collection(rng, n):
    """A FeatureCollection with members in any order, braces and quotes in texts, nested and empty properties, and other members before and behind."""
    features = []
    for i in range(n):
        members = [("type", "Feature"), ("properties", {"id": str(i), "owner": random_text(rng), "more": {"a": [{"b": {}}, []]}}), ("geometry", None if i % 5 == 4 else {"type": "Point", "coordinates": [i, -i]})]
        rng.shuffle(members)
        features.append(dict(members))
    members = [("type", "FeatureCollection"), ("name", random_text(rng)), ("crs", {"type": "name", "properties": {"name": random_text(rng)}}), ("features", features), ("about", {"x": {"y": [{}]}, "type": "Feature"}), ("list", [{"type": "Feature"}, {"z": {}}])]
    rng.shuffle(members)
    return dict(members), features


@pytest.mark.parametrize("seed", range(4))
def test_geojson_in_ranges_is_plain_json(spark, small_ranges, tmp_path, seed):
    rng = random.Random(seed)
    want = []
    for part, n in enumerate((23, 1)):
        document, features = random_collection(rng, n)
        (tmp_path / f"{part}.geojson").write_text(json.dumps(document, ensure_ascii=seed % 2 == 0, indent=seed if seed > 1 else None), encoding="utf-8")
        want += features
    pieces = readers.in_file_order(spark, str(tmp_path), "}")
    assert pieces.select("_block").distinct().count() > 10 and pieces.rdd.getNumPartitions() > 10
    got = [json.loads(r["feature"]) for r in readers.feature_texts(spark, str(tmp_path)).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, want))
    rows = readers.read_geojson(spark, str(tmp_path), "id string, owner string").collect()
    kept = [f for f in want if f["geometry"]]
    assert sorted((r["id"], r["owner"], r["lon"]) for r in rows) == sorted((f["properties"]["id"], f["properties"]["owner"], float(f["geometry"]["coordinates"][0])) for f in kept)


def test_lookups_are_one_document(spark, small_ranges, tmp_path):
    company = spark.createDataFrame([(i, f'N"{i}\\é', None if i % 3 else f"w{i}") for i in range(120)] + [(None, "x", "y"), (7, "A", "first"), (9, "", "z"), (500, None, "z")], "company_id long, name string, website string")
    types = spark.createDataFrame([(1, "T")], "facility_type_id long, name string")
    for n, (a, b) in enumerate([(company, types), (company.limit(0), types.limit(0)), (company.limit(0), types)]):
        path = tmp_path / str(n)
        sinks.write_lookups(a, b, str(path))
        parts = sorted(p for p in path.iterdir() if p.name.startswith("part"))
        document = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
        names = {r["company_id"]: (r["name"], r["website"] or "") for r in sorted(a.collect(), key=lambda r: (r["name"] or ""), reverse=True) if r["company_id"] is not None and r["name"]}
        assert document == {"companies": {str(k): v[0] for k, v in names.items()}, "facilityTypes": {str(r[0]): r[1] for r in b.collect()}, "companyWebsites": {str(k): v[1] for k, v in names.items()}}
        if n == 0:
            assert len(parts) > 1
        got = readers.read_lookups(spark, str(path), by_line=True).collect()
        assert sorted(map(tuple, got)) == sorted((s, k, v) for s, m in document.items() for k, v in m.items())
    (tmp_path / "whole.json").write_text(json.dumps({"companies": {"1": "x"}, "other": {"2": "y"}}, indent=1))
    for by_line in (False, True):
        assert [tuple(r) for r in readers.read_lookups(spark, str(tmp_path / "whole.json"), by_line=by_line).collect()] == [("companies", "1", "x")]


def test_tables_by_jdbc(spark, tmp_path):
    """The database that comes with Spark: written, appended, read whole, with a filter that reaches it, and in parts."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).selectExpr("id", "concat('n', id) as name", "case when id % 2 = 0 then id / 4 end as half")
    sinks.write_table(rows.filter("id < 10"), "app.fields", url=url, properties=driver)
    sinks.write_table(rows.filter("id < 60"), "app.fields", url=url, properties=driver)  # replaced
    sinks.write_table(rows.filter("id >= 60"), "app.fields", "append", url=url, properties=driver)
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, readers.read_table(spark, url, table="app.fields", properties=driver).collect())) == want
    some = readers.read_table(spark, url, "id >= 90 and half is not null", "app.fields", properties=driver)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual" in plan[plan.index("PushedFilters"):]
    assert sorted(r[0] for r in some.collect()) == [90, 92, 94, 96, 98]
    parts = readers.read_table(spark, url, None, "app.fields", ("id", 0, 100, 5), driver)
    assert parts.rdd.getNumPartitions() == 5 and sorted(map(tuple, parts.collect())) == want
