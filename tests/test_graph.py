"""Least-time search, routes and page reach against plain versions."""

import heapq
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrelane.operators import cells, entities, hierarchy, pages, routing
from acrelane.sources import readers


MINUTE, METRE = 10**9, 10**6


def heap_search(edges, starts):
    """{(start, node): (time, length)} from nodes to starts, both as whole numbers: the library's units, so that ties are ties."""
    back, least = defaultdict(list), {}
    for s, d, t, m in edges:
        w = (round(t * MINUTE), round(m * METRE))
        least[s, d] = min(least.get((s, d), w), w)
    for (s, d), w in least.items():
        back[d].append((s, w))
    out = {}
    for start in starts:
        heap, seen = [(0, 0, start)], {}
        while heap:
            t, m, n = heapq.heappop(heap)
            if n in seen:
                continue
            seen[n] = (t, m)
            for p, (dt, dm) in back[n]:
                if p not in seen:
                    heapq.heappush(heap, (t + dt, m + dm, p))
        out |= {(start, n): v for n, v in seen.items()}
    return out


def told(df):
    return {(r["facility_id"], r["node"]): (round(r["minutes"] * MINUTE), round(r["miles"] * 1609.344 * METRE)) for r in df.collect()}


@pytest.mark.parametrize("core", [8, 512])
def test_drive_times_is_dijkstra(spark, core):
    rng = random.Random(5)
    # equal times by ways of unlike lengths, parallel and empty edges, loops, an island, one-way ends
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randint(0, 4)), float(rng.randint(0, 900))) for _ in range(130)] + [(50, 51, 1.0, 5.0), (51, 52, 2.5, 6.25), (7, 60, 1.0, 1.0)]
    seeds = [(1, 0), (2, 17), (3, 17), (4, 52), (5, 99)]
    df = spark.createDataFrame(edges, "src long, dst long, travel_time double, length_m double")
    got = told(routing.drive_times(df, spark.createDataFrame(seeds, "facility_id long, node long"), core_nodes=core))
    ways = heap_search(edges, {n for _, n in seeds})
    assert got == {(f, n): w for f, at in seeds for (start, n), w in ways.items() if start == at}
    assert (5, 99) in got and (4, 50) in got and (4, 0) not in got


def test_rounds_of_a_grid_and_given_pairs(spark):
    rng = random.Random(6)
    pairs = [(9 * y + x, 9 * y + x + 1) for y in range(9) for x in range(8)] + [(9 * y + x, 9 * y + x + 9) for y in range(8) for x in range(9)]
    edges = [(a, b, rng.uniform(0.5, 2), rng.uniform(400, 900)) for p in pairs for a, b in (p, p[::-1]) if rng.random() < 0.95]
    h = hierarchy.Hierarchy(spark.createDataFrame(edges, "src long, dst long, travel_time double, length_m double"), core_nodes=16)
    assert 2 <= h.rounds <= 40
    asked = [(rng.randrange(81), rng.randrange(81)) for _ in range(60)] + [(3, 3), (None, 4), (900, 900)]
    rows = h.between(spark.createDataFrame(asked, "node long, target long")).select("node", "target", hierarchy.minutes_of(F.col("w")).alias("minutes"), hierarchy.metres_of(F.col("w")).alias("m")).collect()
    ways = heap_search(edges, {t for _, t in asked}) | {(900, 900): (0, 0)}
    assert {(r["target"], r["node"]): (round(r["minutes"] * MINUTE), round(r["m"] * METRE)) for r in rows} == {(t, n): ways[t, n] for n, t in asked if (t, n) in ways}


def test_queries_of_ways_are_dijkstra(spark, sf_dir):
    from acrelane.plans import registry

    t = registry.Tables(spark, sf_dir)
    edges = [(r["src"], r["dst"], r["travel_time"], r["length_m"]) for r in routing.edge_times(t("edges")).collect()]
    ways = heap_search(edges, [r["node"] for r in t("nodes").filter("node % 50 = 0").collect()])
    near = lambda got, want: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert near({(r["facility_id"], r["node"]): r["minutes"] for r in registry.QUERIES["drive_times"](spark, sf_dir).collect()}, {k: w[0] / MINUTE for k, w in ways.items()})
    assert near({(r["facility_id"], r["node"]): r["miles"] for r in registry.QUERIES["path_miles"](spark, sf_dir).collect()}, {k: w[1] / METRE / 1609.344 for k, w in ways.items()})
    # the matrix: every field beside every facility in reach, by the heap search and snapping of its own
    rows = registry.QUERIES["haul_matrix"](spark, sf_dir).collect()
    nodes = [(r["node"], r["lon"], r["lat"]) for r in t("nodes").collect()]
    c = math.cos(math.radians(sum(n[2] for n in nodes) / len(nodes)))
    snap = lambda x, y: min(nodes, key=lambda n: (((x - n[1]) * c) ** 2 + (y - n[2]) ** 2, n[0]))[0]
    at = {r["facility_id"]: snap(r["lon"], r["lat"]) for r in t("facility").filter("status = 'ACTIVE' and lon is not null").collect()}
    to_facility = heap_search(edges, set(at.values()))
    ok = 0
    for r in rows:
        if r["facility_id"] is None:
            assert r["status"] == "no_facility_within_prefilter_miles"
            continue
        way = to_facility.get((at[r["facility_id"]], snap(r["field_centroid_lon"], r["field_centroid_lat"])))
        assert r["status"] == ("ok" if way else "route_failed")
        if way:
            ok += 1
            assert abs(r["drive_minutes_one_way"] - way[0] / MINUTE) < 2e-6 and abs(r["drive_miles"] - way[1] / METRE / 1609.344) < 2e-6
    assert ok and {r["field_id"] for r in rows} == {r["id"] for r in t("parcels").filter("lon is not null").collect()}


def matrix(spark, **more):
    nodes = spark.createDataFrame([(i, -98.0 + i * 0.01, 38.0) for i in range(6)] + [(9, -97.5, 38.0)], "node long, lon double, lat double")
    edges = spark.createDataFrame([(i, i + 1, 1609.344, "trunk", None) for i in range(5)] + [(i + 1, i, 1609.344, "trunk", None) for i in range(5)], "src long, dst long, length_m double, highway string, surface string")
    fields = spark.createDataFrame([(1, "A", -98.0, 38.0), (2, "B", -97.5, 38.0), (3, "C", -90.0, 38.0), (4, "D", -97.95, 38.0)], "field_id long, owner_name string, lon double, lat double")
    stops = spark.createDataFrame([(7, "East", -97.95, 38.0), (8, "West", -97.99, 38.0)], "facility_id long, facility_name string, facility_lon double, facility_lat double")
    return routing.haul_matrix(fields, stops, nodes, edges, **more)


def test_haul_matrix_statuses(spark):
    rows = {(r["field_id"], r["facility_id"]): r for r in matrix(spark).collect()}
    assert rows[1, 7]["status"] == "ok" and abs(rows[1, 7]["drive_miles"] - 5) < 1e-6 and abs(rows[1, 7]["drive_minutes_one_way"] - 5) < 1e-6
    assert abs(rows[1, 8]["total_minutes_two_way_plus_unload"] - 32) < 1e-6 and rows[1, 8]["is_closest_facility"]
    assert rows[2, 7]["status"] == "route_failed" and not rows[2, 7]["is_closest_facility"]
    assert rows[3, None]["status"] == "no_facility_within_prefilter_miles"
    assert rows[4, 7]["drive_minutes_one_way"] == 0.0 and rows[4, 7]["status"] == "ok"
    best = {r["field_id"]: (r["facility_id"], r["is_closest_facility"]) for r in routing.nearest_route(matrix(spark)).collect()}
    assert best == {1: (8, True), 2: (7, True), 3: (None, True), 4: (7, True)}
    near = {r["status"] for r in matrix(spark, max_snap_miles=0.0001).filter("field_id = 1").collect()}
    assert near <= {"ok", "route_failed"}


def test_haul_matrix_stores_ids_and_ways_only(spark, monkeypatch):
    """Of a facility beside a node, names, places and derived numbers were shuffled twice and stored; facilities that share an id stay rows of their own."""
    stored = {}
    monkeypatch.setattr(routing, "written", lambda df, label, put=routing.written: stored.update({label: df.columns}) or put(df, label))
    nodes = spark.createDataFrame([(i, -98.0 + i * 0.01, 38.0) for i in range(4)], "node long, lon double, lat double")
    edges = spark.createDataFrame([(i, i + 1, 1609.344, "trunk", None) for i in range(3)], "src long, dst long, length_m double, highway string, surface string")
    fields = spark.createDataFrame([(1, "A", -98.0, 38.0)], "field_id long, owner_name string, lon double, lat double")
    stops = spark.createDataFrame([(7, "S", -97.99, 38.0), (7, "T", -97.98, 38.0), (None, "U", -97.97, 38.0)], "facility_id long, facility_name string, facility_lon double, facility_lat double")
    rows = routing.haul_matrix(fields, stops, nodes, edges).collect()
    assert sorted((r["facility_name"], r["facility_id"], round(r["drive_miles"], 6), r["status"]) for r in rows) == [("S", 7, 1.0, "ok"), ("T", 7, 2.0, "ok"), ("U", None, 3.0, "ok")]
    assert set(stored["ahead"]) == {"_rcx", "_rcy", "_node", "_stop", "minutes", "miles"}


def test_haul_matrix_of_places(spark, monkeypatch):
    """Rows that share an id or have none keep their own place, and tables between the steps do not grow with the pairs."""
    sizes = []
    monkeypatch.setattr(routing, "written", lambda df, label, put=routing.written: sizes.append(df.count()) or put(df, label))
    nodes = spark.createDataFrame([(i, -98.0 + i * 0.01, 38.0) for i in range(4)], "node long, lon double, lat double")
    edges = spark.createDataFrame([(i, i + 1, 1609.344, "trunk", None) for i in range(3)], "src long, dst long, length_m double, highway string, surface string")
    fields = [(i, "A", -98.0 - i * 1e-4, 38.0) for i in range(120)] + [(500, "B", -98.0, 38.0), (500, "B", -97.98, 38.0), (None, "C", -97.99, 38.0), (501, "D", None, None), (502, "E", -80.0, 38.0)]
    stops = spark.createDataFrame([(i, f"S{i}", -97.97 + i * 1e-4, 38.0) for i in range(60)], "facility_id long, facility_name string, facility_lon double, facility_lat double")
    rows = routing.haul_matrix(spark.createDataFrame(fields, "field_id long, owner_name string, lon double, lat double"), stops, nodes, edges).collect()
    assert len(rows) == 123 * 60 + 2 and max(sizes) <= 125 + 60 * 25
    told = lambda field: sorted((round(r["drive_miles"], 6), r["status"]) for r in rows if r["field_id"] == field and r["facility_id"] == 7)
    assert told(500) == [(1.0, "ok"), (3.0, "ok")] and told(None) == [(2.0, "ok")] and told(3) == [(3.0, "ok")]
    assert [(r["field_id"], r["status"], r["is_closest_facility"]) for r in rows if r["facility_id"] is None] in ([(i, "no_facility_within_prefilter_miles", False) for i in a] for a in ((501, 502), (502, 501)))
    # equal minutes to one node: crow miles decide; rows without an id have no closest facility
    assert {r["field_id"]: r["facility_id"] for r in rows if r["is_closest_facility"]} == {i: 0 for i in [*range(120), 500]}
    assert sum(r["is_closest_facility"] for r in rows) == 122


def test_elimination_is_closure():
    rng = np.random.default_rng(3)
    for _ in range(60):  # ties, empty roads, parts that are not reached, all or no nodes as hubs
        n, m, k = rng.integers(1, 25), rng.integers(0, 60), rng.integers(0, 4)
        d, first = np.full((n, n), complex(np.inf)), np.full((n, k), complex(np.inf))
        d[rng.integers(0, n, m), rng.integers(0, n, m)] = rng.integers(0, 4, m) + 1j * rng.integers(0, 4, m)
        first[rng.integers(0, n, k), np.arange(k)] = rng.integers(0, 3, k)
        hubs = np.flatnonzero(rng.random(n) < rng.choice([0, 0.3, 1]))
        every = cells.closure(d.copy())
        want = np.concatenate([every[:, hubs], cells.through(every, first, first.copy())], axis=1)
        got = cells.eliminated(d, hubs, first)
        there = np.isfinite(want.real)
        assert (there == np.isfinite(got.real)).all() and (want[there] == got[there]).all()
    with pytest.raises(ValueError):
        cells.eliminated(np.array([[np.inf, 1, np.inf], [np.inf, np.inf, -2], [0, np.inf, np.inf]], complex), np.array([0]), np.zeros((3, 0), complex))


def test_site_reach_is_breadth_first(spark):
    urls = {i: f"https://a.example.com/{i}" for i in range(8)} | {20: "https://b.example.com/", 21: "https://b.example.com/x"}
    p = spark.createDataFrame([(i, u, "") for i, u in urls.items()], "page_id long, url string, html string")
    arcs = [(0, 0, 3), (0, 1, 5), (3, 0, 6), (5, 0, 1), (5, 1, 6), (1, 0, 0), (6, 0, 7), (20, 0, 3), (20, 1, 21)]
    links = spark.createDataFrame([(s, urls[s], pos, urls[d]) for s, pos, d in arcs], "page_id long, src_url string, pos int, dst_url string")
    got = sorted((r["site"], r["rank"], r["page_id"], r["level"]) for r in pages.site_reach(p, links, max_pages=5).collect())
    assert got == [("a.example.com", 1, 0, 0), ("a.example.com", 2, 3, 1), ("a.example.com", 3, 5, 1), ("a.example.com", 4, 6, 2), ("a.example.com", 5, 1, 2), ("b.example.com", 1, 20, 0), ("b.example.com", 2, 21, 1)]


def test_links_are_resolved(spark):
    html = '<a href="/x">1</a><a class=c HREF="y?z=1#top">2</a><a href="#a">3</a><a href="mailto:q">4</a><a href="f.pdf">5</a><a href=\'//h.example.com/w\'>6</a><a id=q href=/u>8</a><a href="https://other.example.com/">7</a>'
    df = spark.createDataFrame([(1, "https://h.example.com/d/e?q=1", html), (2, "https://h.example.com", None)], "page_id long, url string, html string")
    assert [(r["pos"], r["dst_url"]) for r in pages.page_links(df).orderBy("pos").collect()] == [(0, "https://h.example.com/x"), (5, "https://h.example.com/w"), (6, "https://h.example.com/u")]


def test_page_score_words(spark):
    df = spark.createDataFrame([(1, "https://h.example.com/", "<table><p>Cash Bids: corn $4.56</p>"), (2, "https://h.example.com/2", "<p>hello</p>")], "page_id long, url string, html string")
    row = pages.score_pages(df).first()
    # bid word 'cash bid', one crop word, cash bid, a named crop, table, price
    assert row["page_id"] == 1 and row["score"] == 10 + 5 + 20 + 10 + 5 + 10
    for text, score in (("grain 5.50/BU today", 5 + 10), ("milo at 3 per cwt", 5 + 10 + 10), ("New Crop Bid", 20 + 15), ("wheat bids", 10 + 5 + 10)):
        assert pages.score_pages(spark.createDataFrame([(1, "https://h.example.com/", f"<p>{text}</p>")], df.schema)).first()["score"] == score, text


def test_facility_score_of_completeness(spark):
    df = spark.createDataFrame([("a", " ", None, "ACTIVE", 1.0, 2.0, True), ("a", "b", "c", "inactive", 1.0, None, False)], "notes string, city string, description string, status string, lon double, lat double, geom_from_address boolean")
    assert [r["s"] for r in df.select(entities.facility_score(df.columns).alias("s")).collect()] == [4 + 2 + 2 + 3 + 2 + 1, 4 + 2 + 5 + 2]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="1"><data key="x">-98.0</data><data key="y">38.0</data></node><node id="2"><data key="x">-97.0</data><data key="y">38.0</data></node><node id="3"><data key="x">-90.0</data><data key="y">38.0</data></node><edge source="1" target="2"><data key="length">5.5</data><data key="highway">primary</data></edge><edge source="3" target="3"><data key="length">1</data></edge></graph></graphml>')
    nodes, edges = readers.read_road_graph(spark, str(tmp_path / "g.graphml"), (-98.5, 37.5, -97.5, 38.5))
    assert sorted(r["node"] for r in nodes.collect()) == [1, 2]
    assert [tuple(r) for r in edges.collect()] == [(1, 2, 5.5, "primary", None)]


def test_graphml_with_a_table_of_keys(spark, tmp_path):
    keys = "".join(f'<key id="d{i}" for="{tag}" attr.name="{name}" attr.type="string" />' for i, (tag, name) in enumerate([("node", "y"), ("node", "x"), ("edge", "osmid"), ("edge", "length"), ("edge", "highway"), ("edge", "x")]))
    nodes = "".join(f'<node id="{n}"><data key="d0">38.{n}</data><data key="d1">-98.{n}</data></node>' for n in (1, 2))
    (tmp_path / "g.graphml").write_text(f'<graphml>{keys}<graph edgedefault="directed">{nodes}<edge source="1" target="2" id="0"><data key="d2">9</data><data key="d3">1609.344</data><data key="d4">[\'ferry\', \'Primary\']</data></edge></graph></graphml>')
    got, edges = readers.read_road_graph(spark, str(tmp_path / "g.graphml"), (-98.5, 37.5, -97.5, 38.5))
    assert sorted(tuple(r) for r in got.collect()) == [(1, -98.1, 38.1), (2, -98.2, 38.2)]
    assert [(r["src"], r["dst"], r["length_m"], r["mph"]) for r in routing.edge_times(edges).collect()] == [(1, 2, 1609.344, 55.0)]


def test_merge_of_companies_keeps_conflicts(spark):
    ids = spark.createDataFrame([(2, 1), (3, 1)], "old_id long, new_id long")
    facility = spark.createDataFrame([(10, 1, "A", None, "KS"), (11, 2, "A", "", "KS"), (12, 2, "B", "x", "KS"), (13, 3, "B", "x", "KS")], "facility_id long, company_id long, name string, city string, state string")
    assert sorted(r["facility_id"] for r in entities.name_conflicts(facility, ids).collect()) == [11, 13]
    company = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "company_id long, name string")
    kept, moved = entities.deactivate(company, ids, facility)
    assert sorted(r["company_id"] for r in kept.collect()) == [1, 2, 3]
    assert {r["facility_id"]: r["company_id"] for r in moved.collect()} == {10: 1, 11: 2, 12: 1, 13: 3}
    kept, moved = entities.deactivate(company, ids, facility, on_conflict="delete")
    assert [r["company_id"] for r in kept.collect()] == [1]
    assert sorted(r["facility_id"] for r in moved.collect()) == [10, 12]


def test_merge_targets(spark):
    schema = "facility_id long, company_id long, name string, address string, city string, state string, postal_code string, phone string, website string, notes string, lon double, lat double, status string"
    row = lambda i, c, name, city=None, status="ACTIVE": (i, c, name, None, city, "KS", None, None, None, None, None, None, status)
    facility = spark.createDataFrame([row(1, 1, "A"), row(2, 1, "A2", ""), row(3, 1, "B"), row(4, 1, "B2"), row(5, 1, "X", "", "INACTIVE"), row(6, 2, "C"), row(7, 2, "C2"), row(8, 9, "Y")], schema)
    groups = [("g1", 2, [1, 2], "A"), ("g2", 3, [3, 4], "X"), ("g3", 6, [6, 7], "Y")]
    proposals = spark.createDataFrame([(g, b, m, n, None, None, "KS", None, None, None, None, None, None, "ACTIVE") for g, b, m, n in groups], "group_key string, base_id long, member_ids array<long>, name string, address string, city string, state string, postal_code string, phone string, website string, notes string, lon double, lat double, status string")
    out = entities.apply_merge(facility, proposals)
    assert sorted((r["old_id"], r["new_id"]) for r in out["ids"].collect()) == [(2, 1), (3, 5), (4, 5), (6, 9), (7, 9)]
    rows = {r["facility_id"]: (r["company_id"], r["name"], r["status"]) for r in out["facility"].collect()}
    assert rows == {1: (1, "A", "ACTIVE"), 2: (1, "A2", "INACTIVE"), 3: (1, "B", "INACTIVE"), 4: (1, "B2", "INACTIVE"), 5: (1, "X", "ACTIVE"), 6: (2, "C", "INACTIVE"), 7: (2, "C2", "INACTIVE"), 8: (9, "Y", "ACTIVE"), 9: (2, "Y", "ACTIVE")}


def test_regions_over_the_edges_of_a_raster(spark):
    from acrelane.operators import crops

    pixels = spark.createDataFrame([(c, r, 1 + y, 2000 + y) for c in range(6) for r in range(6) for y in range(2)], "col_no int, row_no int, code int, year int")
    box = lambda x0, y0, x1, y1: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]
    regions = spark.createDataFrame([(1, box(0.0, -6.0, 6.0, -3.0)), (2, box(-2.0, -2.0, 2.0, 2.0)), (3, box(4.0, 4.0, 9.0, 9.0)), (4, box(0.0, 7.0, 6.0, 9.0))], "region_id int, rings array<array<struct<x: double, y: double>>>")
    got = {(r["region_id"], r["year"], r["code"]): r["pixel_count"] for r in crops.zonal_counts(pixels, regions, skip=(), min_pixels=0).collect()}
    assert got == {(k, 2000 + y, 1 + y): 4 for k in (2, 3) for y in range(2)}


def test_tiles_open_outlines_only(spark):
    from acrelane.operators import crops

    size = 256
    pixels = spark.range(size * size).selectExpr("cast(id % 256 as int) col_no", "cast(id div 256 as int) row_no", "cast(1 + (id * 7919) % 5 as int) code", "cast(2000 + id % 2 as int) year")
    circle = lambda x, y, r: [(x + r * math.cos(k * math.pi / 32), y + r * math.sin(k * math.pi / 32)) for k in range(64)]
    rings = [(1, [circle(120.0, 120.0, 100.0)]), (2, [circle(200.3, 90.7, 90.0), circle(190.0, 80.0, 30.0)]), (3, [[(-40.0, -40.0), (300.0, -40.0), (300.0, 300.0), (-40.0, 300.0)]]), (4, [[(3.0, 3.0), (3.4, 3.0), (3.4, 3.4)]])]
    regions = spark.createDataFrame(rings, "region_id int, rings array<array<struct<x: double, y: double>>>")
    told = lambda df: {(r["region_id"], r["year"], r["code"]): (r["pixel_count"], r["acres"]) for r in df.collect()}
    want = told(crops.zonal_counts(pixels, regions, nodata=5, min_pixels=1))
    for tile in (4, 16, 100):
        tiles = crops.tile_histograms(pixels, tile, nodata=5)
        assert told(crops.tiled_counts(pixels, tiles, regions, tile, nodata=5, min_pixels=1)) == want
    whole, spans = crops.tile_spans(regions.filter("region_id = 1"), 4)
    opened = spans.agg(F.sum(F.col("to_col") - F.col("from_col"))).first()[0]
    # a circle's outline of 628 pixels touches some 2 * 628 / 4 tiles of 16
    assert whole.count() > 1500 and opened < 3 * 628 * 4


def test_csv_is_read_as_usual(spark, tmp_path):
    from acrelane.sources import sinks

    df = spark.createDataFrame([(i, f"n{i}") for i in range(9)], "a long, b string").repartition(3)
    sinks.write_csv(df, str(tmp_path / "x"))
    sinks.write_csv(df, str(tmp_path / "x"), append=True)
    assert sorted(r["a"] for r in spark.read.schema("a long, b string").option("header", True).csv(str(tmp_path / "x")).collect()) == sorted([*range(9)] * 2)


def test_empty_geojson_is_an_error(spark, tmp_path):
    (tmp_path / "e.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    try:
        readers.read_geojson(spark, str(tmp_path / "e.geojson"), "id string")
    except ValueError as error:
        assert "no feature" in str(error)
    else:
        raise AssertionError("no error")


def plain_reach(urls, arcs, found, max_pages=50, enough=10):
    """{site: [page, ...]} in the order of visits; urls: page -> (site, address), arcs: page -> [(pos, address)]."""
    at, homes = {}, {}
    for page in sorted(urls):
        at.setdefault(urls[page][1], page)
        homes.setdefault(urls[page][0], page)
    out = {}
    for site, home in homes.items():
        queue, order, met = [home], [], 0
        while queue and len(order) < max_pages:
            page = queue.pop(0)
            if page in order:
                continue
            order.append(page)
            met += page in found
            if met < enough:
                queue += [at[d] for _, d in sorted(arcs.get(page, []), key=lambda x: (x[0], at.get(x[1], 0))) if d in at and urls[at[d]][0] == site]
        out[site] = order
    return out


def test_site_reach_ends_after_enough_pages(spark):
    urls = {i: ("a.example.com", f"https://a.example.com/{i}") for i in range(30)}
    arcs = {i: [(0, urls[j][1]) for j in (2 * i + 1, 2 * i + 2) if j < 30] for i in range(30)}
    arcs = {i: [(k, d) for k, (_, d) in enumerate(ds)] for i, ds in arcs.items()}
    p = spark.createDataFrame([(i, u, "") for i, (_, u) in urls.items()], "page_id long, url string, html string")
    links = spark.createDataFrame([(i, urls[i][1], k, d) for i, ds in arcs.items() for k, d in ds], "page_id long, src_url string, pos int, dst_url string")
    for good, enough in (([1, 2, 3], 3), ([1, 2, 3], 4), ([0], 1), ([5, 6, 20], 2)):
        found = spark.createDataFrame([(g,) for g in good + good[:1]], "page_id long")
        got = [r["page_id"] for r in sorted(pages.site_reach(p, links, found=found, enough=enough).collect(), key=lambda r: r["rank"])]
        assert got == plain_reach(urls, arcs, set(good), enough=enough)["a.example.com"], (good, enough)


def test_site_reach_query_is_breadth_first(spark, sf_dir):
    from acrelane.plans import registry
    from acrelane.plans.graph_queries import page_arcs

    t = registry.Tables(spark, sf_dir)
    urls = {r["page_id"]: (r["site"], r["u"]) for r in t("pages").select("page_id", pages.host(F.col("url")).alias("site"), pages.bare_url(F.col("url")).alias("u")).collect()}
    arcs = defaultdict(list)
    for r in page_arcs(t).collect():
        arcs[r["page_id"]].append((r["pos"], r["dst_url"]))
    found = {r["page_id"] for r in pages.score_pages(t("bid_pages")).collect()}
    got = defaultdict(list)
    for r in sorted(registry.QUERIES["site_reach"](spark, sf_dir).collect(), key=lambda r: r["rank"]):
        got[r["site"]].append(r["page_id"])
    assert found and got == plain_reach(urls, arcs, found)


def test_cells_are_dijkstra(spark):
    rng = random.Random(7)
    wide, high = 9, 20
    pairs = [(wide * y + x, wide * y + x + 1) for y in range(high) for x in range(wide - 1)] + [(wide * y + x, wide * y + x + wide) for y in range(high - 1) for x in range(wide)]
    # ties in time and in both, edges of no weight, one-way and missing ones
    edges = [(a, b, float(rng.randint(0, 3)), float(rng.randint(0, 3))) for p in pairs for a, b in (p, p[::-1]) if rng.random() < 0.9] + [(5, 6, 9.0, 9.0), (300, 301, 1.0, 1.0)]
    df = spark.createDataFrame([*edges, (0, 179, None, 1.0)], "src long, dst long, travel_time double, length_m double")
    places = spark.createDataFrame([(i, (i % wide) * 0.01, (i // wide) * 0.01) for i in range(wide * high)] + [(300, None, None)], "node long, lon double, lat double")
    targets = [rng.randrange(wide * high) for _ in range(15)] + [301, 9999]
    asked = [(rng.randrange(wide * high), t) for t in targets * 3] + [(300, 301), (0, 301), (9999, 9999), (9998, 9999)]
    ways = heap_search(edges, set(targets))
    given = spark.createDataFrame([(t,) for t in targets], "node long")
    for wanted, want in ((None, ways), (spark.createDataFrame(asked, "node long, target long"), {(t, n): ways[t, n] for n, t in asked if (t, n) in ways})):
        times = cells.CellTimes(df, places, given, wanted, cell_nodes=40, border_nodes=40, top_nodes=10)
        assert times.levels > 1
        rows = times.rows().collect()
        assert {(r["target"], r["node"]): (int(r["t"]), int(r["m"])) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("given_pairs", [False, True])
def test_no_ways_are_stored_between_levels(spark, monkeypatch, given_pairs):
    """Stored are the graph and what cells reach, whose rows follow the graph; the ways of border nodes to all targets were stored at each level."""
    stored = {}

    def counted(df, label, put=cells.written):
        out = put(df, label)
        stored.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(cells, "written", counted)
    monkeypatch.setattr(cells, "UNIT_TARGETS", 400)  # several blocks
    rng = random.Random(9)
    wide, high = 6, 30
    pairs = [(wide * y + x, wide * y + x + 1) for y in range(high) for x in range(wide - 1)] + [(wide * y + x, wide * y + x + wide) for y in range(high - 1) for x in range(wide)]
    edges = [(a, b, float(rng.randint(1, 9)), float(rng.randint(1, 9))) for p in pairs for a, b in (p, p[::-1])]
    df = spark.createDataFrame(edges, "src long, dst long, travel_time double, length_m double")
    places = spark.createDataFrame([(i, (i % wide) * 0.01, (i // wide) * 0.01) for i in range(wide * high)], "node long, lon double, lat double")
    targets = list(range(0, wide * high, 2))
    asked = spark.createDataFrame([(n, t) for n in range(0, wide * high, 5) for t in targets if (n + t) % 3], "node long, target long") if given_pairs else None
    times = cells.CellTimes(df, places, spark.createDataFrame([(t,) for t in targets], "node long"), asked, cell_nodes=24, border_nodes=40, top_nodes=30)
    assert times.levels > 1
    rows = times.rows().collect()
    want = {(t, n): w for (t, n), w in heap_search(edges, set(targets)).items() if not given_pairs or n % 5 == 0 and (n + t) % 3}
    assert {(r["target"], r["node"]): (int(r["t"]), int(r["m"])) for r in rows} == want and len(rows) == len(want)
    assert "times" not in stored and max(n for label, ns in stored.items() if label != "asked" for n in ns) < 4 * len(edges)


def test_drive_times_by_cells_and_without(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(1000), rng.randrange(1000), rng.uniform(0.1, 2), rng.uniform(1, 900)) for _ in range(2500)]
    df = spark.createDataFrame(edges, "src long, dst long, travel_time double, length_m double")
    places = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(1000)], "node long, lon double, lat double")
    seeds = [(1, 0), (2, 17), (3, 17)]
    got = told(routing.drive_times(df, spark.createDataFrame(seeds, "facility_id long, node long"), nodes=places))
    ways = heap_search(edges, {n for _, n in seeds})
    assert got == {(f, n): w for f, at in seeds for (start, n), w in ways.items() if start == at}
    with pytest.raises(cells.NoCells):  # neighbours that lie anywhere: then the hierarchy is taken
        cells.CellTimes(df, places, places.filter("node = 0"), cell_nodes=50, top_nodes=50)


def test_site_reach_judges_pages_that_are_reached(spark, sf_dir):
    urls = {i: ("a.example.com", f"https://a.example.com/{i}") for i in range(30)}
    arcs = {i: [(k, urls[j][1]) for k, j in enumerate((2 * i + 1, 2 * i + 2)) if j < 30] for i in range(30)}
    p = spark.createDataFrame([(i, u, "") for i, (_, u) in urls.items()], "page_id long, url string, html string")
    links = spark.createDataFrame([(i, urls[i][1], k, d) for i, ds in arcs.items() for k, d in ds], "page_id long, src_url string, pos int, dst_url string")
    asked = []

    def found(ids):
        asked.append(sorted(r["page_id"] for r in ids.collect()))
        return ids.filter("page_id in (1, 2, 4)")

    got = [r["page_id"] for r in sorted(pages.site_reach(p, links, found=found, enough=2).collect(), key=lambda r: r["rank"])]
    assert got == plain_reach(urls, arcs, {1, 2, 4}, enough=2)["a.example.com"] and sorted(sum(asked, [])) == sorted(got)


def test_page_arcs_reach_the_next_ids_of_a_site(spark, tmp_path):
    from acrelane.plans import registry
    from acrelane.plans.graph_queries import page_arcs

    ids = [0, 1, 118, 119, 120, 121, 239, 240, 241, 360, 1000]
    spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.example.com/{i}", "") for i in ids], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    arcs = page_arcs(registry.Tables(spark, str(tmp_path)))
    got = sorted((r["page_id"], r["pos"]) for r in arcs.collect())
    assert got == sorted((a, b) for a in ids for b in ids if a < b <= a + 120 and a % 2 == b % 2)
    assert "run" in arcs._jdf.queryExecution().optimizedPlan().toString()  # by runs, not by site alone
