"""Road graphs from mapped ways."""

import math
import random
from collections import defaultdict

from acrelane.operators import roads, routing
from acrelane.sources import readers


def osm(nodes, ways):
    body = "".join(f'<node id="{i}" lon="{x}" lat="{y}"/>' for i, x, y in nodes)
    for i, (refs, tags) in enumerate(ways):
        body += f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in tags.items()) + "</way>"
    return f"<osm>{body}</osm>"


def apart(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371009.0 * math.asin(math.sqrt(h))


def test_chain_loop_one_way_and_island(spark, tmp_path):
    at = {i: (-98 + i * 0.01, 38 + (i % 3) * 0.01) for i in range(1, 20)}
    ways = [
        ([1, 2, 3, 4], {"highway": "primary"}),  # a chain of two ways that goes on
        ([4, 5], {"highway": "track", "surface": "dirt"}),
        ([5, 6, 7], {"highway": "residential", "oneway": "yes"}),
        ([8, 7], {"highway": "residential", "oneway": "-1"}),  # runs from 7 to 8
        ([5, 9, 9, 10], {"highway": "secondary"}),
        ([10, 11, 12, 10], {"highway": "tertiary", "junction": "roundabout"}),  # a loop that begins and ends at 10
        ([15, 16], {"highway": "primary"}),  # an island
        ([5, 13], {"building": "yes"}),  # no road
        ([5, 99], {"highway": "primary"}),  # an end that is not there
    ]
    (tmp_path / "m.osm").write_text(osm([(i, *p) for i, p in at.items()], ways))
    nodes, edges = readers.read_road_graph(spark, str(tmp_path / "m.osm"))
    length = lambda *path: sum(apart(at[a], at[b]) for a, b in zip(path, path[1:], strict=False))
    want = {
        (1, 5): (length(1, 2, 3, 4, 5), ["primary", "track"], ["dirt"]),
        (5, 1): (length(1, 2, 3, 4, 5), ["track", "primary"], ["dirt"]),
        (5, 8): (length(5, 6, 7, 8), ["residential"], None),
        (5, 10): (length(5, 9, 10), ["secondary"], None),
        (10, 5): (length(5, 9, 10), ["secondary"], None),
        (10, 10): (length(10, 11, 12, 10), ["tertiary"], None),
    }
    got = {(r["src"], r["dst"]): (r["length_m"], r["highway"], r["surface"]) for r in edges.collect()}
    assert got.keys() == want.keys() and edges.count() == len(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1:] == want[k][1:] for k in want)
    assert sorted(r["node"] for r in nodes.collect()) == [1, 5, 8, 10]
    assert {r["mph"] for r in routing.edge_times(edges).filter("src = 1").collect()} == {55.0}
    clipped = readers.read_road_graph(spark, str(tmp_path / "m.osm"), (at[10][0] - 0.001, 37, at[10][0] + 0.001, 39))
    assert {(r["src"], r["dst"]) for r in clipped[1].collect()} == {(5, 10), (10, 5), (10, 10)}


def test_components_are_the_least_nodes(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 200) if i % 40] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    group = {}
    for a, b in pairs:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    got = {r["node"]: r["component"] for r in roads.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: min(g) for n, g in group.items()}


def test_rings_and_long_chains(spark):
    row = lambda a, b, i: (a, b, 1.0, "track", None, 1, i, False)
    schema = "src long, dst long, length_m double, highway string, surface string, way long, step int, back boolean"
    chain = [row(i, i + 1, i) for i in range(100)]
    ring = [row(200 + i, 200 + (i + 1) % 5, 200 + i) for i in range(5)]
    got = sorted((r["src"], r["dst"], r["length_m"]) for r in roads.simplify(spark.createDataFrame(chain + ring, schema)).collect())
    assert got == [(0, 100, 100.0), *sorted((a, b, 1.0) for a, b, *_ in ring)]


def test_ways_of_a_whole_table(spark, sf_dir):
    """The graph of the query against a plain walk along every chain."""
    from acrelane.plans import registry
    from acrelane.plans.source_queries import mapped_ways

    t = registry.Tables(spark, sf_dir)
    at = {r["node"]: (r["lon"], r["lat"]) for r in t("nodes").collect()}
    steps = [(a, b, w["highway"]) for w in mapped_ways(t).collect() for a, b in ([(w["refs"][0], w["refs"][1])] if w["oneway"] else [tuple(w["refs"]), tuple(w["refs"][::-1])])]
    out, beside, degree = defaultdict(list), defaultdict(set), defaultdict(int)
    for a, b, h in steps:
        out[a].append((b, h))
        beside[a].add(b), beside[b].add(a)
        degree[a] += 1
        degree[b] += 1
    into = {b for _, b, _ in steps}
    stop = {n for n in beside if not out[n] or n not in into or not (len(beside[n]) == 2 and degree[n] in (2, 4))}
    want = []
    for a in stop:
        for b, h in out[a]:
            path, tags = [a, b], [h]
            while path[-1] not in stop:
                nxt = [(n, k) for n, k in out[path[-1]] if n != path[-2]]
                path.append(nxt[0][0])
                tags.append(nxt[0][1])
            want.append((path[0], path[-1], round(sum(apart(at[x], at[y]) for x, y in zip(path, path[1:], strict=False)), 3), ",".join(dict.fromkeys(tags))))
    got = [(r["src"], r["dst"], r["length_m"], r["highway"]) for r in registry.QUERIES["src_road_map"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(got) < len(steps)


def test_rounds_hold_what_is_left(spark, monkeypatch):
    """Links get fewer from round to round, and edges between junctions take no part in the doubling."""
    wide, high, sizes = 20, 20, defaultdict(list)
    plain = roads.written

    def counted(df, label):
        out = plain(df, label)
        sizes[label].append(out.count())
        return out

    monkeypatch.setattr(roads, "written", counted)
    pairs = [(wide * y + x, wide * y + x + 1) for y in range(high) for x in range(wide - 1)] + [(wide * y + x, wide * y + x + wide) for y in range(high - 1) for x in range(wide)]
    pairs += [(10, 1000), (1000, 1001), (1001, 1002)] + [(2000 + i, 2000 + (i + 1) % 4) for i in range(4)]
    rows = [(a, b, 1.0, "track", None, k, 0, a > b) for k, p in enumerate(pairs) for a, b in (p, p[::-1])]
    df = spark.createDataFrame(rows, "src long, dst long, length_m double, highway string, surface string, way long, step int, back boolean")
    of = {r["node"]: r["component"] for r in roads.components(df).collect()}
    assert of == {n: 2000 if n >= 2000 else 0 for p in pairs for n in p}
    assert sum(sizes["links"]) < 2.5 * sizes["links"][0]
    got = sorted((r["src"], r["dst"], r["length_m"]) for r in roads.simplify(df).collect())
    corners = {0: (1, wide), wide - 1: (wide - 2, 2 * wide - 1), wide * (high - 1): (wide * (high - 2), wide * (high - 1) + 1), wide * high - 1: (wide * high - 2, wide * (high - 1) - 1)}
    want = [(a, b, 1.0) for p in pairs for a, b in (p, p[::-1]) if not {a, b} & ({1000, 1001} | corners.keys())]
    want += [(10, 1002, 3.0), (1002, 10, 3.0)] + [(a, b, 2.0) for p in corners.values() for a, b in (p, p[::-1])]
    assert got == sorted(want) and max(sizes["chains"]) < len(rows) / 10
