"""Clusters by successor pointers against a plain walk."""

import math
import random

from acrelane.functions.geo import MERCATOR_R
from acrelane.operators import clusters, entities
from acrelane.shared import in_ranges


def _metres(a, b):
    if None in (*a, *b):
        return None
    y = [math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2)) * MERCATOR_R for p in (a, b)]
    return math.hypot(math.radians(a[0] - b[0]) * MERCATOR_R, y[0] - y[1])


def _walk(rows, metres):
    """{(group, cluster, id)} of clusters of two and more."""
    out, by_group = {}, {}
    for key, i, lon, lat in rows:
        if key is not None:
            by_group.setdefault(key, []).append((i, lon, lat))
    for key, members in by_group.items():
        no, head = -1, None
        for i, lon, lat in sorted(members):
            far = head is not None and (_metres(head, (lon, lat)) or 0) > metres
            if head is None or far:
                no, head = no + 1, (lon, lat)
            out.setdefault((key, no), []).append(i)
    return {(key, no, i) for (key, no), ids in out.items() if len(ids) > 1 for i in ids}


def _rows(seed=3):
    """Groups that are tight, that spread over a disc about as wide as the limit, that wander, that jump back and forth, without a first point, and small ones."""
    rng, rows, i = random.Random(seed), [], 0

    def add(key, n, place, unknown=0.05):
        nonlocal i
        for k in range(n):
            i += rng.randint(1, 3)
            lon, lat = place(k)
            rows.append((key, i, None if rng.random() < unknown else lon, None if rng.random() < unknown / 2 else lat))

    add("tight", 300, lambda k: (-98.0, 38.0))
    add("disc", 700, lambda k: (-98 + rng.uniform(-0.0016, 0.0016), 38 + rng.uniform(-0.0012, 0.0012)))
    add("wander", 500, lambda k: (-98 + k * 0.0004, 38.0), 0.1)
    add("jump", 200, lambda k: (-98 + (k % 2) * 0.01, 38.0), 0)
    add("late", 280, lambda k: (-98.0 + (0.01 if k == 277 else 0), 38.0), 0)
    rows.append(("headless", 1, None, None))
    add("headless", 90, lambda k: (-98 + rng.random(), 38.0))
    add("one", 1, lambda k: (-98.0, 38.0), 0)
    add("pair", 2, lambda k: (-98.0, 38.0), 0)
    add(None, 3, lambda k: (-98.0, 38.0), 0)
    rng.shuffle(rows)
    return rows


SCHEMA = "group_key string, facility_id bigint, lon double, lat double"


def test_pointers_and_fold_are_the_plain_walk(spark):
    rows = _rows()
    want = _walk(rows, 250.0)
    groups = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for folded in (0, 250, 10_000):  # all by pointers, some, none
        got = entities.split_clusters(groups, 250.0, folded)
        found = [tuple(r) for r in got.select("group_key", "cluster_no", "facility_id").collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_empty_groups(spark):
    assert entities.split_clusters(spark.createDataFrame([], SCHEMA), folded=0).count() == 0
    assert clusters.split_by_pointers(spark.createDataFrame([], SCHEMA), 250.0).count() == 0


def test_a_group_spreads_over_ranges(spark):
    """One group only: its members are numbered over several tasks, without a gap."""
    groups = spark.range(20_000).selectExpr("'g' AS group_key", "id AS facility_id", "-98E0 + (id % 3) * 0.01E0 AS lon", "38E0 AS lat")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put in one task
    try:
        assert in_ranges(groups, "group_key", "facility_id").select("_part").distinct().count() > 1
        placed = clusters.ranked(groups)
        assert placed.selectExpr("count(DISTINCT rank)", "min(rank)", "max(rank)", "count_if(rank <> facility_id)").first()[:] == (20_000, 0, 19_999, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
