"""Neighbourhoods against brute force, with a spot that holds a third of all points."""

import math

import numpy as np
import pytest

from chronoveil.operators import geo


def haversine(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_MILES * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def greedy(points, miles):
    kept = []
    for i in sorted(points):
        if all(haversine(points[i], points[j]) >= miles for j in kept):
            kept.append(i)
    return kept


def clouds():
    rng = np.random.default_rng(5)
    spread = {i: (float(34 + rng.random()), float(-120 + rng.random())) for i in range(160)}
    spot = {160 + i: (34.5, -119.5) for i in range(60)}
    near = {220 + i: (34.5 + float(rng.random()) / 100, -119.5 + float(rng.random()) / 100) for i in range(20)}
    dateline = {i: (float(60 + rng.random() / 2), float((179.8 + rng.random() / 2 + 180) % 360 - 180)) for i in range(80)}
    return [{**spread, **spot, **near}, dateline, {i: (40.0, -100 + 3 * i / 53.0) for i in range(12)}]


@pytest.mark.parametrize("case", range(3))
@pytest.mark.parametrize("miles", [5.0, 20.0])
def test_against_brute_force(spark, case, miles):
    pts = clouds()[case]
    rng = np.random.default_rng(case)
    ids = list(pts)
    rng.shuffle(ids)
    df = spark.createDataFrame([(int(i), *pts[i]) for i in ids], "id bigint, lat double, lng double")
    want = {(a, b) for a in pts for b in pts if a < b and haversine(pts[a], pts[b]) < miles}
    for bound in (geo._CELL_POINTS, 7):
        got = [(r["id_a"], r["id_b"]) for r in geo.close_pairs(df, miles, cell_points=bound).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert sorted(r["id"] for r in geo.separated_subset(df, miles).collect()) == greedy(pts, miles)


@pytest.mark.parametrize("case", ["line", "spot"])
def test_chains_and_spots_take_few_rounds(spark, monkeypatch, case):
    """A line of points in id order decides each other all along; a spot has more points in each cell than a round looks at."""
    rng = np.random.default_rng(1)
    if case == "line":
        pts = {i: (40.0, -100 + 0.03 * i) for i in range(200)}
    else:
        pts = {i: (34.5 + float(rng.random()) / 20, -119.5 + float(rng.random()) / 20) for i in range(900)}
    rounds = []
    plain = geo._round
    monkeypatch.setattr(geo, "_round", lambda *a: rounds.append(1) or plain(*a))
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "id bigint, lat double, lng double")
    got = sorted(r["id"] for r in geo.separated_subset(df, 5.0 if case == "line" else 0.7).collect())
    assert got == greedy(pts, 5.0 if case == "line" else 0.7)
    assert len(rounds) <= 6


def test_points_do_not_pass_through_the_driver(spark):
    """Copies at one place meet in parts of a bounded size, without a broadcast of points; only crowded cells are broadcast."""
    pts = {i: (34.5, -119.5) for i in range(40)} | {40 + i: (34.52, -119.5) for i in range(9)} | {60: (50.0, 10.0)}
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "id bigint, lat double, lng double")
    pairs = geo.close_pairs(df, 5.0, cell_points=6)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    broadcast = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert broadcast and not any(c in line for line in broadcast for c in ("_i#", "_part", "lat_"))
    want = {(a, b) for a in pts for b in pts if a < b and haversine(pts[a], pts[b]) < 5.0}
    got = [(r.id_a, r.id_b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
