import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry
from quadrille.operators import select

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[3, 3], [7, 3], [7, 7], [3, 7], [3, 3]]


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id int, minx double, miny double, maxx double, maxy double")


def test_a_polygon_with_a_hole(spark):
    rows = [(4, 4, 6, 6), (2, 2, 8, 8), (3.5, 3.5, 7, 5), (10, 10, 12, 12), (10.5, 0, 11, 1), (-5, -5, 15, 15), (1, 1, 2, 2), (-1, 5, 11, 5.5)]
    for shape in ({"type": "Polygon", "coordinates": [SQUARE, HOLE]}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [SQUARE[:-1], HOLE]}}, {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [[[100, 0], [101, 0], [101, 1]]]]}):
        got = {r["id"] for r in select.search(boxes(spark, rows), intersects=json.dumps(shape)).collect()}
        assert got == {1, 2, 3, 5, 6, 7}  # the first lies within the hole
        e = boxes(spark, rows).withColumn("e", geometry.edges_of_geojson(F.lit(json.dumps(shape))))
        assert {r["id"] for r in e.filter(geometry.meets_box(F.col("e"), [F.col(c) for c in ("minx", "miny", "maxx", "maxy")])).collect()} == got
    with pytest.raises(KeyError):
        select.search(boxes(spark, rows), intersects=json.dumps({"type": "Point", "coordinates": [1, 1]}))
    none = spark.range(1).select(geometry.edges_of_geojson(F.lit('{"type": "Point", "coordinates": [1, 1]}')).alias("e"))
    assert none.head()["e"] is None


def model(ring, box):
    """Whether they share a point, by clipping every edge to the box."""
    a, b, c, d = box

    def clipped(p, q):
        t0, t1 = 0.0, 1.0
        for s, o, lo, hi in ((q[0] - p[0], p[0], a, c), (q[1] - p[1], p[1], b, d)):
            if s == 0:
                if not lo <= o <= hi:
                    return False
                continue
            u, v = sorted(((lo - o) / s, (hi - o) / s))
            t0, t1 = max(t0, u), min(t1, v)
        return t0 <= t1

    pairs = list(zip(ring, ring[1:] + ring[:1], strict=True))
    odd = sum((p[1] > b) != (q[1] > b) and a < p[0] + (q[0] - p[0]) * (b - p[1]) / (q[1] - p[1]) for p, q in pairs) % 2
    return any(clipped(p, q) for p, q in pairs) or bool(odd)


def test_many_areas_equal_a_model_and_join_by_cell(spark):
    rng = random.Random(3)
    items = [(x, y, x + rng.uniform(0, 9), y + rng.uniform(0, 9)) for x, y in ((rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(300))]
    rings = []
    for _ in range(40):
        x, y = rng.uniform(-35, 35), rng.uniform(-35, 35)
        rings.append([[x + rng.uniform(-12, 12), y + rng.uniform(-12, 12)] for _ in range(rng.randint(3, 7))])
    areas = spark.createDataFrame(list(enumerate(rings)), "area int, ring array<array<double>>").select("area", geometry.edges_of_ring(F.col("ring")).alias("edges"))
    df = boxes(spark, items).unionByName(spark.createDataFrame([(999, None, None, None, None)], "id int, minx double, miny double, maxx double, maxy double"))
    got = select.search_areas(df, areas, cell=4.0)
    assert got.columns == ["id", "minx", "miny", "maxx", "maxy", "area", "edges"]
    pairs = [(r["area"], r["id"]) for r in got.collect()]
    want = {(k, i) for k, ring in enumerate(rings) for i, box in enumerate(items) if model(ring, box)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
