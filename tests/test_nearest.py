import random

from stradale.functions.geo import _inverse
from stradale.operators.validation import nearest


def test_far_points_against_all_pairs(spark):
    """Near, far, across the date line, in the north, on ties and without coordinates: each point has a row."""
    r = random.Random(7)
    nodes = [(k, 2.25 + r.random() / 100, 48.85 + r.random() / 50) for k in range(300)] + [(300, 179.9995, 10.0), (301, 25.0, 71.0), (303, 5.0, 5.0), (302, 5.0, 5.0)]
    points = [(k, 2.25 + r.random() / 50, 48.8 + r.random() * 4) for k in range(60)] + [(100, -179.9995, 10.0), (101, 25.001, 71.002), (102, 9.0, 9.0), (103, 60.0, -30.0), (104, 5.0, 5.0)]
    odd = [(200, None, 48.0), (201, float("nan"), 48.0), (202, 2.0, None)]
    want = {}
    for k, x, y in points:
        dist, _ = _inverse([x] * len(nodes), [y] * len(nodes), [n[1] for n in nodes], [n[2] for n in nodes])
        want[k] = min((round(float(d), 6), n[0]) for d, n in zip(dist, nodes))
    a = spark.createDataFrame(points + odd, "point_id long, px double, py double")
    b = spark.createDataFrame(nodes + [(999, None, None)], "node_id long, x double, y double")
    got = nearest(a, b).collect()
    assert len(got) == len(points) + len(odd)
    assert {r.point_id: (round(r.dist, 6), r.node_id) for r in got if r.dist is not None} == want
    assert nearest(a, b.limit(0)).where("node_id is null and dist is null").count() == len(points) + len(odd)
    assert nearest(a.limit(0), b).count() == 0
