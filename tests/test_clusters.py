"""Clusters against a plain reading of the rule, pair by pair."""

import random

from terrafold.operators import clusters


def plainly(points, finest, coarsest):
    """points: id to (x, y) in units."""
    level, out = [(1, x, y, i) for i, (x, y) in points.items()], []
    for z in range(finest, coarsest - 1, -1):
        side, radius, cells = clusters.CELL << 22 - z, clusters.RADIUS << 22 - z, {}
        for n, sx, sy, low in level:
            cells.setdefault((sx // n // side, sy // n // side), []).append((n, sx, sy, low))
        cells = [tuple(map(sum, zip(*((a, b, c) for a, b, c, _ in own)))) + (min(x[3] for x in own),) for own in cells.values()]
        choice = {}
        for n, sx, sy, low in cells:
            near = [c for c in cells if (c[1] // c[0] - sx // n) ** 2 + (c[2] // c[0] - sy // n) ** 2 <= radius**2]
            choice[low] = max(near, key=lambda c: (c[0], -c[3]))[3]
        groups = {}
        for c in cells:
            chosen = choice[c[3]]
            groups.setdefault(chosen if choice[chosen] == chosen else c[3], []).append(c)
        level = [tuple(sum(c[k] for c in own) for k in range(3)) + (min(c[3] for c in own),) for own in groups.values()]
        out += [(z, sx // n >> 22 - z, sy // n >> 22 - z, n, low) for n, sx, sy, low in level]
    return sorted(out)


def test_clusters_follow_the_rule(spark):
    some = random.Random(2)
    rows = [(k, 35 + some.gauss(0, 0.02 if k % 3 else 2), 139 + some.gauss(0, 0.02 if k % 3 else 2)) for k in range(300)] + [(1000 + k, 34.5, 135.5) for k in range(400)]
    frame = spark.createDataFrame([*rows, (5000, float("nan"), 1.0), (5001, None, 1.0)], "id long, latitude double, longitude double")
    places = {r["low"]: (r["sx"], r["sy"]) for r in clusters.placed(frame).collect()}
    expected = plainly(places, 12, 7)
    for parts in (1, 5):
        found = clusters.clusters(frame.repartition(parts, "latitude"), 12, 7).collect()
        assert sorted(map(tuple, found)) == expected
    assert all(sum(r[3] for r in expected if r[0] == z) == 700 for z in range(7, 13))
    sizes = [sum(r[0] == z for r in expected) for z in range(7, 13)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]


def test_no_markers(spark):
    assert clusters.clusters(spark.createDataFrame([], "id long, latitude double, longitude double"), 9, 8).collect() == []
