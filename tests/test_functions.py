import math
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geo, text
from terrafold.operators import hits, measure
from terrafold.plans import measures
from terrafold.sources import packages
from terrafold.streaming import logins


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "term, body, hit",
    [("tokyo", "in TOKYO now", True), ("é", "É", False), ("%", "100%", True), ("%", "100", False), ("a%z", "a\nz", True), ("a_c", "abc", True), ("_", "a", False), ("abc\\", "x abc%", True), ("abc\\", "abc", False), ("a\\%b", "a%b", True), ("a\\%b", "axb", False), ("", "x", True)],
)
def test_search_terms(spark, term, body, hit):
    assert value(spark, text.matches(F.lit(body), term)) is hit


def test_search_reads_a_text_once(spark):
    """Against plain matching of wildcards, and on a text with very many beginnings of a term that never ends."""

    def like(p, s):
        """p: tokens, '%', '_' or (literal,)."""
        at = {0}
        for t in p:
            at = set(range(min(at), len(s) + 1)) if t == "%" and at else {i + 1 for i in at if i < len(s) and (t == "_" or s[i].lower() == t[0].lower())}
        return len(s) in at

    rng = random.Random(9)
    bodies = ["".join(rng.choice("aAb%_\n") for _ in range(rng.randrange(9))) for _ in range(300)]
    for term in ("a%b", "_a", "%%a", "a_%b", "a%b%a", "b%a\\", "a\\%b", "ab%%_a"):
        tokens, i = ["%", (term[0],)], 1
        while i < len(term):
            literal = term[i] == "\\"
            tokens.append(((term + "%")[i + 1],) if literal else term[i] if term[i] in "%_" else (term[i],))
            i += 1 + literal
        if i == len(term):
            tokens.append("%")
        found = [r.hit for r in spark.createDataFrame(list(enumerate(bodies)), "k int, x string").select("k", text.matches(F.col("x"), term).alias("hit")).orderBy("k").collect()]
        assert found == [like(tokens, s) for s in bodies], term
    start = time.time()
    assert value(spark, text.matches(F.repeat(F.lit("ab"), 500_000), "a%a%z")) is False
    assert time.time() - start < 20


def test_tiles(spark):
    rows = [(5, 31, 31, True), (5, 32, 0, False), (5, 0, 32, False), (3, -1, 2, False), (-1, 0, 0, False), (21, 7, 7, False), (None, 1, 1, None)]
    found = spark.createDataFrame([r[:3] for r in rows], "z int, x long, y long").select(geo.valid_tile(F.col("z"), F.col("x"), F.col("y")).alias("ok"))
    assert [r["ok"] for r in found.collect()] == [r[3] for r in rows]


@pytest.mark.parametrize("name, row", [("17.png", 17), ("17.webp", None), ("x17.png", None), (".png", None), ("17.png.png", None)])
def test_tile_rows(spark, name, row):
    assert value(spark, geo.tile_row(F.lit(name))) == row


def test_distance_and_labels(spark):
    degree = value(spark, geo.distance(F.lit(10.0), F.lit(20.0), F.lit(11.0), F.lit(20.0)))
    assert abs(degree - 6371000 * math.pi / 180) < 1e-3
    shown = {1234.5: "1.23 km", 99.96: "100.0 m", 1.45: "1.4 m", 0.35: "0.3 m", 0.25: "0.3 m", 100.5: "101 m", 999.5: "1000 m", 0.0: "0.0 m", -0.04: "-0.0 m", math.nan: "-", math.inf: "-", -math.inf: "-"}
    for meters, label in shown.items():
        assert value(spark, geo.distance_label(F.lit(meters))) == label, meters
    for area, label in {2_500_000.0: "2.50 km²", 1_005_000.0: "1.00 km²", 0.49999999999999994: "0 m²", 2.5: "3 m²", -2.5: "-2 m²", math.nan: "-", math.inf: "-", -math.inf: "-"}.items():
        assert value(spark, geo.area_label(F.lit(area))) == label, area
    assert value(spark, geo.distance_label(F.lit(None).cast("double"))) == "-"


def test_fixed_places_round_exact_values(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(3)
    numbers = [rng.randrange(10**6) / rng.choice([8, 10, 20, 64, 1000, 2000]) for _ in range(400)] + [1.005, 8.345, 1e-9, 123456.785]
    found = spark.createDataFrame([(x,) for x in numbers], "x double").select(*(text.fixed(F.col("x"), k).alias(f"p{k}") for k in (0, 1, 2, 5))).collect()
    for x, row in zip(numbers, found):
        for k in (0, 1, 2, 5):
            assert row[f"p{k}"] == str(Decimal(x).quantize(Decimal(1).scaleb(-k), ROUND_HALF_UP)), (x, k)


def test_ties_to_even_as_printf(spark):
    """Labels and sizes of numbers that lie between two texts, as SQL's printf shows them and as a browser does."""
    even = lambda f, x: value(spark, f(F.lit(float(x)), even=True))
    for k in range(-40, 2000):
        assert k % 100 or even(text.rounded, k + 0.5) == f"{k + 0.5:.0f}".replace("-0", "0")
    found = spark.range(4000).select(*(text.fixed(F.col("id") / 16, places, True).alias(f"p{places}") for places in (0, 1, 2, 3))).collect()
    assert [list(r) for r in found] == [[f"{k / 16:.{places}f}" for places in (0, 1, 2, 3)] for k in range(4000)]
    assert (even(geo.distance_label, 1125), even(geo.distance_label, 1375), value(spark, geo.distance_label(F.lit(1125.0)))) == ("1.12 km", "1.38 km", "1.13 km")
    assert (even(geo.area_label, 1625000), value(spark, geo.area_label(F.lit(1625000.0)))) == ("1.62 km²", "1.63 km²")
    assert (even(text.file_size, 769280), value(spark, text.file_size(F.lit(769280.0)))) == ("751.2 KB", "751.3 KB")
    # Half a step in the product, but the number itself is a little less or more.
    for x in (0.0005, 0.0015, 0.15, 0.45, 2.675):
        assert value(spark, text.fixed(F.lit(x), 3, True)) == f"{x:.3f}" and value(spark, text.fixed(F.lit(x), 1, True)) == f"{x:.1f}"


@pytest.mark.parametrize("function, given, expected", [
    (text.trimmed, "\t\u3000 a b\u00a0\n", "a b"), (text.blank_to_null, "\t\n\u2028", None), (text.password_ok, "éééééééé", True), (text.password_ok, "1234567", False),
    (text.base_name, "../a.png", "a.png"), (text.base_name, "x/a..png", None), (text.base_name, "a\\b.png", None), (text.base_name, "a/", ""),
    (text.content_type, "a.JPEG", "application/octet-stream"), (text.content_type, "a.PDF", "application/octet-stream"), (text.content_type, "a.JPG", "image/jpeg"), (text.content_type, ".png", "application/octet-stream"),
    (text.export_name, "a\u0085b", "a_b.json"), (text.export_name, " . ", "export.json"),
    (text.youtube_id, "https://www.youtube-nocookie.com/embed/abcdefghijk", "abcdefghijk"), (text.youtube_id, "https://youtu.be/abcdefghijk/", None), (text.youtube_id, "https://youtube.com/watch?v=bad&v=abcdefghijk", None),
    (text.link_kind, "https://a.example/x.pdf", "external"), (text.link_kind, "http://127.0.0.1/x.PDF", "pdf"), (text.link_kind, "x.pdf", "pdf"), (text.link_kind, "HTTP://a.example", "internal"), (text.link_kind, "x.pdf\n", "internal"),
    (text.is_download, "/a/b.CSV", True), (text.is_download, "/a/b.csv?x", False), (text.is_localhost, "http://[::1]:8080/", True), (text.is_localhost, "http://localhost.example/", False),
])
def test_text_rules(spark, function, given, expected):
    assert value(spark, function(F.lit(given))) == expected


def test_cookies(spark):
    found = value(spark, text.cookies(F.lit("a = 1;b=2; a=3; c; d=e=f;\tg=\u3000 h ")))
    assert found == {"a": "1", "b": "2", "g": "h"}


def test_cache_control(spark):
    told = lambda x: tuple(value(spark, text.cache_control(F.lit(x))))
    assert told(" PRIVATE, max-age=60 ") == ("private", 60, "private, max-age=60", None)
    assert told("privately") == ("private", None, "private", None)
    assert told("private, max-age=60, x")[3] == "Invalid max-age value" and told(f"private max-age={2**64}")[0] is None
    assert told("max-age=60")[3] == "Unknown cache control: max-age=60"


def test_first_rings(spark):
    ring = lambda kind, text: value(spark, geo.first_ring(F.lit(kind), F.lit(text)))
    assert ring("Polygon", "[[[1,2],[3,4]],[[5,6]]]") == [[1.0, 2.0], [3.0, 4.0]]
    assert ring("MultiPolygon", "[[[[1,2]],[[3,4]]],[[[5,6]]]]") == [[1.0, 2.0]]
    assert ring("LineString", "[[1,2]]") == [[1.0, 2.0]] and ring("Polygon", "[]") is None


def test_circles_and_large_shapes_are_hit(spark):
    """A circle counts within its radius and the tolerance; a shape far larger than a cell is met from its middle."""
    clicks = spark.createDataFrame([(1, 35.0, 139.0), (2, 35.0, 139.02)], "click_id int, lat double, lng double")
    shapes = spark.createDataFrame([(1, "circle", 10.0), (2, "circle", None), (3, "polygon", None), (4, "polyline", None)], "id int, shape_type string, radius double").withColumn("created_at", F.lit(0))
    corners = [(3, 1, 20.0, 120.0), (3, 2, 50.0, 120.0), (3, 3, 50.0, 160.0), (3, 4, 20.0, 160.0), (4, 1, 35.0, 138.99), (4, 2, 35.0, 139.001)]
    vertices = spark.createDataFrame([(1, 1, 35.0, 139.001), (2, 1, 35.0, 139.0), *corners], "shape_id int, seq int, lat double, lng double")
    found = {(r["click_id"], r["shape_id"]): r["pixels"] for r in hits.hit_shapes(clicks, shapes, vertices, 14).collect()}
    assert found == {(1, 1): 0.0, (1, 3): 0.0, (1, 4): 0.0, (2, 3): 0.0}


def test_crowded_cells_meet_in_full(spark):
    """More clicks and shapes in one place than a packed row holds, against all pairs; a shape with a single vertex, and one whose edges lie on a line."""
    rng = random.Random(2)
    clicks = [(k, 35 + rng.random() / 10, 139 + rng.random() / 10) for k in range(1100)]
    kinds = {k: ("polygon", "polyline", "rectangle", "circle")[k % 4] for k in range(400)}
    corners = {k: [(35 + rng.random() / 10, 139 + rng.random() / 10) for _ in range(rng.randrange(1, 6))] for k in kinds}
    corners[0] = [(35.05, 139.0), (35.05, 139.1), (35.05, 139.02)]
    flat = lambda lat, lng: (6378137 * math.radians(lng) * 1048576 / (2 * math.pi * 6378137), -6378137 * math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / 2 * 1048576 / (2 * math.pi * 6378137))
    expected = {}
    for c, *at in clicks:
        px, py = flat(*at)
        for k, kind in kinds.items():
            p = [flat(*v) for v in corners[k]]
            if kind == "circle":
                if math.dist((px, py), p[0]) <= 5 + k % 30 + 18:
                    expected[c, k] = (True, 0.0)
                continue
            edges = list(zip(p, p[1:] + p[:1]))[: len(p) - 1 if kind == "polyline" and len(p) > 1 else None]
            odd, away = False, math.inf
            for (ax, ay), (bx, by) in edges:
                odd ^= (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax
                n = (bx - ax) ** 2 + (by - ay) ** 2
                t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n)) if n else 0
                away = min(away, math.dist((px, py), (ax + t * (bx - ax), ay + t * (by - ay))))
            if (odd and kind != "polyline") or away <= 18:
                expected[c, k] = (odd and kind != "polyline", 0.0 if odd and kind != "polyline" else away)
    shapes = spark.createDataFrame([(k, kind, float(5 + k % 30) if kind == "circle" else None, k % 7) for k, kind in kinds.items()], "id int, shape_type string, radius double, created_at int")
    vertices = spark.createDataFrame([(k, i, *v) for k, own in corners.items() for i, v in enumerate(own)], "shape_id int, seq int, lat double, lng double")
    met = hits.hit_shapes(spark.createDataFrame(clicks, "click_id int, lat double, lng double"), shapes, vertices, 12)
    found = {(r.click_id, r.shape_id): (r.inside, r.pixels) for r in met.collect()}
    assert found.keys() == expected.keys() and all(found[k][0] == x and abs(found[k][1] - y) < 1e-6 for k, (x, y) in expected.items()) and len(found) == met.count()
    best = {r.click_id: r.shape_id for r in hits.nearest(met).collect()}
    least = {}
    for (c, k), (_, pixels) in expected.items():
        least[c] = max(least.get(c, (-math.inf, 0, 0)), (-pixels, k % 7, k))
    assert best == {c: k for c, (_, _, k) in least.items()}


def _hit_views(spark):
    """200 clicks, some at vertices and on edges, and 120 shapes of all kinds in one place, many of them created at the same time."""
    rng = random.Random(5)
    place = lambda: (35 + rng.randrange(100) / 1000, 139 + rng.randrange(100) / 1000)
    kinds = ("polygon", "polyline", "rectangle", "circle")
    clicks = spark.createDataFrame([(k, *place()) for k in range(200)] + [(200, 35.05, 140.0), (201, float("nan"), 139.0)], "click_id int, lat double, lng double")
    shapes = spark.createDataFrame([(k, kinds[k % 4], float(5 + k % 30) if k % 4 == 3 else None, None if k % 9 == 0 else k % 3) for k in range(120)], "id int, shape_type string, radius double, created_at int")
    vertices = spark.createDataFrame([(k, i, *place()) for k in range(120) for i in range(rng.randrange(1, 7))], "shape_id int, seq int, lat double, lng double")
    return clicks, shapes, vertices, 12


def test_nearest_shapes_are_those_of_all_pairs(spark, data, monkeypatch):
    """Leaves and blocks of few clicks, batches of few shapes; the query copies no click over cells and gives at most a row for a click and task to the shuffle."""
    monkeypatch.setattr(hits, "LEAF", 8)
    monkeypatch.setattr(hits, "BLOCK", 90)
    monkeypatch.setattr(hits, "FIRST", 2)
    views = _hit_views(spark)
    expected = {tuple(r) for r in hits.nearest(hits.hit_shapes(*views)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = hits.nearest_shapes(*views).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in found} == expected and len(found) == len(expected) > 150
    plan = measures.nearest_shape(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_hit_totals_are_those_of_all_pairs(spark, data, monkeypatch):
    """Parts and blocks of few clicks, where most shapes hold a part as a whole or have one edge beside it; the query copies no click over cells."""
    monkeypatch.setattr(hits, "LEAF", 16)
    monkeypatch.setattr(hits, "PART", 2)
    monkeypatch.setattr(hits, "BLOCK", 90)
    monkeypatch.setattr(hits, "SUMMED", 50)
    views = _hit_views(spark)
    pairs = hits.hit_shapes(*views).groupBy("click_id").agg(F.count("*"), F.count_if("inside"), F.sum("pixels"))
    expected = {r[0]: tuple(r[1:]) for r in pairs.collect()}
    found = {r[0]: tuple(r[1:]) for r in hits.hit_totals(*views).collect()}
    assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in expected.items()} and len(found) > 150
    assert all(abs(found[k][2] - expected[k][2]) < 1e-6 for k in found) and any(n != within for n, within, _ in found.values())
    plan = measures.point_in_polygon(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_group_centres(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 0.0, 1.0), (1, 3, 0.0, 4.0), (1, 4, 0.0, 6.0), (2, 1, 5.0, 5.0), (2, 2, 5.0, 5.0)]
    found = measure.group_centres(spark.createDataFrame(rows, "shape_id int, seq int, lat double, lng double")).collect()
    assert sorted((r["shape_id"], r["pair"], round(r["lng"], 9)) for r in found) == [(1, 0, 2.0), (1, 1, 5.0), (2, 0, 5.0)]


def test_pairs_and_ring(spark):
    assert tuple(value(spark, geo.parsed_pair(F.lit("( 35.5, 139.25 )")))) == (35.5, 139.25)
    assert value(spark, geo.parsed_pair(F.lit("35.5, 139, 1"))) is None
    ring = F.array(F.lit(1), F.lit(2), F.lit(1))
    assert value(spark, geo.open_ring(ring)) == [1, 2]


def test_import_rejects_bad_documents(spark):
    good = '{"version":2,"markers":[{"marker_name":"a","latitude":1.0,"longitude":2.0,"detail":"","layer":{"layer_name":" x ","is_master":true}}]}'
    read = lambda t: spark.createDataFrame([(t,)], "t string").select(packages.parsed(F.col("t")).alias("package"))
    layers, markers, shapes = packages.import_rows(read(good))
    assert [tuple(r) for r in layers.select("id", "layer_name", "is_master").collect()] == [(1, "x", False)]
    assert markers.count() == 1 and shapes.count() == 0
    with pytest.raises(Exception):
        packages.import_rows(read(good.replace(" x ", "  ")))[1].collect()
    with pytest.raises(Exception):
        read(good.replace("1.0", '"north"')).collect()


def test_login_rules():
    s, at = logins.Settings(limit=4, minutes=5, start=2), datetime(2024, 1, 1)
    tried = lambda a, at, ok, second=False: logins.attempt(a, at, "password", ok, True, second, s)
    a, said = tried(logins.Account(), at, False)
    assert (a.failed_count, said) == (1, "Unauthorized")
    a, said = tried(a, at, False)
    assert said == "UnauthorizedPleaseWait" and a.next_challenge == at + timedelta(minutes=5)
    assert tried(a, at, True) == (a, "PleaseWait")
    later = at + timedelta(minutes=6)
    a, said = tried(a, later, False)
    assert a.failed_count == 3
    a, said = tried(a, later + timedelta(minutes=6), True)
    assert said == "Locked" and a.is_locked and a.failed_count == 0
    assert tried(a, later + timedelta(days=1), True)[1] == "LockedAccount"
    a, said = logins.attempt(a, later, "unlock", True, True, False, s)
    assert said == "Unlocked" and not a.is_locked
    assert logins.attempt(a, at, "password", True, False, False, s) == (a, "Unauthorized")


def test_second_factor():
    s, at = logins.Settings(), datetime(2024, 1, 1)
    code = lambda a, minutes, ok: logins.attempt(a, at + timedelta(minutes=minutes), "code", ok, True, True, s)
    assert code(logins.Account(), 0, True)[1] == "NoBasicAuth"
    a, said = logins.attempt(logins.Account(failed_count=2), at, "password", True, True, True, s)
    assert (said, a.failed_count) == ("CodeRequired", 2)
    assert code(a, 1, False) == (a, "NoAuth") and code(a, 4, True) == (a, "Time Over.")
    a, said = code(a, 3, True)
    assert (said, a.failed_count) == ("Success", 0)
