"""Export and import, GeoJSON and share snapshots."""

from __future__ import annotations

import contextlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.functions.text import colour
from terrafold.plans.registry import query
from terrafold.sources import packages, store
from terrafold.sources.tables import layers, markers, shapes, table, vertices

NAMED = "SELECT m.*, l.layer_name, l.is_master FROM markers m JOIN layers l ON l.id = m.layer_id"


def _marker_rows(spark: SparkSession, d: str) -> DataFrame:
    names = layers(spark, d).select(F.col("id").alias("layer_id"), "layer_name", "is_master")
    layer = F.struct("layer_name", "is_master").alias("layer")
    return markers(spark, d).join(names, "layer_id").select("layer_id", F.struct(F.lit(None).cast("timestamp_ntz").alias("at"), F.col("id").alias("id")).alias("place"), F.struct("marker_name", "latitude", "longitude", "detail", layer).alias("marker"))


def _shape_rows(spark: SparkSession, d: str) -> DataFrame:
    """In the order in which they were made."""
    names = layers(spark, d).select(F.col("id").alias("layer_id"), "layer_name", "is_master")
    made = F.struct(F.col("created_at").alias("at"), F.col("id").alias("id")).alias("place")
    return shapes(spark, d).join(names, "layer_id").select("layer_id", made, F.struct("shape_type", "name", F.concat(F.lit('{"id":'), "id", F.lit("}")).alias("geojson"), F.struct("layer_name", "is_master").alias("layer")).alias("shape"))


def _exported(spark: SparkSession, d: str) -> DataFrame:
    return packages.exported(_marker_rows(spark, d), _shape_rows(spark, d), ["layer_id"])


def _written(spark: SparkSession, d: str) -> str:
    """A new folder with one document a layer."""
    path = f"{store.shared_folder(spark)}/export-{uuid.uuid4().hex}"
    packages.write_documents(_marker_rows(spark, d), _shape_rows(spark, d), "layer_id", path)
    return path


@query(f"SELECT layer_id, layer_name, is_master, marker_name, latitude, longitude, detail, NULL AS shape_type, NULL AS name, NULL AS id FROM ({NAMED}) UNION ALL SELECT s.layer_id, l.layer_name, l.is_master, NULL, NULL, NULL, NULL, s.shape_type, s.name, s.id FROM shapes s JOIN layers l ON l.id = s.layer_id")
def export_package_json(spark: SparkSession, d: str) -> DataFrame:
    """One document a layer, written as a file and read back item by item."""
    rows = packages.read_items(spark, _written(spark, d))
    layer = F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast("int").alias("layer_id")
    named = F.coalesce("marker.layer", "shape.layer")
    return rows.select(layer, named["layer_name"].alias("layer_name"), named["is_master"].alias("is_master"), "marker.marker_name", "marker.latitude", "marker.longitude", "marker.detail", "shape.shape_type", "shape.name", F.get_json_object("shape.geojson", "$.id").cast("bigint").alias("id"))


@query("SELECT coalesce(m.layer_id, s.layer_id) AS layer_id, 2 AS version, coalesce(m.n, 0) AS markers, coalesce(s.n, 0) AS shapes, coalesce(m.low, -1) AS first_marker FROM (SELECT layer_id, count(*) AS n, arg_min(latitude, id) AS low FROM markers GROUP BY 1) m FULL JOIN (SELECT layer_id, count(*) AS n FROM shapes GROUP BY 1) s ON m.layer_id = s.layer_id")
def export_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same files read as whole JSON documents: exactly one a layer, its items in order."""
    read = packages.read_packages(spark, _written(spark, d))
    layer = F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast("int").alias("layer_id")
    return read.select(layer, "package.version", F.size("package.markers").cast("bigint").alias("markers"), F.size("package.shapes").cast("bigint").alias("shapes"), F.coalesce(F.get("package.markers", F.lit(0))["latitude"], F.lit(-1.0)).alias("first_marker"))


@query("SELECT row_number() OVER (ORDER BY layer_name) AS id, layer_name, false AS is_master FROM (SELECT DISTINCT l.layer_name FROM layers l JOIN markers m ON m.layer_id = l.id)")
def import_layers(spark: SparkSession, d: str) -> DataFrame:
    return packages.import_rows(_exported(spark, d))[0].select("id", "layer_name", "is_master")


@query(f"SELECT r.id AS layer_id, n.marker_name, n.latitude, n.longitude, n.detail FROM ({NAMED}) n JOIN (SELECT row_number() OVER (ORDER BY layer_name) AS id, layer_name FROM layers) r ON r.layer_name = n.layer_name")
def import_markers(spark: SparkSession, d: str) -> DataFrame:
    """Files are imported as one version of a store, then a bad file is refused: readers still see the first version. Every layer has markers or shapes, so each name is numbered."""
    where = f"{store.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    packages.import_into(where, packages.import_items(packages.read_items(spark, _written(spark, d))))
    bad = _marker_rows(spark, d).select(F.struct(F.lit(2).alias("version"), F.array(F.col("marker").withField("layer", F.struct(F.lit(" ").alias("layer_name"), F.lit(False).alias("is_master")))).alias("markers"), F.array().cast(f"array<{packages.SHAPE}>").alias("shapes")).alias("package"))
    with contextlib.suppress(PySparkException, Py4JJavaError):
        packages.import_into(where, packages.import_rows(bad))
    return store.read(spark, where, "markers").select("layer_id", "marker_name", "latitude", "longitude", "detail")


@query("SELECT r.id AS layer_id, s.shape_type, s.name, CAST(s.id AS BIGINT) AS id FROM shapes s JOIN layers l ON l.id = s.layer_id JOIN (SELECT row_number() OVER (ORDER BY layer_name) AS id, layer_name FROM layers) r ON r.layer_name = l.layer_name")
def import_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written, read item by item and imported into a store, the id taken from their GeoJSON."""
    where = f"{store.shared_folder(spark)}/store-{uuid.uuid4().hex}"
    packages.import_into(where, packages.import_items(packages.read_items(spark, _written(spark, d))))
    return store.read(spark, where, "shapes").select("layer_id", "shape_type", "name", F.get_json_object("geojson", "$.id").cast("bigint").alias("id"))


@query("SELECT c_custkey AS id, 1 AS version, 1 AS markers, 0 AS shapes FROM customer")
def import_old_form(spark: SparkSession, d: str) -> DataFrame:
    """A bare array of markers is version 1."""
    marker = F.struct(F.col("c_name").alias("marker_name"), F.lit(35.0).alias("latitude"), F.lit(139.0).alias("longitude"), F.lit("").alias("detail"), F.struct(F.lit("x").alias("layer_name"), F.lit(False).alias("is_master")).alias("layer"))
    text = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.to_json(F.array(marker)).alias("text"))
    return text.select("id", packages.parsed(F.col("text")).alias("p")).select("id", "p.version", F.size("p.markers").alias("markers"), F.size("p.shapes").alias("shapes"))


def shape_documents(spark: SparkSession, d: str) -> DataFrame:
    """Shapes as GeoJSON text: polygons and rectangles as closed rings, lines as lines, circles as points with a radius; style beside."""
    points = vertices(spark, d).groupBy("shape_id").agg(F.sort_array(F.collect_list(F.struct("seq", "lng", "lat"))).alias("v"))
    rows = shapes(spark, d).withColumnRenamed("id", "shape_id").join(points, "shape_id")
    pairs = F.transform("v", lambda p: F.array(p["lng"], p["lat"]))
    kind = F.when(F.col("shape_type") == "circle", "Point").when(F.col("shape_type") == "polyline", "LineString").otherwise("Polygon")
    coordinates = F.when(kind == "Point", F.to_json(F.get(pairs, F.lit(0)))).when(kind == "LineString", F.to_json(pairs)).otherwise(F.to_json(F.array(F.concat(pairs, F.slice(pairs, 1, 1)))))
    # Every fifth circle has a radius that no circle can have, and is dropped when read.
    radius = F.when(F.col("shape_id") % 5 == 0, F.lit(-1.0)).otherwise((100 + F.col("shape_id") % 900).cast("double"))
    given, area = F.when(F.col("shape_id") % 2 == 0, F.lit("#ABC")), F.col("shape_type") != "polyline"
    shown = colour(F.coalesce(given, F.lit("")))
    style = F.struct(shown.alias("color"), F.lit(4.0).alias("weight"), F.when(area, shown).alias("fillColor"), F.when(area, F.lit(0.16)).alias("fillOpacity"))
    properties = F.struct(style.alias("style"), F.when(kind == "Point", radius).alias("radius"))
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit('},"properties":'), F.to_json(properties), F.lit("}"))
    return rows.select("shape_id", "shape_type", text.alias("geojson"))


@query("SELECT s.id AS shape_id, CASE s.shape_type WHEN 'circle' THEN 'Point' WHEN 'polyline' THEN 'LineString' ELSE 'Polygon' END AS kind, CASE WHEN shape_type = 'circle' THEN CAST(100 + s.id % 900 AS DOUBLE) END AS radius, CASE WHEN shape_type = 'circle' THEN 1 WHEN shape_type = 'polyline' THEN v.n ELSE v.n + 1 END AS points, v.lat, v.lng, CASE WHEN s.id % 2 = 0 THEN '#aabbcc' ELSE '#d94841' END AS color, 4.0::DOUBLE AS weight, CASE WHEN shape_type <> 'polyline' THEN 0.16::DOUBLE END AS opacity FROM shapes s JOIN (SELECT shape_id, count(*) AS n, arg_min(lat, seq) AS lat, arg_min(lng, seq) AS lng FROM vertices GROUP BY 1) v ON v.shape_id = s.id WHERE NOT (shape_type = 'circle' AND s.id % 5 = 0)")
def geojson_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written with style and radius and read back: kind, first point, number of points; circles without a usable radius are dropped."""
    at = lambda p: F.get_json_object("geojson", p)
    kind, coordinates = at("$.geometry.type"), at("$.geometry.coordinates")
    ring = F.coalesce(geo.first_ring(kind, coordinates), F.array(F.from_json(F.when(kind == "Point", coordinates), "array<double>")))
    radius = geo.usable_radius(at("$.properties.radius").cast("double"))
    read = shape_documents(spark, d).select("shape_id", "shape_type", kind.alias("kind"), radius.alias("radius"), ring.alias("ring"), *(at(f"$.properties.style.{k}").alias(a) for k, a in (("color", "color"), ("weight", "weight"), ("fillOpacity", "opacity"))))
    fits = (F.col("shape_type") != "circle") | (F.col("radius").isNotNull() & (F.size(F.get("ring", F.lit(0))) >= 2))
    first = F.get("ring", F.lit(0))
    return read.where(fits).select("shape_id", "kind", "radius", F.size("ring").cast("bigint").alias("points"), F.get(first, F.lit(1)).alias("lat"), F.get(first, F.lit(0)).alias("lng"), "color", F.col("weight").cast("double").alias("weight"), F.col("opacity").cast("double").alias("opacity"))


@query("SELECT s.id AS shape_id, v.n + 1 AS points, v.lat, v.lng FROM shapes s JOIN (SELECT shape_id, count(*) AS n, arg_min(lat, seq) AS lat, arg_min(lng, seq) AS lng FROM vertices GROUP BY 1) v ON v.shape_id = s.id WHERE shape_type IN ('polygon', 'rectangle')")
def flattened_rings(spark: SparkSession, d: str) -> DataFrame:
    """Of polygons with a hole, and of several polygons, the first ring alone."""
    rows = shape_documents(spark, d).where("shape_type in ('polygon', 'rectangle')")
    ring = F.get_json_object("geojson", "$.geometry.coordinates[0]")
    hole = F.lit("[[0,0],[0,1],[1,1],[0,0]]")
    several = F.col("shape_type") == "rectangle"
    nested = F.when(several, F.concat(F.lit("[["), ring, F.lit(","), hole, F.lit("],["), hole, F.lit("]]"))).otherwise(F.concat(F.lit("["), ring, F.lit(","), hole, F.lit("]")))
    flat = geo.first_ring(F.when(several, "MultiPolygon").otherwise("Polygon"), nested)
    first = F.get("ring", F.lit(0))
    return rows.select("shape_id", flat.alias("ring")).select("shape_id", F.size("ring").cast("bigint").alias("points"), F.get(first, F.lit(1)).alias("lat"), F.get(first, F.lit(0)).alias("lng"))


@query("SELECT user_id, count(*) AS markers, count(DISTINCT layer_id) AS layers FROM markers WHERE layer_id IN (1, 6, 7) AND user_id = 1 GROUP BY user_id")
def share_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the listed layers that the user owns, nested into maps as text and read back; foreign layers vanish."""
    wanted = spark.createDataFrame([(1,), (6,), (7,)], "layer_id int")
    own = markers(spark, d).where("user_id = 1").join(wanted, "layer_id", "left_semi")
    dealt = packages.in_parts(own.dropDuplicates(["user_id", "id"]), ["user_id"])
    text = dealt.groupBy("user_id", "part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), F.struct("marker_name", "layer_id"))))).alias("markers"))
    back = text.select("user_id", F.explode(F.from_json("markers", "map<string,struct<marker_name:string,layer_id:int>>")))
    return back.groupBy("user_id").agg(F.count("*").alias("markers"), F.countDistinct("value.layer_id").alias("layers"))
