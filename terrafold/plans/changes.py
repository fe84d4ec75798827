"""Inserts, updates, deletes and their cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.text import blank_to_null, name_error
from terrafold.functions.times import plus_minutes
from terrafold.operators import mutations as change
from terrafold.plans.registry import query
from terrafold.sources.packages import SHAPE_KINDS
from terrafold.sources.tables import images, layers, markers, shapes, shares, users

M = "id, user_id, layer_id, marker_name, latitude, longitude, detail"


@query(f"SELECT {M} FROM markers UNION ALL SELECT 0, 1, 6, '', CAST(43.0625 AS DOUBLE), CAST(141.3125 AS DOUBLE), ''")
def insert_marker(spark: SparkSession, d: str) -> DataFrame:
    rows = markers(spark, d)
    new = spark.createDataFrame([(0, 1, 6, "", 43.0625, 141.3125, "")], rows.schema)
    return change.insert(rows, new)


@query("SELECT id, CASE WHEN id = 7 AND user_id = 3 THEN 26.25 ELSE latitude END AS latitude, CASE WHEN id = 7 AND user_id = 3 THEN 127.75 ELSE longitude END AS longitude FROM markers")
def move_marker(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("id") == 7) & (F.col("user_id") == 3)
    return change.update(markers(spark, d), hit, {"latitude": F.lit(26.25), "longitude": F.lit(127.75)}).select("id", "latitude", "longitude")


@query("SELECT id, CASE WHEN layer_id = 6 AND user_id = 1 THEN 'renamed' ELSE marker_name END AS marker_name, CASE WHEN layer_id = 6 AND user_id = 1 THEN 11 ELSE layer_id END AS layer_id FROM markers")
def edit_markers(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("layer_id") == 6) & (F.col("user_id") == 1)
    return change.update(markers(spark, d), hit, {"marker_name": F.lit("renamed"), "layer_id": F.lit(11)}).select("id", "marker_name", "layer_id")


@query("SELECT id FROM markers WHERE NOT (user_id = 2 AND id % 5 = 0)")
def delete_markers(spark: SparkSession, d: str) -> DataFrame:
    return change.delete(markers(spark, d), (F.col("user_id") == 2) & (F.col("id") % 5 == 0)).select("id")


@query("SELECT user_id, count(*) FILTER (WHERE id % 5 = 0) AS affected FROM markers GROUP BY user_id")
def rows_affected(spark: SparkSession, d: str) -> DataFrame:
    return markers(spark, d).groupBy("user_id").agg(F.count_if(F.col("id") % 5 == 0).alias("affected"))


@query("SELECT id, user_id, layer_name, is_master FROM layers UNION ALL SELECT 100, 1, 'field notes', false")
def insert_layer(spark: SparkSession, d: str) -> DataFrame:
    rows = layers(spark, d)
    return change.insert(rows, spark.createDataFrame([(100, 1, "field notes", False)], rows.schema))


@query("SELECT 'layer' AS kind, CAST(id AS BIGINT) AS id FROM layers WHERE NOT (id IN (1, 6) AND NOT is_master) UNION ALL SELECT 'marker', id FROM markers WHERE layer_id <> 6 UNION ALL SELECT 'shape', id FROM shapes WHERE layer_id <> 6")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Layers 1 and 6 are to go; 1 is a master layer and stays, 6 takes its markers and shapes along."""
    left, gone = change.delete_returning(layers(spark, d), F.col("id").isin(1, 6) & ~F.col("is_master"), "id")
    tagged = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"))
    return tagged(left, "layer").union(tagged(change.cascade(markers(spark, d), "layer_id", gone), "marker")).union(tagged(change.cascade(shapes(spark, d), "layer_id", gone), "shape"))


@query("SELECT id, CASE WHEN id IN (2, 7) AND NOT is_master THEN 'renamed layer' ELSE layer_name END AS layer_name FROM layers")
def rename_layer(spark: SparkSession, d: str) -> DataFrame:
    return change.update(layers(spark, d), F.col("id").isin(2, 7) & ~F.col("is_master"), {"layer_name": F.lit("renamed layer")}).select("id", "layer_name")


@query("SELECT id, CASE id % 5 WHEN 1 THEN marker_name WHEN 2 THEN repeat('é', 81) WHEN 3 THEN repeat('é', 80) WHEN 4 THEN 'a' || chr(12288) || 'b' END AS name, id % 5 = 2 AS too_long FROM markers")
def shape_names_checked(spark: SparkSession, d: str) -> DataFrame:
    """White space of any kind goes at both ends, and what is then empty is no name."""
    k = F.col("id") % 5
    raw = F.when(k == 0, "\t\n\u3000").when(k == 1, F.concat(F.lit("\u3000 "), "marker_name", F.lit("\u00a0\n"))).when(k == 2, F.repeat(F.lit("é"), 81)).when(k == 3, F.concat(F.lit("\u2003"), F.repeat(F.lit("é"), 80))).otherwise("a\u3000b")
    return markers(spark, d).select("id", raw.alias("name")).select("id", blank_to_null(F.col("name")).alias("name"), name_error(F.col("name")).alias("too_long"))


NEW_SHAPES = [(-1, "polygon", "  one\t"), (-2, "circle", "\u3000"), (-3, "triangle", "three"), (-4, "polyline", "x" * 81), (-5, "rectangle", None)]


@query("SELECT id, user_id, layer_id, shape_type, name, NULL AS refused FROM shapes UNION ALL VALUES (-1, 1, 6, 'polygon', 'one', NULL), (-2, 1, 6, 'circle', NULL, NULL), (-5, 1, 6, 'rectangle', NULL, NULL), (-3, 1, 6, 'triangle', 'three', 'shape type'), (-4, 1, 6, 'polyline', repeat('x', 81), 'name')")
def insert_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Of the shapes sent those of a known type and with a fitting name are inserted; the others come with the reason."""
    sent = spark.createDataFrame(NEW_SHAPES, "id long, shape_type string, name string")
    refused = F.when(~F.col("shape_type").isin(*SHAPE_KINDS), "shape type").when(name_error(F.col("name")), "name")
    checked = sent.select("id", F.lit(1).alias("user_id"), F.lit(6).alias("layer_id"), "shape_type", F.when(refused.isNull(), blank_to_null(F.col("name"))).otherwise(F.col("name")).alias("name"), refused.alias("refused"))
    rows = shapes(spark, d).select("id", "user_id", "layer_id", "shape_type", "name", F.lit(None).cast("string").alias("refused"))
    return change.insert(rows, checked)


@query("SELECT 'inserted' AS done, CAST(-1 AS BIGINT) AS id UNION ALL SELECT 'updated', id FROM markers WHERE layer_id = 6 AND user_id = 1")
def changed_keys(spark: SparkSession, d: str) -> DataFrame:
    """An insert and an update each give the keys that they touched."""
    rows = markers(spark, d)
    rows, inserted = change.insert_returning(rows, spark.createDataFrame([(-1, 1, 6, "", 43.0625, 141.3125, "")], rows.schema), "id")
    _, updated = change.update_returning(rows, (F.col("layer_id") == 6) & (F.col("user_id") == 1) & (F.col("id") >= 0), {"detail": F.lit("x")}, "id")
    return inserted.select(F.lit("inserted").alias("done"), "id").union(updated.select(F.lit("updated").alias("done"), "id"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE name END AS name, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 24 ELSE layer_id END AS layer_id FROM shapes")
def partial_update_shape(spark: SparkSession, d: str) -> DataFrame:
    """The name is always overwritten, here by nothing; a layer only if one is given."""
    given = F.when(F.col("id") % 2 == 0, 24)
    return change.update(shapes(spark, d), F.col("id") % 3 == 0, {"name": F.lit(None).cast("string"), "layer_id": F.coalesce(given, F.col("layer_id"))}).select("id", "name", "layer_id")


@query("SELECT id, user_id FROM shapes WHERE NOT (user_id = 3 AND shape_type = 'circle')")
def delete_shapes(spark: SparkSession, d: str) -> DataFrame:
    return change.delete(shapes(spark, d), (F.col("user_id") == 3) & (F.col("shape_type") == "circle")).select("id", "user_id")


CURRENT = "(SELECT user_id, arg_max(id, {'a': create_at, 'b': id}) AS id, max(create_at) AS create_at FROM shares GROUP BY user_id)"


@query(f"SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NULL THEN o.id WHEN o.user_id IS NOT NULL AND n.user_id % 2 = 0 THEN o.id ELSE n.id END AS id, CASE WHEN n.user_id IS NULL THEN 'old' ELSE 'new' END AS body FROM {CURRENT} o FULL JOIN (SELECT c_custkey AS user_id, 1000000 + c_custkey AS id FROM customer WHERE c_custkey % 3 = 0) n ON n.user_id = o.user_id")
def share_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One share for each user: an update keeps the id, else the old one goes and a new one comes."""
    old = shares(spark, d).groupBy("user_id").agg(F.max_by("id", F.struct("create_at", "id")).alias("id")).withColumn("body", F.lit("old"))
    new = markers(spark, d).where("id % 3 = 0").select(F.col("id").alias("user_id"), (F.col("id") + 1000000).alias("id"), F.lit("new").alias("body"))
    return change.merge(old, new.withColumn("_same", F.col("user_id") % 2 == 0), "user_id", ["id"], "_same")


@query("SELECT id, user_id FROM shares WHERE expiration >= TIMESTAMP '1998-01-01'")
def shares_active(spark: SparkSession, d: str) -> DataFrame:
    """Those that have expired are deleted when read."""
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    return change.delete(shares(spark, d), F.col("expiration") < now).select("id", "user_id")


@query("SELECT id, filename FROM images WHERE user_id = 'Brand#11'")
def delete_images_returning(spark: SparkSession, d: str) -> DataFrame:
    return change.delete_returning(images(spark, d), F.col("user_id") == "Brand#11", "id", "filename")[1]


@query("SELECT 'user' AS kind, 10 AS id, 'NEW' AS name UNION ALL SELECT 'layer', 10, 'NEW' UNION ALL SELECT 'user', user_id, username FROM users UNION ALL SELECT 'layer', id, layer_name FROM layers WHERE is_master")
def user_with_master_layer(spark: SparkSession, d: str) -> DataFrame:
    """A user and their master layer come from one input, so neither can be without the other."""
    new = spark.createDataFrame([(10, "NEW")], "id int, name string")
    kinds = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.col("id").cast("int").alias("id"), "name")
    old_users = users(spark, d).select(F.col("user_id").alias("id"), F.col("username").alias("name"))
    old_layers = layers(spark, d).where("is_master").select("id", F.col("layer_name").alias("name"))
    return kinds(change.insert(old_users, new), "user").union(kinds(change.insert(old_layers, new), "layer"))


@query("SELECT user_id, CASE WHEN user_id = 2 THEN false ELSE is_private END AS is_private, CASE WHEN user_id IN (1, 3) THEN 0 ELSE user_id END AS failed_count, user_id = 1 AS is_locked, CASE WHEN user_id = 4 THEN TIMESTAMP '2024-01-01 00:05:00' END AS next_challenge FROM users")
def user_flags(spark: SparkSession, d: str) -> DataFrame:
    """Privacy, counter, lock (the counter starts anew), unlocking, and the time of the next try."""
    user, at = F.col("user_id"), F.lit("2024-01-01").cast("timestamp_ntz")
    rows = users(spark, d).withColumns({"failed_count": user, "is_locked": user == 0, "next_challenge": F.lit(None).cast("timestamp_ntz")})
    rows = change.update(rows, user == 2, {"is_private": F.lit(False)})
    rows = change.update(rows, user == 3, {"failed_count": F.lit(0)})
    rows = change.update(rows, user == 1, {"is_locked": F.lit(True), "failed_count": F.lit(0)})
    rows = change.update(rows, user == 0, {"is_locked": F.lit(False)})
    rows = change.update(rows, user == 4, {"next_challenge": plus_minutes(at, F.lit(5))})
    return rows.select("user_id", "is_private", "failed_count", "is_locked", "next_challenge")
