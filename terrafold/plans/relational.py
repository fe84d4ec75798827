"""Reads, joins, aggregates, orders and sets over the map views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.plans.registry import query
from terrafold.sources.packages import in_parts
from terrafold.sources.tables import images, layers, markers, shapes, shares, table, text_markers, users, vertices

def tile_servers(spark: SparkSession, d: str) -> DataFrame:
    """Tile servers made of regions; every second one has no smallest zoom, every third no largest."""
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(k.alias("id"), F.lower("r_name").alias("layer_name"), F.initcap("r_name").alias("label"), (k % 2 == 0).alias("include_foreign_tiles"), F.when(k % 2 == 1, k + 3).alias("min_zoom"), F.when(k % 3 > 0, k + 15).alias("max_zoom"))


#: The settings of a new installation, by their stored keys; the administrator's secrets are not data here.
SEED_SETTINGS = [("login_attempts_limit", "15"), ("next_challenge_minutes", "5"), ("challenge_limit_start", "5")]
DEFAULTS = {k: int(v) for k, v in SEED_SETTINGS}


def settings_rows(spark: SparkSession, d: str) -> DataFrame:
    """Settings of installations, made of suppliers: key and value as text, later rows with larger ids."""
    k = F.col("s_suppkey")
    key = F.element_at(F.array(*map(F.lit, [*DEFAULTS, "theme"])), (k % 4 + 1).cast("int"))
    value = F.when(k % 7 == 0, "S_NAME").when(k % 7 == 1, F.concat(F.lit("+"), (k % 50).cast("string"))).when(k % 7 == 2, F.concat(F.lit(" "), k.cast("string"))).when(k % 7 == 3, "9223372036854775808").when(k % 7 == 4, F.concat(k.cast("string"), F.lit(".0"))).otherwise((k - 40).cast("string"))
    return table(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("installation"), key.alias("setting_key"), value.alias("setting_value"))


def seeded(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """existing, or seed if it has no rows."""
    n = existing.agg(F.count("*").alias("_n"))
    return existing.unionByName(seed.join(F.broadcast(n)).where("_n = 0").drop("_n"))


@query("SELECT r_regionkey AS id, lower(r_name) AS layer_name, upper(substr(r_name, 1, 1)) || lower(regexp_replace(substr(r_name, 2), ' .*', '')) AS label, r_regionkey % 2 = 0 AS include_foreign_tiles, CASE WHEN r_regionkey % 2 = 1 THEN r_regionkey + 3 ELSE 5 END AS min_zoom, CASE WHEN r_regionkey % 3 > 0 THEN r_regionkey + 15 ELSE 18 END AS max_zoom FROM region")
def tile_server_list(spark: SparkSession, d: str) -> DataFrame:
    rows = tile_servers(spark, d)
    return rows.select("id", "layer_name", F.substring_index("label", " ", 1).alias("label"), "include_foreign_tiles", F.coalesce("min_zoom", F.lit(5)).alias("min_zoom"), F.coalesce("max_zoom", F.lit(18)).alias("max_zoom"))


@query("SELECT 'setting' AS kind, setting_key AS name, setting_value AS value FROM (VALUES ('challenge_limit_start', '5'), ('login_attempts_limit', '15'), ('next_challenge_minutes', '5')) v(setting_key, setting_value) UNION ALL SELECT 'user', username, 'superuser' FROM users WHERE is_superuser")
def first_seed(spark: SparkSession, d: str) -> DataFrame:
    """An installation that has administrators but no settings of the kinds known gets the settings alone."""
    known = settings_rows(spark, d).where(F.col("setting_key").isin(*DEFAULTS) & (F.col("installation") < 0)).select("setting_key", "setting_value")
    settings = seeded(known, spark.createDataFrame(SEED_SETTINGS, "setting_key string, setting_value string"))
    accounts = seeded(users(spark, d).where("is_superuser").select("username", F.lit("superuser").alias("role")), spark.createDataFrame([("admin", "superuser")], "username string, role string"))
    return settings.select(F.lit("setting").alias("kind"), F.col("setting_key").alias("name"), F.col("setting_value").alias("value")).union(accounts.select(F.lit("user"), "username", "role"))


@query("SELECT user_id, username FROM users")
def second_seed(spark: SparkSession, d: str) -> DataFrame:
    """Where users exist, none is added."""
    return seeded(users(spark, d).select("user_id", "username"), spark.createDataFrame([(99, "admin")], "user_id int, username string"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN CAST(39.2 AS DOUBLE) ELSE latitude END AS latitude, CASE WHEN id % 3 = 0 THEN CAST(138.5 AS DOUBLE) ELSE longitude END AS longitude, CASE WHEN id % 3 = 0 THEN 6 ELSE 18 END AS zoom FROM markers")
def view_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Where a map opens: near the marker asked for, else far above the middle of the country."""
    asked = F.col("id") % 3 != 0
    rows = markers(spark, d).select("id", F.when(asked, F.col("latitude")).alias("lat"), F.when(asked, F.col("longitude")).alias("lng"))
    return rows.select("id", F.coalesce("lat", F.lit(39.2)).alias("latitude"), F.coalesce("lng", F.lit(138.5)).alias("longitude"), F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), 18).otherwise(6).alias("zoom"))


@query("SELECT user_id, username, is_superuser FROM users")
def users_list(spark: SparkSession, d: str) -> DataFrame:
    """Without secrets."""
    return users(spark, d).select("user_id", "username", "is_superuser").orderBy(F.desc("user_id"))


def settings_of(rows: DataFrame) -> DataFrame:
    """rows with (installation, id, setting_key, setting_value): one row for each installation, its settings as columns.

    Of several rows with a key the last decides; one that is no whole number of 64 bits, spelled with digits and at most a sign, takes the default."""
    number = F.when(F.col("setting_value").rlike(r"^[+-]?[0-9]+\z"), F.col("setting_value").try_cast("bigint"))
    last = lambda k: F.max_by(F.when(F.col("setting_key") == k, F.struct(number.alias("n"))), F.when(F.col("setting_key") == k, F.col("id")))["n"]
    return rows.groupBy("installation").agg(*(F.coalesce(last(k), F.lit(v)).alias(k) for k, v in DEFAULTS.items()))


SETTINGS = "(SELECT s_nationkey AS installation, s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'login_attempts_limit' WHEN 1 THEN 'next_challenge_minutes' WHEN 2 THEN 'challenge_limit_start' ELSE 'theme' END AS k, CASE s_suppkey % 7 WHEN 1 THEN s_suppkey % 50 WHEN 5 THEN s_suppkey - 40 WHEN 6 THEN s_suppkey - 40 END AS n FROM supplier)"


@query("SELECT installation, " + ", ".join(f"coalesce((SELECT b.n FROM {SETTINGS} b WHERE b.installation = a.installation AND b.k = '{k}' ORDER BY b.id DESC LIMIT 1), {v}) AS {k}" for k, v in (("login_attempts_limit", 15), ("next_challenge_minutes", 5), ("challenge_limit_start", 5))) + f" FROM (SELECT DISTINCT installation FROM {SETTINGS}) a")
def settings_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Key-value settings as columns."""
    return settings_of(settings_rows(spark, d))


@query("SELECT * FROM shares WHERE id = 7")
def share_by_id(spark: SparkSession, d: str) -> DataFrame:
    return shares(spark, d).where(F.col("id") == 7)


@query("SELECT user_id, username FROM users WHERE username = 'ASIA'")
def user_by_name(spark: SparkSession, d: str) -> DataFrame:
    return users(spark, d).where(F.col("username") == "ASIA").select("user_id", "username")


@query("SELECT id AS layer_id, layer_name FROM layers WHERE user_id = 3 AND is_master")
def master_layer_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    """Fails unless the user has exactly one master layer."""
    rows = layers(spark, d).where((F.col("user_id") == 3) & F.col("is_master")).groupBy().agg(F.count("*").alias("n"), F.min("id").alias("layer_id"), F.min("layer_name").alias("layer_name"))
    return rows.select("layer_id", "layer_name", F.assert_true(F.col("n") == 1, "exactly one row is needed").alias("_ok")).where("_ok is null").drop("_ok")


@query("SELECT id, layer_id FROM shapes WHERE user_id = 1 AND layer_id IN (1, 6, 11)")
def shapes_in_layers(spark: SparkSession, d: str) -> DataFrame:
    wanted: list[int] = [1, 6, 11]
    rows = shapes(spark, d).where(F.col("user_id") == 1).select("id", "layer_id")
    return rows.where(F.col("layer_id").isin(*wanted)) if wanted else rows.limit(0)


@query("SELECT id, name IS NOT NULL AS has_name FROM shapes")
def shape_has_name(spark: SparkSession, d: str) -> DataFrame:
    return shapes(spark, d).select("id", F.col("name").isNotNull().alias("has_name"))


@query("SELECT id, layer_name FROM layers WHERE NOT is_master")
def deletable_layers(spark: SparkSession, d: str) -> DataFrame:
    return layers(spark, d).where(~F.col("is_master")).select("id", "layer_name")


@query("SELECT id, filename FROM images WHERE contains(filename, 'ed') AND contains(filename, '.p')")
def image_filter_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Case-sensitive; each further term filters what is left."""
    rows = images(spark, d)
    for term in ("ed", ".p"):
        rows = rows.where(F.contains("filename", F.lit(term)))
    return rows.select("id", "filename")


@query("SELECT m.id, coalesce(l.layer_name, 'Layer Name Get Error') AS layer_name FROM markers m LEFT JOIN (SELECT * FROM layers WHERE id % 2 = 0) l ON m.layer_id = l.id")
def marker_table_with_default(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.operators.search import with_layer_name

    return with_layer_name(markers(spark, d), layers(spark, d).where("id % 2 = 0")).select("id", "layer_name")


@query("SELECT id, CASE WHEN marker_name = '' THEN 'No Name' ELSE marker_name END AS label FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE marker_name END AS marker_name FROM markers)")
def marker_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = markers(spark, d).select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("marker_name")).alias("marker_name"))
    return rows.select("id", F.when(F.col("marker_name") == "", "No Name").otherwise(F.col("marker_name")).alias("label"))


@query("SELECT layer_id, arg_min(marker_name, id) AS first_name FROM markers GROUP BY layer_id")
def first_name_per_layer(spark: SparkSession, d: str) -> DataFrame:
    return markers(spark, d).groupBy("layer_id").agg(F.min_by("marker_name", "id").alias("first_name"))


@query("""SELECT i.id, CASE WHEN i.owner IS NULL THEN 400 WHEN i.owner = 1 OR NOT u.is_private THEN 200 ELSE 404 END AS status
    FROM (SELECT id, CASE WHEN id % 10 = 9 THEN NULL ELSE CAST(id % 5 AS INTEGER) END AS owner FROM images) i LEFT JOIN users u ON i.owner = u.user_id""")
def image_visibility(spark: SparkSession, d: str) -> DataFrame:
    """What viewer 1 gets: own files and those of users who are not private; no owner is a bad request."""
    owned = images(spark, d).select("id", F.when(F.col("id") % 10 != 9, (F.col("id") % 5).cast("int")).alias("owner"))
    owners = users(spark, d).select(F.col("user_id").alias("owner"), "is_private")
    status = F.when(F.col("owner").isNull(), 400).when((F.col("owner") == 1) | ~F.col("is_private"), 200).otherwise(404)
    return owned.join(F.broadcast(owners), "owner", "left").select("id", status.alias("status"))


@query("SELECT s.id FROM shapes s WHERE s.layer_id IN (SELECT id FROM layers WHERE NOT is_master)")
def visible_shapes(spark: SparkSession, d: str) -> DataFrame:
    on = layers(spark, d).where(~F.col("is_master")).select(F.col("id").alias("layer_id"))
    return shapes(spark, d).join(on, "layer_id", "left_semi").select("id")


@query("SELECT m.id, m.marker_name, m.latitude, m.longitude, m.detail, l.id AS layer_id, l.layer_name, l.is_master, l.user_id AS layer_user FROM markers m JOIN layers l ON m.layer_id = l.id WHERE m.user_id = 1")
def export_markers(spark: SparkSession, d: str) -> DataFrame:
    own = markers(spark, d).where(F.col("user_id") == 1)
    names = layers(spark, d).select(F.col("id").alias("layer_id"), "layer_name", "is_master", F.col("user_id").alias("layer_user"))
    return own.drop("user_id").join(names, "layer_id").select("id", "marker_name", "latitude", "longitude", "detail", "layer_id", "layer_name", "is_master", "layer_user")


@query("SELECT m.id, l.layer_name FROM markers m JOIN layers l ON m.layer_id = l.id WHERE m.user_id = 1 AND m.layer_id = 6")
def export_markers_one_layer(spark: SparkSession, d: str) -> DataFrame:
    return export_markers(spark, d).where(F.col("layer_id") == 6).select("id", "layer_name")


@query("SELECT s.id, s.shape_type, s.name, s.created_at, l.layer_name, s.user_id AS layer_user, row_number() OVER (ORDER BY s.created_at, s.id) AS place FROM shapes s JOIN layers l ON s.layer_id = l.id WHERE s.user_id = 1 AND s.layer_id = 6")
def export_shapes(spark: SparkSession, d: str) -> DataFrame:
    """One layer's shapes in order of creation; the layer's user is the shape's."""
    own = shapes(spark, d).where((F.col("user_id") == 1) & (F.col("layer_id") == 6))
    names = layers(spark, d).select(F.col("id").alias("layer_id"), "layer_name")
    rows = own.join(names, "layer_id").withColumn("place", F.row_number().over(Window.partitionBy("layer_id").orderBy("created_at", "id")))
    return rows.select("id", "shape_type", "name", "created_at", "layer_name", F.col("user_id").alias("layer_user"), "place")


@query("SELECT s.id, s.shape_type, s.name, l.id AS layer_id, l.layer_name, l.is_master, row_number() OVER (PARTITION BY s.layer_id ORDER BY s.created_at, s.id) AS place FROM shapes s JOIN layers l ON s.layer_id = l.id WHERE s.user_id = 1")
def export_all_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Asked for from the master layer: the shapes of all layers, in order of creation within each."""
    own = shapes(spark, d).where(F.col("user_id") == 1)
    names = layers(spark, d).select(F.col("id").alias("layer_id"), "layer_name", "is_master")
    rows = own.join(names, "layer_id").withColumn("place", F.row_number().over(Window.partitionBy("layer_id").orderBy("created_at", "id")))
    return rows.select("id", "shape_type", "name", "layer_id", "layer_name", "is_master", "place")


@query("SELECT l.id, EXISTS (SELECT 1 FROM markers m WHERE m.layer_id = l.id AND m.user_id = l.user_id) AS used FROM layers l")
def layer_used(spark: SparkSession, d: str) -> DataFrame:
    used = markers(spark, d).select(F.col("layer_id").alias("id"), "user_id").distinct().withColumn("_used", F.lit(True))
    return layers(spark, d).join(used, ["id", "user_id"], "left").select("id", F.coalesce("_used", F.lit(False)).alias("used"))


@query("SELECT id, user_id FROM layers l WHERE EXISTS (SELECT 1 FROM shapes s WHERE s.layer_id = l.id)")
def layer_semi(spark: SparkSession, d: str) -> DataFrame:
    """The layers of shapes are told apart before they are joined, so no task holds the shapes of a layer."""
    used = shapes(spark, d).select(F.col("layer_id").alias("id")).distinct()
    return layers(spark, d).join(used, "id", "left_semi").select("id", "user_id")


@query("SELECT DISTINCT o_orderpriority AS username FROM orders WHERE o_orderpriority NOT IN (SELECT username FROM users) AND o_orderpriority <> '1-URGENT'")
def username_anti(spark: SparkSession, d: str) -> DataFrame:
    """Names asked for that no user has and that are not reserved."""
    asked = table(spark, d, "orders").select(F.col("o_orderpriority").alias("username")).distinct()
    taken = users(spark, d).select("username").union(spark.createDataFrame([("1-URGENT",)], "username string"))
    return asked.join(taken, "username", "left_anti")


@query("SELECT m.layer_id, l.layer_name, count(*) AS n FROM markers m JOIN layers l ON m.layer_id = l.id AND l.id % 3 = 0 GROUP BY m.layer_id, l.layer_name")
def groups_named_only(spark: SparkSession, d: str) -> DataFrame:
    """The shared map drops groups without a name."""
    counts = markers(spark, d).groupBy("layer_id").agg(F.count("*").alias("n"))
    return counts.join(layers(spark, d).where("id % 3 = 0").select(F.col("id").alias("layer_id"), "layer_name"), "layer_id")


@query("SELECT m.layer_id, l.layer_name, count(*) AS n FROM markers m LEFT JOIN layers l ON m.layer_id = l.id AND l.id % 3 = 0 GROUP BY m.layer_id, l.layer_name")
def groups_unnamed_kept(spark: SparkSession, d: str) -> DataFrame:
    """The second window keeps them."""
    counts = markers(spark, d).groupBy("layer_id").agg(F.count("*").alias("n"))
    return counts.join(layers(spark, d).where("id % 3 = 0").select(F.col("id").alias("layer_id"), "layer_name"), "layer_id", "left")


@query("SELECT count(*) AS n, count(*) = 0 AS is_empty FROM shapes")
def shape_count(spark: SparkSession, d: str) -> DataFrame:
    return shapes(spark, d).agg(F.count("*").alias("n")).select("n", (F.col("n") == 0).alias("is_empty"))


@query("SELECT user_id, count(*) FILTER (WHERE expiration >= TIMESTAMP '1998-01-01') AS active, count(*) FILTER (WHERE expiration >= TIMESTAMP '1998-01-01') > 0 AS has_active FROM shares GROUP BY user_id")
def share_flags(spark: SparkSession, d: str) -> DataFrame:
    live = F.count_if(F.col("expiration") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return shares(spark, d).groupBy("user_id").agg(live.alias("active")).select("user_id", "active", (F.col("active") > 0).alias("has_active"))


@query("SELECT key, value.marker_name AS marker_name FROM (SELECT id AS key, {'marker_name': marker_name} AS value FROM markers WHERE user_id = 4 AND layer_id = 9)")
def keyed_map(spark: SparkSession, d: str) -> DataFrame:
    """A layer's rows as maps by id, in parts of a bounded size, then their entries."""
    rows = in_parts(markers(spark, d).where("user_id = 4 and layer_id = 9").dropDuplicates(["id"]), ["layer_id"])
    return rows.groupBy("layer_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("marker_name")))).alias("m")).select(F.explode("m")).select("key", "value.marker_name")


@query("SELECT DISTINCT trim(name) AS layer_name FROM (SELECT marker_name AS name FROM (SELECT l.layer_name AS marker_name FROM markers m JOIN layers l ON m.layer_id = l.id) UNION ALL SELECT ' ' || source || ' ' FROM documents)")
def layer_names_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct trimmed layer names over both kinds of rows."""
    one = markers(spark, d).select(F.col("layer_id").alias("id")).distinct().join(layers(spark, d).select("id", "layer_name"), "id").select("layer_name")
    two = text_markers(spark, d).select(F.concat(F.lit(" "), "layer_id", F.lit(" ")).alias("layer_name")).distinct()
    return one.union(two).select(F.trim("layer_name").alias("layer_name")).distinct()


@query("SELECT layer_id, count(*) AS markers, min(id) AS first_id, max(id) AS last_id, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, (min(latitude) + max(latitude)) / 2 AS centre_lat, (min(longitude) + max(longitude)) / 2 AS centre_lng FROM markers GROUP BY layer_id")
def layer_groups(spark: SparkSession, d: str) -> DataFrame:
    box = {"south": F.min("latitude"), "north": F.max("latitude"), "west": F.min("longitude"), "east": F.max("longitude")}
    return markers(spark, d).groupBy("layer_id").agg(F.count("*").alias("markers"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), *(v.alias(k) for k, v in box.items()), ((box["south"] + box["north"]) / 2).alias("centre_lat"), ((box["west"] + box["east"]) / 2).alias("centre_lng"))


@query("SELECT user_id, id, create_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY create_at DESC, id DESC) AS n FROM shares) WHERE n = 1")
def shares_current(spark: SparkSession, d: str) -> DataFrame:
    """The latest share of each user, by one combining aggregate."""
    return shares(spark, d).groupBy("user_id").agg(F.max(F.struct("create_at", "id")).alias("x")).select("user_id", "x.id", "x.create_at")


@query("SELECT id, filename FROM images ORDER BY id DESC LIMIT 20")
def images_topk(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select("id", "filename").orderBy(F.desc("id")).limit(20)


@query("SELECT id, row_number() OVER (ORDER BY id DESC) AS place FROM layers")
def layers_by_id_desc(spark: SparkSession, d: str) -> DataFrame:
    """25 rows at every scale."""
    return layers(spark, d).select("id", F.row_number().over(Window.orderBy(F.desc("id"))).alias("place"))


@query("SELECT id, layer_name, row_number() OVER (ORDER BY id) AS place FROM layers")
def layers_by_id(spark: SparkSession, d: str) -> DataFrame:
    """25 rows at every scale."""
    return layers(spark, d).select("id", "layer_name", F.row_number().over(Window.orderBy("id")).alias("place")).orderBy("id")


@query("SELECT user_id, id, layer_name, row_number() OVER (PARTITION BY user_id ORDER BY is_master DESC, layer_name) AS place FROM layers")
def layers_master_first(spark: SparkSession, d: str) -> DataFrame:
    """Master first, then by name in Japanese order; rows without id or name are dropped."""
    order = Window.partitionBy("user_id").orderBy(F.desc("is_master"), F.collate("layer_name", "ja"))
    return layers(spark, d).dropna(subset=["id", "layer_name"]).select("user_id", "id", "layer_name", F.row_number().over(order).alias("place"))


@query("SELECT s.shape_id, max(seq) AS n_vertices FROM vertices s GROUP BY s.shape_id")
def vertex_counts(spark: SparkSession, d: str) -> DataFrame:
    return vertices(spark, d).groupBy("shape_id").agg(F.max("seq").alias("n_vertices"))


@query("SELECT user_id, count(*) FILTER (WHERE is_master) AS masters FROM layers GROUP BY user_id")
def one_master_per_user(spark: SparkSession, d: str) -> DataFrame:
    return layers(spark, d).groupBy("user_id").agg(F.count_if("is_master").alias("masters"))
