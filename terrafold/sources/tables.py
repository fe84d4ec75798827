"""The tables and the map views built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scaled(start: float, key: Column, step: int, size: int, per: int) -> Column:
    """start + (key * step mod size) / per, in doubles."""
    return F.lit(float(start)) + (key * step % size).cast("double") / F.lit(float(per))


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").alias("user_id"), F.col("r_name").alias("username"), (F.col("r_regionkey") == 0).alias("is_superuser"), (F.col("r_regionkey") % 2 == 0).alias("is_private"))


def layers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("user_id"), F.col("n_name").alias("layer_name"), (F.col("n_nationkey") < 5).alias("is_master"))


def _owned(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the owner of their layer; nations are 25 rows at every scale."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))


def markers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return _owned(spark, d).select(
        key.alias("id"), F.col("n_regionkey").alias("user_id"), F.col("c_nationkey").alias("layer_id"), F.col("c_name").alias("marker_name"),
        scaled(20.25, key, 7919, 25301, 1000).alias("latitude"), scaled(122.56, key, 104729, 31031, 1000).alias("longitude"), F.col("c_mktsegment").alias("detail"),
    )


def text_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("user_id"), F.col("source").alias("layer_id"), F.col("text").alias("detail"))


SHAPE_TYPES = ("polyline", "polygon", "rectangle", "circle")


def shape_type(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SHAPE_TYPES)), (key % 4 + 1).cast("int"))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    owners = _owned(spark, d).select("c_custkey", "n_regionkey", "c_nationkey")
    return table(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("n_regionkey").alias("user_id"), F.col("c_nationkey").alias("layer_id"), shape_type(F.col("o_orderkey")).alias("shape_type"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("name"), F.col("o_orderdate").alias("created_at"),
    )


def vertices(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"))
    lng = F.lit(139.0) + ((F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 1000).cast("double") / F.lit(10000.0)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("shape_id"), rank.alias("seq"), scaled(35, F.col("l_partkey"), 7919, 1000, 10000).alias("lat"), lng.alias("lng"))


#: Endings by p_partkey % 7.
ENDINGS = (".png", ".PNG", ".jpg", ".pdf", ".PDF", ".mp4", ".txt")


def images(spark: SparkSession, d: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("user_id"), F.concat("p_name", ending).alias("filename"))


def shares(spark: SparkSession, d: str) -> DataFrame:
    days = F.make_dt_interval(days=(F.col("o_orderkey") % 90).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("create_at"), (F.col("o_orderdate") + days).alias("expiration"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Errors and all other events but purchases and signups are tried passwords, purchases codes, signups an unlocking."""
    event, user = F.col("event_type"), F.col("user_id")
    kind = F.when(event == "purchase", "code").when(event == "signup", "unlock").otherwise("password")
    return table(spark, d, "events").select("user_id", "ts", kind.alias("kind"), F.when(event == "purchase", F.col("event_id") % 2 == 0).otherwise(event != "error").alias("ok"), (user % 10 != 9).alias("known"), (user % 3 == 0).alias("second"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "value")


#: The same views for the checks in SQL.
VIEWS_SQL = {
    "users": "SELECT r_regionkey AS user_id, r_name AS username, r_regionkey = 0 AS is_superuser, r_regionkey % 2 = 0 AS is_private FROM region",
    "layers": "SELECT n_nationkey AS id, n_regionkey AS user_id, n_name AS layer_name, n_nationkey < 5 AS is_master FROM nation",
    "markers": "SELECT c_custkey AS id, n_regionkey AS user_id, c_nationkey AS layer_id, c_name AS marker_name, CAST(20.25 AS DOUBLE) + CAST(c_custkey * 7919 % 25301 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude, CAST(122.56 AS DOUBLE) + CAST(c_custkey * 104729 % 31031 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude, c_mktsegment AS detail FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "text_markers": "SELECT doc_id AS id, lang AS user_id, source AS layer_id, text AS detail FROM documents",
    "shapes": "SELECT o_orderkey AS id, n_regionkey AS user_id, c_nationkey AS layer_id, CASE o_orderkey % 4 WHEN 0 THEN 'polyline' WHEN 1 THEN 'polygon' WHEN 2 THEN 'rectangle' ELSE 'circle' END AS shape_type, nullif(o_orderpriority, '4-NOT SPECIFIED') AS name, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "vertices": "SELECT l_orderkey AS shape_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq, CAST(35 AS DOUBLE) + CAST(l_partkey * 7919 % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat, CAST(139 AS DOUBLE) + CAST((l_suppkey * 104729 + l_linenumber * 31) % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lng FROM lineitem",
    "images": "SELECT p_partkey AS id, p_brand AS user_id, p_name || CASE p_partkey % 7 WHEN 0 THEN '.png' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.pdf' WHEN 4 THEN '.PDF' WHEN 5 THEN '.mp4' ELSE '.txt' END AS filename FROM part",
    "shares": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS create_at, o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) AS expiration FROM orders",
    "attempts": "SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'code' WHEN 'signup' THEN 'unlock' ELSE 'password' END AS kind, CASE WHEN event_type = 'purchase' THEN event_id % 2 = 0 ELSE event_type <> 'error' END AS ok, user_id % 10 <> 9 AS known, user_id % 3 = 0 AS second FROM events",
    "positions": "SELECT user_id, ts, value FROM events",
}


def with_views(sql: str) -> str:
    """sql with the views that it names put before it."""
    used = [v for v in VIEWS_SQL if f"{v} " in f"{sql} ".replace(")", " ").replace("\n", " ").replace(",", " ")]
    head = ", ".join(f"{v} AS ({VIEWS_SQL[v]})" for v in used)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(start):
            return f"{start}{head}, {sql.lstrip()[len(start):]}" if head else sql
    return f"WITH {head} {sql}" if head else sql
