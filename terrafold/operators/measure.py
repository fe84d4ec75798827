"""Measurement of shapes from their vertices: one shuffle by shape serves every ordered computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from terrafold.functions import geo


# Windows need a session, so they are made when they are used and the module imports without one.
def by_shape() -> WindowSpec:
    return Window.partitionBy("shape_id").orderBy("seq")


def whole_shape() -> WindowSpec:
    return by_shape().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    return by_shape().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def segments(vertices: DataFrame) -> DataFrame:
    """Each vertex after the first with the one before it, the length between and the length so far."""
    paired = vertices.select("shape_id", "seq", "lat", "lng", F.lag("lat").over(by_shape()).alias("lat0"), F.lag("lng").over(by_shape()).alias("lng0"))
    measured = paired.withColumn("meters", geo.distance(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")))
    return measured.withColumn("so_far", F.sum("meters").over(so_far())).where("seq > 1")


def edges(vertices: DataFrame) -> DataFrame:
    """Each vertex with the next one, the last with the first."""
    nxt = lambda c: F.coalesce(F.lead(c).over(by_shape()), F.first(c).over(whole_shape()))
    return vertices.select("shape_id", "seq", "lat", "lng", nxt("lat").alias("lat1"), nxt("lng").alias("lng1"), F.max("seq").over(whole_shape()).alias("n"))


def projected_area(vertices: DataFrame) -> DataFrame:
    """Shoelace on Mercator coordinates relative to the first vertex, so that large terms do not cancel; fewer than three vertices: 0."""
    flat = vertices.select("shape_id", "seq", geo.mercator_x(F.col("lng")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"))
    near = flat.select("shape_id", "seq", (F.col("x") - F.first("x").over(whole_shape())).alias("x"), (F.col("y") - F.first("y").over(whole_shape())).alias("y"))
    nxt = lambda c: F.coalesce(F.lead(c).over(by_shape()), F.first(c).over(whole_shape()))
    crossed = near.select("shape_id", (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("c"))
    return crossed.groupBy("shape_id").agg(F.when(F.count("*") >= 3, F.abs(F.sum("c")) / 2).otherwise(0.0).alias("area"))


def halfway(vertices: DataFrame) -> DataFrame:
    """The point at half of a line's length. One point: that one; no length: the one at half of the count."""
    totals = F.coalesce(F.max("so_far").over(whole_shape()), F.lit(0.0))
    paired = vertices.select("shape_id", "seq", "lat", "lng", F.lag("lat").over(by_shape()).alias("lat0"), F.lag("lng").over(by_shape()).alias("lng0"))
    measured = paired.withColumn("meters", F.coalesce(geo.distance(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")), F.lit(0.0))).withColumn("so_far", F.sum("meters").over(so_far()))
    whole = measured.withColumn("total", totals).withColumn("n", F.max("seq").over(whole_shape()))
    reached = whole.where(F.when(F.col("total") > 0, (F.col("meters") > 0) & (F.col("so_far") >= F.col("total") / 2)).otherwise(F.col("seq") == F.floor(F.col("n") / 2) + 1))
    share = F.when(F.col("total") > 0, (F.col("total") / 2 - (F.col("so_far") - F.col("meters"))) / F.col("meters"))
    at = lambda c: F.when(F.col("total") > 0, F.col(c + "0") + (F.col(c) - F.col(c + "0")) * share).otherwise(F.col(c))
    return reached.groupBy("shape_id").agg(F.min(F.struct("seq", at("lat").alias("lat"), at("lng").alias("lng"))).alias("p")).select("shape_id", "p.lat", "p.lng")


def pair_groups(vertices: DataFrame) -> DataFrame:
    """Lengths of every two segments in a row, what is not finite counting 0."""
    grouped = segments(vertices).withColumn("pair", F.floor((F.col("seq") - 2) / 2))
    fine = F.when(F.isnan("meters"), 0.0).otherwise(F.coalesce("meters", F.lit(0.0)))
    return grouped.groupBy("shape_id", "pair").agg(F.sum(fine).alias("meters"), F.max("seq").alias("last_seq"))


def group_centres(vertices: DataFrame) -> DataFrame:
    """The point at half of the length of each two segments in a row; without length the middle of the first."""
    groups = segments(vertices).withColumn("pair", F.floor((F.col("seq") - 2) / 2))
    inside = Window.partitionBy("shape_id", "pair").orderBy("seq")
    run = groups.withColumn("reached", F.sum("meters").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", F.sum("meters").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    half = F.col("total") / 2
    share = F.when(F.col("total") <= 0, 0.5).when(F.col("meters") > 0, (half - (F.col("reached") - F.col("meters"))) / F.col("meters")).otherwise(0.0)
    at = lambda c: (F.col(c + "0") + (F.col(c) - F.col(c + "0")) * share).alias(c)
    hit = run.where((F.col("total") <= 0) | (F.col("reached") >= half))
    return hit.groupBy("shape_id", "pair").agg(F.min(F.struct("seq", at("lat"), at("lng"))).alias("p")).select("shape_id", "pair", "p.lat", "p.lng")
