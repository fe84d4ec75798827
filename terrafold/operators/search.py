"""Marker search: terms over name and detail within a tenant's layer or, from the master layer, all layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.text import matches


def in_scope(rows: DataFrame, layers: DataFrame, user: object, layer: object) -> DataFrame:
    """The user's rows of the layer, or all of them if it is the user's master layer. An unknown layer is no master.

    Filters by user and layer reach the scan of the layer's rows. The other layers' rows meet the one master row, if there
    is one; where there is none, adaptive execution drops their scan."""
    own = rows.where(F.col("user_id") == user)
    master = layers.where((F.col("id") == layer) & (F.col("user_id") == user) & F.col("is_master")).select(F.col("user_id").alias("_owner")).distinct()
    others = own.where(~F.coalesce(F.col("layer_id") == layer, F.lit(False)))
    return own.where(F.col("layer_id") == layer).union(others.join(F.broadcast(master), F.col("user_id") == F.col("_owner"), "left_semi"))


def search(markers: DataFrame, terms: list[str], columns: tuple[str, ...] = ("marker_name", "detail")) -> DataFrame:
    """Rows where each term that is not empty is in one of the columns."""
    wanted = [t for t in terms if t]
    if not wanted:
        return markers
    each = [reduce(lambda a, b: a | b, (F.coalesce(matches(F.col(c), t), F.lit(False)) for c in columns)) for t in wanted]
    return markers.where(reduce(lambda a, b: a & b, each))


def with_layer_name(rows: DataFrame, layers: DataFrame, default: str = "Layer Name Get Error") -> DataFrame:
    names = layers.select(F.col("id").alias("_layer"), F.col("layer_name").alias("_name"))
    return rows.join(names, F.col("layer_id") == F.col("_layer"), "left").withColumn("layer_name", F.coalesce("_name", F.lit(default))).drop("_layer", "_name")
