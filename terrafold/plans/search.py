"""Searches and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.text import LOWER, UPPER
from terrafold.operators.search import in_scope, search, with_layer_name
from terrafold.plans.registry import query
from terrafold.sources.tables import layers, markers, text_markers

TERMS = {"none": [], "one": ["00_1"], "two": ["#0", "build"]}


def _like(column: str, term: str) -> str:
    fold = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"{fold(column)} LIKE {fold(chr(39) + '%' + chr(92) + term + '%' + chr(39))} ESCAPE '\\'"


def _register(kind: str, scope: str, layer: int) -> None:
    where = "".join(f" AND ({_like('m.marker_name', t)} OR {_like('m.detail', t)})" for t in TERMS[kind])
    scoped = "" if scope == "master" else f" AND m.layer_id = {layer}"
    sql = f"SELECT m.id, m.marker_name, m.detail, m.latitude, m.longitude, coalesce(l.layer_name, 'Layer Name Get Error') AS layer_name FROM markers m LEFT JOIN layers l ON m.layer_id = l.id WHERE m.user_id = 1{scoped}{where}"

    @query(sql, f"marker_search_{kind}_{scope}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = search(in_scope(markers(spark, d), layers(spark, d), 1, layer), TERMS[kind])
        named = with_layer_name(found, layers(spark, d))
        return named.select("id", "marker_name", "detail", "latitude", "longitude", "layer_name").orderBy(F.desc("id"))


for _kind in TERMS:
    for _scope, _layer in (("master", 1), ("layer", 6)):
        _register(_kind, _scope, _layer)

TEXT_TERMS = ["THE", "É", "é", "t_e", "a%z", "%%%", "%the", "@example"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, count(*) AS n FROM text_markers WHERE {_like('detail', t)}" for t in TEXT_TERMS))
def text_search_counts(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.functions.text import matches

    found = text_markers(spark, d).agg(*(F.count_if(matches(F.col("detail"), t)).alias(f"n{i}") for i, t in enumerate(TEXT_TERMS)))
    return found.select(F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"n{i}").alias("n")) for i, t in enumerate(TEXT_TERMS)))).alias("x")).select("x.*")


@query("SELECT id, marker_name FROM markers WHERE user_id = 2 AND layer_id = 7")
def markers_by_layer(spark: SparkSession, d: str) -> DataFrame:
    return markers(spark, d).where((F.col("user_id") == 2) & (F.col("layer_id") == 7)).select("id", "marker_name")


@query("SELECT id, marker_name, layer_id FROM markers WHERE user_id = 2")
def markers_scope_no_layer(spark: SparkSession, d: str) -> DataFrame:
    """is_master false but no layer given: this reading shows all of the tenant's markers."""
    is_master, layer = False, None
    own = markers(spark, d).where(F.col("user_id") == 2)
    return (own.where(F.col("layer_id") == layer) if is_master is False and layer is not None else own).select("id", "marker_name", "layer_id")


@query("SELECT id, marker_name FROM markers WHERE user_id = 2 AND layer_id = NULL")
def map_scope_null_layer(spark: SparkSession, d: str) -> DataFrame:
    """The map's own reading of the same request: a null layer equals nothing."""
    return markers(spark, d).where((F.col("user_id") == 2) & (F.col("layer_id") == F.lit(None).cast("int"))).select("id", "marker_name")


@query("SELECT u.user_id, l.id AS layer_id, coalesce(l.is_master AND l.user_id = u.user_id, false) AS is_master FROM users u JOIN layers l ON true")
def master_scope(spark: SparkSession, d: str) -> DataFrame:
    """Whether a layer is a user's master layer, for 5 users and 25 layers: sizes fixed at every scale."""
    from terrafold.sources.tables import users

    owners = F.broadcast(users(spark, d).select("user_id"))
    return layers(spark, d).select(F.col("id").alias("layer_id"), F.col("user_id").alias("owner"), F.col("is_master").alias("m")).join(owners).select("user_id", "layer_id", (F.col("m") & (F.col("owner") == F.col("user_id"))).alias("is_master"))
