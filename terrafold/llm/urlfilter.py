"""URL filtering by host-suffix and path-prefix rules.

Each URL becomes the expressions that a rule could be: its last k host labels joined to the first l
characters of its path, for the k and l that occur among the rules. Expressions meet rules on a short
hash prefix; the whole digest then confirms, and the longest rule decides.

Defined results: a null URL or one without ``://`` has an empty host and path and takes the default
verdict; of equally long rules the greater rule string wins, then block before allow; repeated pages
each keep their row; an empty rule table leaves every page to the default; other columns of ``pages``
are left out, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """pages with (id, url), rules with (verdict, host, path): id, host, path, rule, verdict for each page."""
    rules = rules.select("verdict", F.concat("host", "path").alias("rule"), F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("chars")).where("rule is not null")
    # Numbers of labels and of path characters: at most as many as a URL has, whatever the number of rules.
    shapes = rules.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("chars"))).first()
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    parts = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes[0]:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, chars = (f"array({','.join(map(str, x))})" for x in shapes)
    expressions = F.expr(f"""flatten(transform(filter({labels}, k -> k <= size(split(host, '[.]'))),
        k -> transform(filter({chars}, l -> l <= length(path)), l -> concat(substring_index(host, '.', -k), left(path, l)))))""")
    asked = parts.select("url", F.explode(F.array_distinct(expressions)).alias("expression")).select("url", digest(F.col("expression")).alias("full"))
    known = rules.select("rule", "verdict", digest(F.col("rule")).alias("known_full"))
    found = (
        asked.withColumn("short", F.substring("full", 1, PREFIX_HEX))
        .join(known.withColumn("short", F.substring("known_full", 1, PREFIX_HEX)), "short")
        .where(F.col("full") == F.col("known_full"))
    )
    # One row for each URL, made before the shuffle; the pages of a hot URL then meet it in a join that Spark may split.
    best = found.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("length"), "rule", "verdict")).alias("best"))
    return parts.join(best, "url", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
