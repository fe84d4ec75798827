"""Changes as functions from tables to tables: inputs stay as they are, results are new DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new)


def insert_returning(rows: DataFrame, new: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The table after, and the keys of what was inserted."""
    return insert(rows, new), new.select(*keys)


def update_returning(rows: DataFrame, where: Column, values: dict[str, Column], *keys: str) -> tuple[DataFrame, DataFrame]:
    """The table after, and the keys of what was hit, as they stood before."""
    return update(rows, where, values), rows.where(where).select(*keys)


def update(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def delete(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(~F.coalesce(where, F.lit(False)))


def delete_returning(rows: DataFrame, where: Column, *columns: str) -> tuple[DataFrame, DataFrame]:
    return delete(rows, where), rows.where(where).select(*columns)


def cascade(children: DataFrame, key: str, deleted: DataFrame, deleted_key: str = "id") -> DataFrame:
    """children without those of deleted parents."""
    return children.join(deleted.select(F.col(deleted_key).alias(key)), key, "left_anti")


def merge(old: DataFrame, new: DataFrame, key: str, keep: list[str], update_flag: str) -> DataFrame:
    """One row for each key: where both sides have it and the flag holds, the columns of keep stay old; else the new row replaces it."""
    columns = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full")
    gone = F.col(f"n.{columns[0]}").isNull()
    pick = lambda c: F.when(gone | (F.col(f"o.{columns[0]}").isNotNull() & F.col(update_flag) & F.lit(c in keep)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(key, *map(pick, columns))
