"""Tables that change as a whole: versions are staged as files, and a manifest makes one the current version.

A version's tables are written to a folder of their own. Only when all of them are complete, a manifest that
names the folder is put in place, by a rename that fails if another writer took the number. Readers follow the
last manifest, so they see all of a version or nothing of it; what fails on the way leaves files that no manifest
names. Everything goes through Spark's file systems, so a store may lie wherever Spark can write.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, a local session gets a temporary one; a cluster's executors could not read that."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrafold-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that all who read it see the same rows."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file to a name that is not taken; missing folders are made."""
    fs, source = _files(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        raise FileExistsError(new)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none where there is no folder."""
    fs, where = _files(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def version(spark: SparkSession, store: str) -> int:
    """The number of the current version; 0 where nothing was committed."""
    return max((int(n.removesuffix(".json")) for n in names_in(spark, f"{store}/{MANIFESTS}") if n.endswith(".json")), default=0)


def commit(tables: dict[str, DataFrame], store: str) -> int:
    """Writes all tables and makes them the current version, whose number is returned.

    If a table cannot be written, or another version was committed meanwhile, this raises and the version before stays."""
    spark = next(iter(tables.values())).sparkSession
    number, folder = version(spark, store) + 1, f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{store}/{folder}/{name}")
    manifest = {"version": number, "tables": {name: {"path": f"{folder}/{name}", "schema": df.schema.jsonValue()} for name, df in tables.items()}}
    fs, place = _files(spark, f"{store}/{folder}/manifest")
    out = fs.create(place, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    renamed(spark, f"{store}/{folder}/manifest", f"{store}/{MANIFESTS}/{number:020d}.json")
    return number


def read(spark: SparkSession, store: str, table: str, number: int | None = None) -> DataFrame:
    """A table of the current version, or of the version asked for."""
    from pyspark.sql.types import StructType

    number = number or version(spark, store)
    if not number:
        raise FileNotFoundError(f"no version in {store}")
    text = spark.read.text(f"{store}/{MANIFESTS}/{number:020d}.json", wholetext=True).first()[0]
    told = json.loads(text)["tables"][table]
    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{store}/{told['path']}")
