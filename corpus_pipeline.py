"""A pipeline of corpus operators over documents: each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, decontaminate, secrets, simhash, toxicity
from terrafold.llm.common import row_key, shared_folder, table
from terrafold.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learns from those of these documents that have a label.

    Null and empty texts score the model's bias, which in a mostly clean corpus keeps them; repeated rows are kept or go together;
    with no labels of one kind, and so for empty tables, the share of toxic labels decides; whole long texts are scored."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose 5-word shingles are 0.8 alike one row: the smallest id, nulls last, and of rows with that id the one with the smallest hash.

    Null texts and texts without words are one component; equal rows leave one; different texts under one id, or under none, are
    told apart by their hashes; long texts are compared as wholes; an empty table stays empty."""
    keyed = docs.select(*COLUMNS).withColumn("_key", row_key(*COLUMNS))
    kept = simhash.survivors(keyed, "_key").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_kept"))
    rows = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_kept")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked.

    Null and empty texts stay; repeated rows stay or go together; items without words match nothing; an empty benchmark drops nothing."""
    return decontaminate.drop_leaked(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in a text replaced by its kind; n_chars follows where a text changed.

    Null texts stay null, empty ones empty, repeated rows are redacted alike; spans that overlap go as one, named by the first."""
    rows = docs.select(*COLUMNS)
    found = secrets.scan(rows, secrets.fit_cuts(rows), "_spans", "_clean")
    chars = F.when(F.size("_spans") > 0, F.length("_clean").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("_clean").alias("text"), "lang", "source", chars.alias("n_chars"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number. Null and empty texts have no ids; repeated rows are encoded each; ids keep the text's order however long it is."""
    return bpe.encode(docs.select("doc_id", "text"), vocabulary(), public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level bpe", encode_texts),
]

#: No SQL expresses the classifier; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Stages write to the shared folder in spark.checkpoint.dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
