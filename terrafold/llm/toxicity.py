"""Toxicity: a linear classifier on hashed character n-grams scaled by naive Bayes log-count ratios.

A document is the set of hashed grams of 3 to 8 code points of its lower-cased text. The ratios come from counts
over all labelled training rows, added up by Spark. The weights are then fitted by logistic regression
in one task on at most ``max_fit_rows`` of these rows (those with the smallest hash, at most
``max_fit_chars`` characters long), so that the fit has a bound while counting and scoring do not. Only
features whose ratio differs from 0 by more than counting noise take part.

Defined results: null and empty texts have no features and score the model's bias; repeated rows are
scored each; a document labelled twice counts as toxic if either label says so; null labels are not
used; with no labelled rows of one kind the score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 20
SIZE = 1 << BITS
#: Features whose counts travel in one row.
BLOCK = 1 << 12
GRAMS = (3, 4, 5, 6, 7, 8)
#: Standard errors by which a log-count ratio must differ from 0.
LEAST_ERRORS = 4.0
_MULTIPLIER = np.uint32(0x9E3779B1)


def features(text: str) -> np.ndarray:
    """Ascending feature numbers of a text."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code, found = x, []
    for n in range(2, max(GRAMS) + 1):
        if len(x) < n:
            break
        code = code[:-1] * np.uint32(0x01000193) + x[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
        if n in GRAMS:
            found.append(((code ^ (code >> np.uint32(15))) * _MULTIPLIER) >> np.uint32(32 - BITS))
    if not found:
        return np.zeros(0, np.uint32)
    h = np.concatenate(found)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def _each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield features(text.as_py() or "")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a partition, a row for each block of features: bytes of equal significance stand together, so zeros pack."""
    counts = np.zeros((2, SIZE), np.int64)
    for batch in batches:
        for label, found in zip(batch.column("toxic").to_pylist(), _each(batch)):
            counts[label][found] += 1
    if counts.any():
        blocks = counts.reshape(2, -1, BLOCK).transpose(1, 0, 2)
        packed = [zlib.compress(x.ravel().view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for x in map(np.ascontiguousarray, blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed), dtype=np.int32)), pa.array(packed, pa.binary())], names=["block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rows of each block as they come; holds one array a block, however many rows there are."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
            counts = np.ascontiguousarray(planes.T).view(np.int64).reshape(2, BLOCK)
            sums[block] = sums[block] + counts if block in sums else counts
    for block, counts in sums.items():
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array((at + block * BLOCK).astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["feature", "n0", "n1"])


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, r: np.ndarray, l2: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by r, by gradient steps with adaptive sizes; rows hold places in r."""
    y = labels.astype(float)
    blocks = []
    for a in range(0, len(rows), 500):
        part = rows[a : a + 500]
        blocks.append((slice(a, a + len(part)), np.concatenate(part), np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in part])))
    w, bias = np.ones(len(r)) * 0.1, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        scaled, g, total = r * w, np.empty(len(y)), np.zeros(len(r))
        for at, place, owner in blocks:
            z = np.bincount(owner, scaled[place], at.stop - at.start) + bias
            g[at] = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]
            total += np.bincount(place, g[at][owner], len(r))
        gw, gb = r * total / len(y) + l2 * w, g.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.05 * (1 - t / (steps + 1)) + 0.002
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w * r, float(bias)


def train(documents: DataFrame, labels: DataFrame, max_fit_rows: int = 8000, max_fit_chars: int = 40_000) -> tuple[np.ndarray, float]:
    """Learns from the rows of documents that have a label: a weight for each feature, and the bias."""
    examples = labelled(documents, labels)
    sizes = dict(examples.groupBy("toxic").count().collect())
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return np.zeros(SIZE), float(np.log((toxic + 1) / (clean + 1)))
    counts = examples.select("text", "toxic").mapInArrow(_count, "block int, counts binary").repartition("block").mapInArrow(_add, "feature int, n0 long, n1 long")
    shares = counts.select("feature", *((F.col(f"n{k}") + 1).alias(f"c{k}") for k in (0, 1)), *(((F.col(f"n{k}") + 1) / (n + 2)).alias(f"p{k}") for k, n in ((0, clean), (1, toxic))))
    ratios = shares.select("feature", F.log(F.col("p1") / F.col("p0")).alias("ratio"), F.sqrt((1 - F.col("p0")) / F.col("c0") + (1 - F.col("p1")) / F.col("c1")).alias("error"))
    # At most SIZE rows, whatever the corpus; some thousands tell.
    telling = ratios.where(F.abs("ratio") >= LEAST_ERRORS * F.col("error")).select("feature", "ratio").toArrow().to_pandas()
    keep = np.sort(telling["feature"].to_numpy())
    ratio = telling.sort_values("feature")["ratio"].to_numpy()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of = np.full(SIZE, -1, np.int32)
        place_of[keep] = np.arange(len(keep))
        found, labels = [], []
        for batch in batches:
            found += [x[x >= 0] for x in (place_of[features] for features in _each(batch))]
            labels += batch.column("toxic").to_pylist()
        if labels:
            w, bias = fit_weights(found, np.array(labels, int), ratio)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([bias])], names=["weights", "bias"])

    # The sample is chosen without its texts; as its size is bounded, these come by a broadcast of its keys.
    chosen = examples.where(F.col("chars") <= max_fit_chars).select("doc_id", "key", "toxic").distinct().orderBy("key", "doc_id").limit(max_fit_rows)
    few = keyed(documents).join(F.broadcast(chosen), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    fitted = few.select("text", "toxic").coalesce(1).mapInArrow(fit, "weights binary, bias double").first()
    if fitted is None:
        return np.zeros(SIZE), float(np.log(toxic / clean))
    weights = np.zeros(SIZE)
    weights[keep] = np.frombuffer(bytes(fitted[0]), np.float32)
    return weights, fitted[1]


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"), F.length(text).alias("chars"))


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, key, chars, toxic) of the rows of documents that have a label."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return keyed(documents).join(known.hint("merge"), "doc_id")  # labels have no bound


def score(documents: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """documents with a column of scores from 0 to 1, whose name, in any case, must be free."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # SIZE floats, 4 MB
    names, new = documents.columns, column
    if column.lower() in {x.lower() for x in names}:
        raise ValueError(f"column exists: {column}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            z = np.array([weights[x].sum(dtype=float) for x in _each(batch)]) + bias if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*names, new])

    schema = T.StructType([*documents.schema.fields, T.StructField(new, T.DoubleType())])
    return documents.mapInArrow(apply, schema)


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; learns only from rows that are not held out."""
    model = train(documents.where(~held_out()), labels)
    scored = score(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
