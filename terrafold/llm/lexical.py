"""The best documents for each of many items, by whole-number BM25, with what items share worked out once.

Items are mined for shared term sets. Terms that the same items hold equally often are one leaf. Each item's
leaves stand in order of how many items hold them, and two neighbours that at least two items share become a
node of their own, again and again, until none are left: a graph in which every node is the sum of two others,
and each item the sum of a few nodes. For a document the leaves' partial sums are made once from its postings,
the nodes' from theirs, level by level, and the items' from these.

Documents are read once for each block of items: a pass writes each document's length and its counts of the
block's terms, from which Spark sums the statistics; the second pass, over these postings, scores. A task keeps
the best TOP of each item; Spark ranks what the tasks kept, by item and a salt first.

Items come in blocks of at most BLOCK_TERMS terms, a longer item alone; a block's terms and graph are broadcast,
so that bounds them. A document is one task's work, however long.

Defined results: a null or empty text has no terms and is neither counted nor found; an item without terms finds
nothing; a document without an id counts and is not found; repeated rows of documents are documents of their own, in no order among themselves; equal rows of the
items are one item, and different texts under one id are ranked each on its own; empty tables give no rows;
columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrafold.llm.common import bytes_of, written

TOP, BLOCK_TERMS = 10, 1 << 20
#: Sums that a task holds at once: nodes times documents.
HELD_SUMS = 1 << 21
SALTS = 32
#: ASCII letters to lower case; all other ASCII but digits parts terms; bytes of other characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


@dataclass
class Sharing:
    """What a block of items needs: terms' numbers, and the graph. Nodes below leaves are leaves; the node after them sum left and right, level by level."""

    terms: dict[bytes, int]
    #: For each term its leaves, as a range of leaf and times.
    leaf_at: np.ndarray
    leaf: np.ndarray
    times: np.ndarray
    leaves: int
    #: Of each level of sums, the left and right nodes.
    levels: list[tuple[np.ndarray, np.ndarray]]
    #: Of each item, its nodes, as a range.
    item_at: np.ndarray
    item_node: np.ndarray

    @property
    def nodes(self) -> int:
        return self.leaves + sum(len(left) for left, _ in self.levels)


def mined(items: list[list[bytes]]) -> Sharing:
    """The graph of items with at least a term each."""
    holders: dict[bytes, list[tuple[int, int]]] = {}
    for i, words in enumerate(items):
        for term, n in sorted(Counter(words).items()):
            holders.setdefault(term, []).append((i, n))
    # A leaf is the terms of one set of items: the rest of what differs is a leaf of its own for each number of times.
    terms, leaf_of, entries, of_item = {}, {}, [], [[] for _ in items]
    for term, own in holders.items():
        terms[term] = len(terms)
        by_times: dict[int, list[int]] = {}
        for i, n in own:
            by_times.setdefault(n, []).append(i)
        for n, who in by_times.items():
            key = tuple(who)
            if key not in leaf_of:
                leaf_of[key] = len(leaf_of)
                for i in key:
                    of_item[i].append(leaf_of[key])
            entries.append((terms[term], leaf_of[key], n))
    held = Counter(x for own in of_item for x in own)
    rows = [sorted(own, key=lambda x: (-held[x], x)) for own in of_item]
    levels, nodes = [], len(leaf_of)
    while True:
        pairs = Counter(p for row in rows for p in set(zip(row, row[1:])))
        shared = {p: k for p, k in pairs.items() if k > 1}
        made: dict[tuple[int, int], int] = {}
        for r, row in enumerate(rows):
            out, at = [], 0
            while at < len(row):
                own = tuple(row[at : at + 2])
                # Of two pairs that overlap the one that more items share is taken.
                if shared.get(own, 0) >= max(2, shared.get(tuple(row[at + 1 : at + 3]), 0)):
                    out.append(made.setdefault(own, nodes + len(made)))
                    at += 2
                else:
                    out.append(row[at])
                    at += 1
            rows[r] = out
        if not made:
            break
        levels.append((np.array([a for a, _ in made], np.int64), np.array([b for _, b in made], np.int64)))
        nodes += len(made)
    entries.sort()
    at = np.searchsorted(np.array([x[0] for x in entries]), np.arange(len(terms) + 1))
    sizes = np.array([len(row) for row in rows], np.int64)
    return Sharing(terms, at, np.array([x[1] for x in entries], np.int64), np.array([x[2] for x in entries], np.int64), len(leaf_of), levels, np.append(0, np.cumsum(sizes)), np.array([x for row in rows for x in row], np.int64))


def weights_of(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))) in doubles; 0 where no document holds the term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) if n else 0 for n in df], np.int64)


def sums_of(sharing: Sharing, weight: np.ndarray, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Scores of documents, a row for each item. sizes: how many of the postings (term, tf) each document has."""
    doc = np.repeat(np.arange(len(m)), sizes)
    each = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    n = np.diff(sharing.leaf_at)[term]
    at = np.repeat(sharing.leaf_at[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    sums = np.zeros((sharing.nodes, len(m)), np.int64)
    cell = sharing.leaf[at] * len(m) + np.repeat(doc, n)
    order = np.argsort(cell, kind="stable")
    if len(order):
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sums.ravel()[cell[order][first]] = np.add.reduceat((np.repeat(each, n) * sharing.times[at])[order], first)
    start = sharing.leaves
    for left, right in sharing.levels:
        sums[start : start + len(left)] = sums[left] + sums[right]
        start += len(left)
    return np.add.reduceat(sums[sharing.item_node], sharing.item_at[:-1], axis=0)


class Best:
    """The best TOP documents of each item so far."""

    def __init__(self, items: int):
        self.least = np.ones(items, np.int64)
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.new.append((item, scores[item, doc], ids[doc]))
        self.held += len(item)
        if self.held > max(1 << 16, 4 * TOP * len(self.least)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, score, doc = (np.concatenate(x) for x in zip(self.kept, *self.new))
        order = np.lexsort((doc, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.least)))
        order = order[np.arange(len(order)) - first[item[order]] < TOP]
        self.kept, self.new, self.held = (item[order], score[order], doc[order]), [], 0
        n = np.bincount(self.kept[0], minlength=len(self.least))
        last = np.cumsum(n) - 1
        self.least[n == TOP] = self.kept[1][last[n == TOP]]
        return self.kept


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Keys (item_id, its number among the texts of its id) and terms of the items, up to BLOCK_TERMS terms at a time; rows come to the driver one by one."""
    keys, found, n, before = [], [], 0, None
    for item_id, text in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        before = (item_id, before[1] + 1 if before and before[0] == item_id else 0)
        if not (own := terms_of((text or "").encode())):
            continue
        if found and n + len(own) > BLOCK_TERMS:
            yield keys, found
            keys, found, n = [], [], 0
        keys.append(before)
        found.append(own)
        n += len(own)
    if found:
        yield keys, found


def postings(rows: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms: how many, and the counts of the block's, as packed numbers."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            n, terms, tfs = [], [], []
            for a, b in zip(at[:-1], at[1:]):
                words = terms_of(data[a:b].tobytes())
                found = np.fromiter((x for x in map(number, words) if x is not None), np.int32)
                own, times = np.unique(found, return_counts=True)
                n.append(len(words))
                terms.append(own.astype("<i4").tobytes())
                tfs.append(times.astype("<i4").tobytes())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(n) > 0))

    return rows.mapInArrow(apply, "doc_id long, n long, terms binary, tfs binary")


def statistics(posted: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms and, for each of a block's terms, how many documents hold it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            data, _ = bytes_of(batch.column("terms"))
            counts += np.bincount(data.view("<i4"), minlength=terms)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["term", "df"])

    documents, length = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(terms, np.int64)
    for term, n in posted.select("terms").mapInArrow(apply, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # a row for each term of the block
        df[term] = n
    return documents, length, df


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score, text_number: the documents with the highest scores above 0 for each item; text_number tells texts of one item_id apart."""
    spark: SparkSession = documents.sparkSession
    if top > TOP:
        raise ValueError(f"at most {TOP}")
    kind = items.schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, text_number int, doc_id long, score long"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = spark.createDataFrame([], schema)
    for keys, terms in _blocks(items):
        sharing = mined(terms)
        posted = written(postings(rows, spark.sparkContext.broadcast(sharing.terms)))
        n, length, df = statistics(posted, len(sharing.terms))
        weight = weights_of(df, n)
        sharing.terms = {}
        shared = spark.sparkContext.broadcast((sharing, weight, n, length))

        def score(batches: Iterator[pa.RecordBatch], shared=shared, keys=keys) -> Iterator[pa.RecordBatch]:
            sharing, weight, documents, length = shared.value
            best, step = Best(len(keys)), max(1, HELD_SUMS // sharing.nodes)
            for batch in batches:
                batch = batch.filter(batch.column("doc_id").is_valid())
                ids, n = np.asarray(batch.column("doc_id")), np.asarray(batch.column("n"))
                m = 25 + (75 * n * documents) // length
                (term, at), (tf, _) = (bytes_of(batch.column(c)) for c in ("terms", "tfs"))
                term, tf, at = term.view("<i4"), tf.view("<i4").astype(np.int64), at // 4
                for a in range(0, len(ids), step):
                    b = min(a + step, len(ids))
                    best.add(sums_of(sharing, weight, m[a:b], np.diff(at[a : b + 1]), term[at[a] : at[b]], tf[at[a] : at[b]]), ids[a:b])
            item, told, doc = best.settle()
            own = [keys[i] for i in item]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], to_arrow_type(kind)), pa.array([x[1] for x in own], pa.int32()), pa.array(doc), pa.array(told)], names=["item_id", "text_number", "doc_id", "score"])

        found = found.union(posted.mapInArrow(score, schema))
    item, order = ("item_id", "text_number"), (F.desc("score"), "doc_id")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    some = found.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(Window.partitionBy(*item, "_salt").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(*item).orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score", "text_number")
