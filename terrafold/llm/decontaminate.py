"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Texts are words (runs of letters and digits, lower-cased). A first pass over all documents counts, in how
many of them each n-gram of the test items occurs. Seeds are all n-grams that occur in at most COMMON of
the documents (or in COMMON_ROWS), and in every stretch of STRETCH n-grams of an item the rarest of those
that occur: an edited copy meets on whatever it kept, and however common a passage is, each part of it
keeps a seed. A second pass finds the seeds in the documents; where some meet an item on about one diagonal
and enough of its words are near for the score, the passage around is aligned with the whole item (word by
word: match +2, mismatch -1, gap -1), and the item counts as leaked if the alignment scores at least LEAST
of what the whole item scores with itself, or LONG.

Items go to the tasks by broadcast, BLOCK_WORDS words of them at a time, so the bound holds for any number
of items; further blocks repeat both passes.

Defined results: null and empty texts match nothing, nor do items of fewer than N words, unless the
document holds the whole item as its words; repeated documents and repeated items each give their
rows; of several places in a document where an item aligns the best is returned, the first of equals;
null item ids are kept as null; other columns are left out. What shares no n-gram with an item is not found.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terrafold.llm.common import row_key

N, STRETCH, LEAST = 3, 3, 0.5
COMMON, COMMON_ROWS = 0.01, 1000
#: The score of 50 equal words, which leak from an item of any length.
LONG = 100
MATCH, MISMATCH, GAP = 2, 1, 1
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Items:
    """Some test items as word numbers, with their n-grams; 0 is any other word."""

    def __init__(self, texts: list[str]):
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)], np.int64) for t in texts]
        grams: dict[tuple[int, ...], int] = {}
        self.grams = [[grams.setdefault(tuple(w[i : i + self.n(w)].tolist()), len(grams)) for i in range(len(w) - self.n(w) + 1)] if len(w) else [] for w in self.words]
        self.gram = grams
        if (len(self.number) + 1) ** N >= 1 << 63:
            raise ValueError("an item has more than two million different words")
        #: By length, the n-grams as sorted numbers to the base of the vocabulary, and which gram each is.
        self.codes = {}
        for n in {len(g) for g in grams}:
            own = np.array([(*g, i) for g, i in grams.items() if len(g) == n], np.int64)
            code = self._coded(own[:, :n].T)
            order = np.argsort(code)
            self.codes[n] = code[order], own[order, n]
        self.bags = [Counter(w.tolist()) for w in self.words]

    @staticmethod
    def n(words: np.ndarray) -> int:
        return min(N, len(words))

    def _coded(self, words: np.ndarray) -> np.ndarray:
        """N numbers of words as one."""
        code = words[0]
        for w in words[1:]:
            code = code * (len(self.number) + 1) + w
        return code

    def read(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and grams of the items' grams in a text."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (codes, grams) in self.codes.items():
            if (m := len(numbers) - n + 1) > 0:
                parts = [numbers[k : m + k] for k in range(n)]
                at = np.flatnonzero(np.logical_and.reduce([p > 0 for p in parts]))
                code = self._coded(np.stack([p[at] for p in parts]))
                i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                same = codes[i] == code
                places.append(at[same])
                found.append(grams[i[same]])
        return np.concatenate(places), np.concatenate(found)


def seeds_of(items: Items, counts: dict[int, int], common: int = COMMON_ROWS) -> dict[int, list[tuple[int, int]]]:
    """gram: (item, place) of each seed. counts: of the grams that occur; those up to common are seeds anywhere."""
    seeds = defaultdict(list)
    for item, grams in enumerate(items.grams):
        for a in range(0, len(grams), STRETCH):
            there = [p for p in range(a, min(a + STRETCH, len(grams))) if counts.get(grams[p], 0)]
            rarest = min(there, key=lambda p: (counts[grams[p]], p), default=None)
            for p in there:
                if p == rarest or counts[grams[p]] <= common:
                    seeds[grams[p]].append((item, p))
    return dict(seeds)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best score, and the start and end in passage of the first alignment that has it."""
    n = len(passage)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1) * GAP
    best = (0, 0, 0)
    for word in item:
        take = np.where(passage == word, MATCH, -MISMATCH)
        diagonal, above = score[:-1] + take, score[1:] - GAP
        down = diagonal >= above
        now = np.append(0, np.where(down, diagonal, above))
        begin = np.append(0, np.where(down, start[:-1], start[1:]))
        none = now <= 0
        now[none] = 0
        begin[none] = np.flatnonzero(none)
        # Gaps in the item run along the row: the best of what stands to the left less its distance.
        lifted = now + steps
        lead = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == lead, np.arange(n + 1), 0))
        score, start = lead - steps, begin[source]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


def leaks(items: Items, seeds: dict[int, list[tuple[int, int]]], text: str, least: float = LEAST) -> list[tuple[int, float, int, int, int]]:
    """(item, share of its full score, first word, end, seeds) of the items that leaked into a text."""
    array = items.read(text)
    met = defaultdict(list)
    for place, gram in zip(*(x.tolist() for x in items.hits(array))):
        for item, own in seeds.get(gram, ()):
            met[item].append(place - own)
    out = []
    for item, offsets in met.items():
        words = items.words[item]
        reach = len(words) // 2 + 2
        enough = min(least * MATCH * len(words), LONG)
        offsets.sort()
        best, at = None, 0
        while at < len(offsets):
            # Seeds on diagonals that are close belong to one passage.
            end = at
            while end + 1 < len(offsets) and offsets[end + 1] - offsets[end] <= reach:
                end += 1
            low, high = max(0, offsets[at] - reach), min(len(array), offsets[end] + len(words) + reach)
            # No alignment scores more than all words that both hold.
            if MATCH * (items.bags[item] & Counter(array[low:high].tolist())).total() >= enough:
                score, a, b = align(words, array[low:high])
                share = score / (MATCH * len(words))
                if score >= enough and (best is None or share > best[0]):
                    best = (share, low + a, low + b, end - at + 1)
            at = end + 1
        if best:
            out.append((item, *best))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, up to BLOCK_WORDS words at a time; rows come to the driver one by one."""
    ids, texts, n = [], [], 0
    for item_id, text in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        size = len(words_of(text or ""))
        if texts and n + size > BLOCK_WORDS:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(item_id)
        texts.append(text or "")
        n += size
    if texts:
        yield ids, texts


def find_leaks(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """A row for each document and item that leaked into it: doc_id, key, item_id, score, first_word, end_word, n_seeds."""
    spark: SparkSession = documents.sparkSession
    kind, item_kind = (x.dataType.simpleString() for x in (documents.schema["doc_id"], benchmark.schema["item_id"]))
    arrow_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    rows = documents.select("doc_id", row_key("doc_id", "text").alias("key"), "text").where("text is not null")
    schema = f"doc_id {kind}, key long, item_id {item_kind}, score double, first_word int, end_word int, n_seeds int"
    found = spark.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Items(texts))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            counts = np.zeros(len(items.gram) + 1, np.int64)
            for batch in batches:
                counts[-1] += batch.num_rows
                for text in batch.column("text"):
                    counts[np.unique(items.hits(items.read(text.as_py()))[1])] += 1
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["gram", "n"])

        # A row for each n-gram of the block at most, and one for the number of documents.
        counts = {r[0]: r[1] for r in rows.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect()}
        common = max(COMMON_ROWS, int(COMMON * counts.pop(len(shared.value.gram), 0)))
        seeds = spark.sparkContext.broadcast(seeds_of(shared.value, counts, common))

        def match(batches: Iterator[pa.RecordBatch], shared=shared, seeds=seeds, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, at = [], []
                for row, text in enumerate(batch.column("text")):
                    for leak in leaks(shared.value, seeds.value, text.as_py(), least):
                        out.append(leak)
                        at.append(row)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("key").take(take), pa.array([ids[x[0]] for x in out], arrow_kind), pa.array([x[1] for x in out], pa.float64()), *(pa.array([x[i] for x in out], pa.int32()) for i in (2, 3, 4))],
                    names=["doc_id", "key", "item_id", "score", "first_word", "end_word", "n_seeds"],
                )

        found = found.union(rows.mapInArrow(match, schema))
    return found


def drop_leaked(documents: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of documents into which no item leaked."""
    keyed = documents.withColumn("_key", row_key("doc_id", "text"))
    leaked = find_leaks(documents, benchmark, least).select(F.col("doc_id").alias("_id"), F.col("key").alias("_leaked")).distinct()
    return keyed.join(leaked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_leaked")), "left_anti").drop("_key")
