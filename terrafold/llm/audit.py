"""How filters interact: what each removes, alone and after others, in every order.

Each document becomes a word of 32 bits, its truth table: bit S says whether the document survives the filters
of the set S. A filter that fails a document clears the half of the bits whose sets hold it. Words are counted
place by place with carry-save adders: three words of one weight become their sum bits and, at twice the weight,
their carry bits, until each weight has two words at most; a word that stands for many documents enters at the
weights of the bits of their number. The 32 counts of each part and label are all that an order's figures need:
what a filter removes after others is the difference of the survivors of two sets.

A repeated text is told by its digest. Rows are counted by digest, part, label and word before digests meet, so
a text that fills a third of the table is a few rows of counts.

Defined results: a null text is an empty one and a null part an empty string; a row without an id repeats nothing
and is repeated by nothing; rows of one id and one text are counted each and repeat each other only if a smaller
id holds the text; of several labels of an id the highest counts; an empty table has no rows. Columns other than
doc_id, text and the part are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ALL = 0xFFFFFFFF
WHITE = " \t\n\x0b\x0c\r"
#: What is counted apart: all documents, good ones, toxic ones.
LABELS = ("all", "good", "toxic")
COUNTS = "part string, label string, counts array<long>"


def holding(k: int) -> int:
    """The bits whose sets hold filter k."""
    return sum(1 << s for s in range(SETS) if s >> k & 1)


def words_of(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(WHITE)), r"[ \t-\r]+")


def failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails each filter that looks at it alone; words: of the text."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    blank = F.element_at(words, 1) == ""
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [blank | (n < 50), ~blank & (100 * distinct.cast("long") < 65 * n.cast("long")), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def survival(failed: list[Column], first: int = 0) -> Column:
    """The word of a document, by the filters from number first on."""
    dead = F.lit(0).cast("long")
    for k, fails in enumerate(failed, first):
        dead = dead.bitwiseOR(F.when(fails, F.lit(holding(k)).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.lit(ALL).cast("long").bitwiseXOR(dead)


class Places:
    """Positional counts of words by carry-save adders; planes[w] holds words of weight 2 ** w."""

    def __init__(self) -> None:
        self.planes: list[np.ndarray] = []

    def add(self, words: np.ndarray, times: np.ndarray) -> None:
        """Each word enters, once, every plane whose bit its number of documents has."""
        times = times.astype(np.int64)
        for w in range(int(times.max(initial=0)).bit_length()):
            self._extend(w, words[times >> w & 1 == 1].astype(np.uint32))
        self.settle()

    def _extend(self, w: int, words: np.ndarray) -> None:
        while len(self.planes) <= w:
            self.planes.append(np.zeros(0, np.uint32))
        self.planes[w] = np.concatenate([self.planes[w], words])

    def settle(self) -> None:
        """Adds until no plane has more than two words."""
        w = 0
        while w < len(self.planes):
            own = self.planes[w]
            while len(own) > 2:
                k = len(own) // 3
                a, b, c, rest = own[:k], own[k : 2 * k], own[2 * k : 3 * k], own[3 * k :]
                half = a ^ b
                self._extend(w + 1, (a & b) | (half & c))
                own = np.concatenate([half ^ c, rest])
            self.planes[w] = own
            w += 1

    def counts(self) -> np.ndarray:
        """Of each bit, in how many documents' words it is set."""
        bits = np.arange(SETS, dtype=np.uint32)
        return sum((((own[:, None] >> bits & 1).sum(0).astype(np.int64) << w) for w, own in enumerate(self.planes)), np.zeros(SETS, np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, good, toxic, word, times) to counts by part and label, batch by batch, so few parts are held at once."""
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        names, own = parts.dictionary.to_pylist(), np.asarray(parts.indices)
        words, times = np.asarray(batch.column("word")), np.asarray(batch.column("times"))
        marks = [np.ones(len(own), bool), *(np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool) for c in LABELS[1:])]
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(len(names) + 1))
        out: list[tuple[str, str, list[int]]] = []
        for k, name in enumerate(names):
            at = order[edges[k] : edges[k + 1]]
            for label, marked in zip(LABELS, marks):
                places = Places()
                places.add(words[at][marked[at]], times[at][marked[at]])
                out.append((name, label, places.counts().tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.list_(pa.int64())))], names=["part", "label", "counts"])


def survivors(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, all, good, toxic): for each part the numbers of documents, and of good and of toxic ones, that survive each set of filters."""
    texts = documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    told = texts.withColumn("words", words_of(F.col("text")))
    rows = told.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), survival(failures(F.col("text"), F.col("words"))).alias("word"))
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    by_id = rows.groupBy("doc_id", "part", "digest", "word").agg(F.count("*").alias("times"))
    marked = by_id.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in LABELS[1:]})
    # Counts meet by digest, not rows: how many of them the smallest id holds is kept beside.
    own = ("digest", "part", *LABELS[1:], "word", "numbered")
    met = marked.withColumn("numbered", F.col("doc_id").isNotNull()).groupBy(*own).agg(F.sum("times").alias("times"), F.min("doc_id").alias("lowest"), F.min_by("times", "doc_id").alias("at_lowest"))
    met = met.withColumn("first", F.min("lowest").over(Window.partitionBy("digest")))
    kept = F.when(~F.col("numbered"), F.col("times")).when(F.col("lowest") == F.col("first"), F.col("at_lowest")).otherwise(0)
    repeated = F.col("word").bitwiseAND(survival([F.lit(True)], first=FILTERS.index("E")))
    words = F.inline(F.array(F.struct(F.col("word").alias("word"), kept.alias("times")), F.struct(repeated.alias("word"), (F.col("times") - kept).alias("times"))))
    # Adders count within each batch, Spark sums what they found.
    sums = met.select("part", *LABELS[1:], words).where("times > 0").mapInArrow(_count, COUNTS)
    at = lambda label, s: F.sum(F.when(F.col("label") == label, F.element_at("counts", s + 1)).otherwise(0))
    return sums.groupBy("part").agg(*(F.array(*(at(label, s) for s in range(SETS))).alias(label) for label in LABELS))


def report(survived: DataFrame) -> DataFrame:
    """Of survivors(): a row for each part, order of the filters and step, with what the filter does there."""
    at = lambda counts, s: F.element_at(F.col(counts), s + 1)
    n = len(FILTERS)
    others = [sum(1 << j for j in range(n) if j != k) for k in range(n)]
    # In so many orders a filter comes right after the filters of a set.
    shapley = [sum((factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (at("all", F.lit(s)) - at("all", F.lit(s | 1 << k))) for s in range(SETS) if not s >> k & 1), F.lit(0)) for k in range(n)]
    alone = [at("all", F.lit(others[k])) - at("all", F.lit(SETS - 1)) for k in range(n)]
    per_part = survived.select("*", F.array(*shapley).alias("shapleys"), F.array(*alone).alias("alones"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order")
    rows = per_part.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = F.element_at(F.array(*(F.lit(1 << k) for k in range(n))), F.col("_k"))
    prefix = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.contains(prefix, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"_k": place, "_before": before}).withColumn("_after", F.col("_before") + bit)
    gone = lambda counts: at(counts, F.col("_before")) - at(counts, F.col("_after"))
    fails = at("all", F.lit(0)) - at("all", bit)
    return rows.select("part", "filter_order", "step", at("all", F.col("_after")).alias("kept"), gone("all").alias("removed"), (fails - gone("all")).alias("redundant"), F.element_at("alones", F.col("_k")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.element_at("shapleys", F.col("_k")).alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return report(survivors(documents, labels, part))
