"""Repeated byte windows by a depth-limited radix sort.

A window is LENGTH bytes, one for each suffix of a text, and no byte beyond it is ever looked at. The
sort goes by digits of decreasing significance and drops what is alone or settled after each:

* the window's anchor: of its grams of GRAM bytes the one with the smallest hash, the leftmost of equals.
  Equal windows have equal anchors at equal distances, so none is lost; and neighbouring windows share
  their anchor, so this pass moves one row for a run of windows, about one for 57 bytes;
* the run's whole content, which settles runs that recur as a whole. The others that share their anchor
  with a different run go on, one of each content;
* the core of a block: the bytes that are common to the windows of STEP neighbouring distances from the
  anchor, then the block's whole content, which settles blocks that recur as a whole;
* the content of each window of the blocks whose core occurs in different blocks.

A plain radix sort moves a row for each byte of the corpus, some ten times its size, at its first pass; so
the first digit is taken from the middle of the window, not from its start, and groups are hashed together
rather than put in order: what is exact is which windows are equal, not where they would stand in a sorted
list. Digits are compared by hashes: a group has equal hashes of 64 bits, and equal contents within it have
another 64 bits in common.

Defined results: null and empty texts, and those shorter than LENGTH, keep all their bytes; identical
rows, also with one doc_id, are repeats of each other; overlapping repeats in one text count; columns
other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bytes_of, row_key, written

LENGTH, GRAM, STEP = 200, 64, 16
#: Bytes that are worked on at once, and so the reach of a position within its word of PLACE bits.
CHUNK, PLACE = 1 << 20, np.uint64((1 << 24) - 1)
_RANDOM = np.random.default_rng(20_240_531)
_TABLES = [_RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, n: int, inverse: bool) -> np.ndarray:
    """base ** i modulo 2 ** 64, or its inverse, for i below n."""
    key = (which, inverse)
    if key not in _POWERS or len(_POWERS[key]) < n:
        base = pow(_BASES[which], -1 if inverse else 1, 1 << 64)
        _POWERS[key] = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, CHUNK + LENGTH + 1), base, np.uint64)))
    return _POWERS[key][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretches of some bytes."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * _powers(which, n, False), out=self.sums[1:])
        self.inverse = _powers(which, n + 1, True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        return _mixed((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width neighbours, from running minima of blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    full[:n] = values
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """For bytes of texts that start at cut[:-1]: first window, number of windows, anchor's hash, its place and content of each run."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = Hashes(data, 0)
    grams = hashes.every(GRAM)
    at = sliding_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1) & PLACE
    at = at.astype(np.int64)
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    whole = owner[: n - LENGTH + 1] == owner[LENGTH - 1 :]
    new = np.append(True, (at[1:] != at[:-1]) | (owner[1 : n - LENGTH + 1] != owner[: n - LENGTH])) & whole
    start = np.flatnonzero(new)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    last = np.append(start[1:], n - LENGTH + 1) - 1
    last = np.minimum(last, cut[owner[start] + 1] - LENGTH)
    return start, last - start + 1, grams[at[start]], at[start], hashes.of(start, last + LENGTH)


def _chunks(at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, offset in it, cut) of groups of whole texts up to CHUNK bytes; a longer text comes in overlapping parts."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        if at[j] - at[i] <= CHUNK:
            yield i, 0, at[i : j + 1]
        else:
            for a in range(int(at[i]), int(at[i + 1]) - LENGTH + 1, CHUNK - LENGTH + 1):
                yield i, a - int(at[i]), np.array([a, min(a + CHUNK, int(at[i + 1]))])
        i = j


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = bytes_of(batch.column("text"))
        ids, keys = batch.column("doc_id"), batch.column("key")
        for first, offset, cut in _chunks(at):
            start, count, anchor, _, content = runs(data[cut[0] : cut[-1]], cut - cut[0])
            if not len(start):
                continue
            text = np.searchsorted(cut - cut[0], start, "right") - 1
            row = pa.array(first + text)
            place = start - (cut - cut[0])[text] + offset
            yield pa.RecordBatch.from_arrays([ids.take(row), keys.take(row), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (anchor, content))], names=["doc_id", "key", "start", "windows", "anchor", "content"])


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers for each i, end to end."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _listed(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each struct in a column of lists, and the structs' fields."""
    flat = column.flatten()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def _slices(count: np.ndarray) -> Iterator[slice]:
    """Neighbours whose counts add up to about CHUNK bytes."""
    part = (np.cumsum(count) - 1) // CHUNK
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, b in zip(at, [*at[1:], len(part)]):
        yield slice(int(a), int(b))


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed runs."""
    for batch in batches:
        data, at = bytes_of(batch.column("text"))
        row, run = _listed(batch.column("runs"))
        size = run["windows"].astype(np.int64) + LENGTH - 1
        for part in _slices(size):
            raw = data[_ragged(at[row[part]] + run["start"][part], size[part])]
            offsets = np.append(0, np.cumsum(size[part])).astype(np.int32)
            piece = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            where = pa.array(row[part])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("key").take(where), pa.array(run["start"][part]), pa.array(run["alone"][part]), piece], names=["doc_id", "key", "run", "alone", "piece"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a run's windows: those at distances STEP * block and up to STEP - 1 more from the anchor."""
    for batch in batches:
        data, at = bytes_of(batch.column("piece"))
        begin = batch.column("run").to_numpy()
        for rows in _slices(np.diff(at)):
            cut = at[rows.start : rows.stop + 1] - at[rows.start]
            raw = data[at[rows.start] : at[rows.stop]]
            start, count, _, anchor, _ = runs(raw, cut)
            piece = np.searchsorted(cut, start, "right") - 1
            far, near = anchor - start, anchor - start - count + 1
            blocks = far // STEP - near // STEP + 1
            of = np.repeat(np.arange(len(start)), blocks)
            block = _ragged(near // STEP, blocks)
            high, low = np.minimum(far[of], STEP * block + STEP - 1), np.maximum(near[of], STEP * block)
            hashes = Hashes(raw, 0)
            middle = anchor[of] - STEP * block
            core = _mixed(hashes.of(middle, middle + LENGTH - STEP + 1) + block.astype(np.uint64))
            first = anchor[of] - high
            content = hashes.of(first, anchor[of] - low + LENGTH)
            row = piece[of] + rows.start
            where = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("key").take(where), batch.column("run").take(where), pa.array((first - cut[piece[of]] + begin[row]).astype(np.int32)), pa.array((high - low + 1).astype(np.int32)), batch.column("alone").take(where), pa.array(core.view(np.int64)), pa.array(content.view(np.int64))], names=["doc_id", "key", "run", "start", "windows", "alone", "core", "content"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the listed blocks."""
    for batch in batches:
        data, at = bytes_of(batch.column("piece"))
        begin = batch.column("run").to_numpy()
        row, block = _listed(batch.column("blocks"))
        size = block["windows"].astype(np.int64) + LENGTH - 1
        for part in _slices(size):
            own, count = row[part], block["windows"][part].astype(np.int64)
            raw = data[_ragged(at[own] + block["start"][part] - begin[own], size[part])]
            place = _ragged(np.cumsum(size[part]) - size[part], count)
            where = pa.array(np.repeat(own, count))
            start = _ragged(block["start"][part].astype(np.int64), count).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("key").take(where), pa.array(start), pa.array(np.repeat(block["alone"][part], count)), *(pa.array(Hashes(raw, k).of(place, place + LENGTH).view(np.int64)) for k in (0, 1))], names=["doc_id", "key", "start", "alone", "one", "two"])


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    order = np.argsort(start, kind="stable")
    start, reached = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] > reached[:-1]))
    return start[first], reached[np.append(first[1:], len(start)) - 1]


def _contents(rows: DataFrame, digit: str, run: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """By digit and content: how many rows and one of them; the second is those whose digit has several contents."""
    contents = written(rows.groupBy(digit, "content").agg(F.count("*").alias("n"), F.min(F.struct(*run)).alias("run")))
    several = written(contents.groupBy(digit).agg(F.count("*").alias("kinds")).where("kinds > 1").select(digit))
    return contents.where("n > 1").select(digit, "content"), contents.join(several, digit).select("n", "run.*")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, key, spans) of the rows with windows that recur; documents with (doc_id, key, text)."""
    ids = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, key long"
    span = ("doc_id", "key", "start", "windows")
    found = documents.where(F.octet_length("text") >= LENGTH).mapInArrow(_run_rows, f"{ids}, start int, windows int, anchor long, content long")
    # Anchors that occur once settle nothing. Sums are written before a join, so that Spark can split a frequent key's rows there.
    anchors = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    left = written(found.join(anchors, "anchor"))
    recurring, todo = _contents(left, "anchor", span)
    whole_runs = left.join(recurring, ["anchor", "content"]).select(*span)
    todo = todo.select("doc_id", "key", F.struct("start", "windows", (F.col("n") == 1).alias("alone")).alias("run")).groupBy("doc_id", "key").agg(F.collect_list("run").alias("runs"))
    asked = documents.join(todo.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "text", "runs")
    pieces = written(asked.mapInArrow(_piece_rows, f"{ids}, run int, alone boolean, piece binary"))
    blocks = written(pieces.mapInArrow(_block_rows, f"{ids}, run int, start int, windows int, alone boolean, core long, content long"))
    recurring, todo = _contents(blocks, "core", ("doc_id", "key", "run", "start", "windows", "alone"))
    whole_blocks = blocks.where("alone").join(recurring, ["core", "content"]).select(*span)
    todo = todo.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("run").alias("r"), F.struct("start", "windows", (F.col("alone") & (F.col("n") == 1)).alias("alone")).alias("block")).groupBy("d", "k", "r").agg(F.collect_list("block").alias("blocks"))
    # Identical rows give a piece each, which is right: their windows do recur.
    last = pieces.join(todo, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("run") == F.col("r"))).select("doc_id", "key", "run", "piece", "blocks")
    windows = written(last.mapInArrow(_window_rows, f"{ids}, start int, alone boolean, one long, two long"))
    again = written(windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two"))
    single = windows.where("alone").join(again, ["one", "two"]).select("doc_id", "key", "start", F.lit(1).alias("windows"))
    # Identical rows have equal spans, so a set, whose parts merge before the shuffle, holds no more than one text's.
    return whole_runs.union(whole_blocks).union(single).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))


def drop_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept as bytes, for a cut may fall within a character."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key("doc_id", "text"))
    spans = repeated_spans(rows).withColumnsRenamed({"doc_id": "d", "key": "k"})
    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            out: list[tuple] = []
            owner, spans = _listed(batch.column("spans"))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for row in range(batch.num_rows):
                text, own = data[at[row] : at[row + 1]], slice(cut[row], cut[row + 1])
                if own.start == own.stop:
                    out.append((len(text), 0, 0, text.tobytes()))
                    continue
                start = spans["start"][own].astype(np.int64)
                a, b = _merged(start, start + spans["windows"][own] - 1 + LENGTH)
                kept = b"".join(text[x:y].tobytes() for x, y in zip(np.append(0, b), np.append(a, len(text))))
                out.append((len(text), int((b - a).sum()), len(a), kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(apply, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def drop_repeats_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document."""
    return drop_repeats(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
