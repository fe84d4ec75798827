"""Byte-level BPE as a monoid: a text's encoding is reduced from the encodings of its halves.

A piece (one match of the split pattern) is halved down to a few bytes. Two neighbouring encodings are
joined by encoding the bytes around the seam anew, in a window that grows by a token to the left or
right until both of its edges are stable: the token outside and the first token inside encode, together,
to just these two. Merges of such a pair never cross its seam, so all tokens outside stay as they are.
Pieces then only need to be concatenated, and so do the bytes of ids when decoding.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are encoded
each; other columns stay as they are, and the new ones take the names given.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF_BYTES, REMEMBERED_BYTES = 3, 8
#: Pieces and pairs that a task remembers at once, about 80 MB; beyond that it forgets them and goes on.
REMEMBERED = 250_000
#: Ids, give or take a text, that leave a task in one batch.
HELD_IDS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    """Encodes and decodes with the ranks of a vocabulary and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.texts: dict[str, tuple[str, bytes]] = {}
        self.words: dict[bytes, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The rule itself, for short windows: merge the pair of lowest rank, leftmost first."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(ranks[p] for p in parts)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two tokens' bytes; (a, b) itself if the seam between them is stable."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.token[a] + self.token[b])
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's operation."""
        if not left or not right:
            return left or right
        seam = self.pair(left[-1], right[0])
        if seam == (left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            grown = False
            if i and self.pair(left[i - 1], seam[0]) != (left[i - 1], seam[0]):
                i, grown = i - 1, True
            if j < len(right) and self.pair(seam[-1], right[j]) != (seam[-1], right[j]):
                j, grown = j + 1, True
            if not grown:
                return left[:i] + seam + right[j:]
            seam = self.window(b"".join(self.token[t] for t in left[i:] + right[:j]))

    def window(self, data: bytes) -> tuple[int, ...]:
        """A window of a few tokens by the rule itself; a longer one again by halves."""
        return self.merged(data) if len(data) <= 64 else self.reduced(data)

    def reduced(self, data: bytes) -> tuple[int, ...]:
        """By halves; short ones are remembered."""
        n = len(data)
        if n > REMEMBERED_BYTES:
            return self.join(self.reduced(data[: n // 2]), self.reduced(data[n // 2 :]))
        if (found := self.halves.get(data)) is None:
            if len(self.halves) > REMEMBERED:
                self.halves.clear()
            found = self.halves[data] = self.merged(data) if n <= LEAF_BYTES else self.join(self.reduced(data[: n // 2]), self.reduced(data[n // 2 :]))
        return found

    def piece(self, data: bytes) -> tuple[int, ...]:
        """One match of the pattern; a whole token is its own encoding."""
        return (self.ranks[data],) if data in self.ranks else self.reduced(data)

    def decoded(self, ids) -> bytes:
        """Up the tree the bytes of neighbours are only concatenated."""
        return b"".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.piece(piece.encode())]

    def remembered(self, piece: str) -> tuple[str, bytes]:
        """A piece's ids, as text, and the bytes that these ids decode to."""
        if len(self.texts) > REMEMBERED:
            self.texts.clear()
        ids = self.piece(piece.encode())
        found = ",".join(map(str, ids)), self.decoded(ids)
        if len(piece) <= 64:
            self.texts[piece] = found
        return found

    def ids_and_bytes(self, text: str) -> tuple[str, bytes]:
        """A text's ids joined by commas, and the bytes that they decode to."""
        get, miss = self.texts.get, self.remembered
        found = [get(p) or miss(p) for p in self.pattern.findall(text)]
        return ",".join([x[0] for x in found]), b"".join([x[1] for x in found])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(key: tuple, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One for each vocabulary in a Python worker, used again by its later tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode(documents: DataFrame, vocabulary: str, pattern: str, text_column: str = "text", ids_column: str | None = "ids", count_column: str | None = "n_tokens", digest_column: str | None = None, decoded_digest_column: str | None = None) -> DataFrame:
    """documents with, for each text, the columns that have a name: ids, their number, SHA-256 of ids and of decoded bytes.

    vocabulary: a rank file on the driver; a vocabulary's size is bounded, so tasks get it by broadcast.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((read_ranks(vocabulary), pattern))
    kinds = {ids_column: T.ArrayType(T.IntegerType()), count_column: T.LongType(), digest_column: T.StringType(), decoded_digest_column: T.StringType()}
    kinds.pop(None, None)
    if clash := [c for c in kinds if c.lower() in {x.lower() for x in documents.columns}]:
        raise ValueError(f"columns exist: {', '.join(clash)}")
    names, key = documents.columns, (vocabulary, pattern)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, *shared.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        arrow = {T.ArrayType: pa.list_(pa.int32()), T.LongType: pa.int64(), T.StringType: pa.string()}
        for batch in batches:
            start, held, out = 0, 0, {c: [] for c in kinds}
            for row, text in enumerate(batch.column(text_column), 1):
                ids, decoded = encoder.ids_and_bytes(text.as_py() or "")
                n = ids.count(",") + 1 if ids else 0
                if ids_column:
                    out[ids_column].append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
                if count_column:
                    out[count_column].append(n)
                if digest_column:
                    out[digest_column].append(sha(ids.encode()))
                if decoded_digest_column:
                    out[decoded_digest_column].append(sha(decoded))
                held += n
                if held >= HELD_IDS or row == batch.num_rows:
                    done = batch.slice(start, row - start)
                    yield pa.RecordBatch.from_arrays([*done.columns, *(pa.array(v, arrow[type(kinds[c])]) for c, v in out.items())], names=[*names, *out])
                    start, held, out = row, 0, {c: [] for c in kinds}

    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, k) for c, k in kinds.items())])
    return documents.mapInArrow(apply, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """encoded with the bytes that each row's ids stand for; null ids give null, an unknown id fails the job."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(vocabulary).items()})
    names = encoded.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if ids is None else b"".join(map(token, ids)) for ids in batch.column(ids_column).to_pylist()], pa.binary())], names=[*names, bytes_column])

    return encoded.mapInArrow(apply, T.StructType([*encoded.schema.fields, T.StructField(bytes_column, T.BinaryType())]))


def encode_digests(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(rows, vocabulary, pattern, ids_column=None, digest_column="ids_sha256", decoded_digest_column="decoded_sha256").drop("text")
