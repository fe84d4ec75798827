"""SentencePiece BPE by a table of prefixes, and decoding.

A merge-type encoding of a prefix has one last token, whatever follows the prefix later. An automaton of all
pieces tells which of them end at each place of a text; of these the one is the prefix's last token that can
stand after the last token of what is before it, that is, the two tokens' characters encode to just these two.
Once the table is filled, ids are recovered backwards from its end. No heap of merges is kept, and time grows
with the length of the text.

No piece of a model goes on with a word mark after another character, and none holds a character outside its
alphabet, so a text is cut at such places first; what is short is remembered by each worker. A character that
no piece holds becomes the pieces of its bytes.

Only models that merge by score, spell unknown characters by bytes and leave characters as they are can be
read; others are refused. Where scores tie, the leftmost pair merges first.

Defined results: null and empty texts have no ids but the begin and end asked for and decode to an empty text;
repeated rows are encoded each; other columns stay as they are, and a new one that has the name of an old one
is an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mark that stands for a space, and the kinds of pieces in a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units and pairs that a task remembers at once, about 100 MB; beyond that it forgets them and goes on.
REMEMBERED, REMEMBERED_CHARACTERS = 250_000, 64
#: Ids, give or take a text, that leave a task in one batch.
HELD_IDS = 1 << 19
#: In the table: a character that no piece holds.
NO_PIECE = -1
#: More than any id; units of more characters keep their table in four bytes each.
FAR, LONG = 1 << 32, 1 << 16


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of the fields of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value, shift = 0, 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = number(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> Model:
    """A model file on the driver; what this operator cannot encode exactly is refused."""
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    with open(path, "rb") as file:
        for field, value in _fields(file.read()):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
    if trainer.get(3, 1) != 2:
        raise ValueError("the model does not merge pairs")
    if BYTE not in kinds or USER_DEFINED in kinds or UNUSED in kinds:
        raise ValueError("the model has no bytes for unknown characters, or pieces of its user")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
        raise ValueError("the model changes characters or leaves spaces out")
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, kind in zip(pieces, kinds) if kind == NORMAL):
        raise ValueError("a piece goes on after the end of a word")
    return Model(pieces, scores, kinds, bool(normalizer.get(3, 1)))


class Pieces:
    """Encodes and decodes with one model."""

    def __init__(self, model: Model):
        self.model = model
        normal = [i for i, kind in enumerate(model.kinds) if kind == NORMAL]
        self.text = list(model.pieces)
        self.score = {model.pieces[i]: model.scores[i] for i in normal}
        ids = {model.pieces[i]: i for i in normal}
        self.bytes = [0] * 256
        for i, kind in enumerate(model.kinds):
            if kind == BYTE:
                self.bytes[int(model.pieces[i][1:-1], 16)] = i
        self.begin, self.end = (next(i for i, p in enumerate(model.pieces) if p == name and model.kinds[i] == CONTROL) for name in ("<s>", "</s>"))
        # A character that only longer pieces hold has a place in the table, and its bytes in the result.
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            ids[c] = len(self.text)
            self.text.append(c)
        self.ids = ids
        self.automaton = ahocorasick.Automaton()
        for piece, i in ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        alone = re.escape("".join(c for c in "\n\t\r" if c not in ids))
        self.units = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]+" if alone else "")).findall
        self.size = [len(t) for t in self.text]
        #: Of each id its four bytes, and the bytes of text that it stands for.
        self.four = [struct.pack("<I", i) for i in range(len(model.pieces))]
        self.surface = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, kind in zip(model.pieces, model.kinds)]
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """The rule itself, for the characters of two tokens: the pair whose piece scores best merges, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            told = [score.get(a + b) for a, b in pairwise(parts)]
            if not (known := [x for x in told if x is not None]):
                break
            best = told.index(max(known))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether the characters of two tokens encode to just these two; after no piece, whether the token's own encode to it."""
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        whole = [self.text[token]] if before == NO_PIECE else [self.text[before], self.text[token]]
        found = self.fits[before * FAR + token] = self.merged("".join(whole)) == whole
        return found

    def last_tokens(self, unit: str) -> list[int] | array:
        """For each length of a prefix of unit, the last token of its encoding."""
        none, get, done = [NO_PIECE], self.fits.get, -1
        last = (none if len(unit) <= LONG else array("i", none)) * (len(unit) + 1)
        for at, (token, size) in self.automaton.iter(unit):
            # Of all that end here one can be the last token; the rest need not be asked.
            if at != done:
                before = last[at + 1 - size]
                fits = get(before * FAR + token)
                if self.follows(before, token) if fits is None else fits:
                    last[at + 1], done = token, at
        return last

    def unit(self, unit: str) -> list[int]:
        """The ids of a unit, recovered from its end."""
        last, at, out = self.last_tokens(unit), len(unit), []
        while at:
            token = last[at]
            size = 1 if token == NO_PIECE else self.size[token]
            if 0 <= token < len(self.four):
                out.append(token)
            else:
                out.extend(self.bytes[b] for b in reversed(unit[at - size : at].encode()))
            at -= size
        return out[::-1]

    def marked(self, text: str) -> str:
        return (MARK if self.model.dummy_prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> list[int]:
        """Without begin and end."""
        return [i for unit in self.units(self.marked(text)) for i in self.unit(unit)]

    def decode(self, ids) -> str:
        """The text of ids: marks become spaces but the first one, runs of bytes characters, each byte that is part of none U+FFFD."""
        kinds, out, run = self.model.kinds, [], bytearray()
        start = self.model.dummy_prefix
        for i in ids:
            kind = kinds[i]
            if kind == BYTE:
                run.append(int(self.text[i][1:-1], 16))
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
                start = False
            if kind == CONTROL:
                continue
            text = " ⁇ " if kind == UNKNOWN else self.text[i]
            if start and text.startswith(MARK):
                text = text[1:]
            start = False
            out.append(text.replace(MARK, " "))
        return "".join(out) + _characters(bytes(run))

    def remembered(self, unit: str) -> tuple[bytes, bytes]:
        """A unit's ids, four bytes each, and the bytes of the text that they stand for, spaces included."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = self.unit(unit)
        found = b"".join(map(self.four.__getitem__, ids)), b"".join(map(self.surface.__getitem__, ids))
        if len(unit) <= REMEMBERED_CHARACTERS:
            self.known[unit] = found
        return found

    def ids_and_text(self, text: str) -> tuple[bytes, bytes]:
        """A text's ids, four bytes each, without begin and end, and the UTF-8 of what they decode to."""
        get, miss = self.known.get, self.remembered
        found = [get(u) or miss(u) for u in self.units(self.marked(text))]
        decoded = b"".join([x[1] for x in found])
        return b"".join([x[0] for x in found]), decoded[1:] if self.model.dummy_prefix and decoded[:1] == b" " else decoded


def _characters(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as wrong:
        return data[: wrong.start].decode() + "�" + _characters(data[wrong.start + 1 :])


_ENCODERS: dict[str, Pieces] = {}


def pieces_of(key: str, model: Model) -> Pieces:
    """One for each model in a Python worker, used again by its later tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Pieces(model)
    return _ENCODERS[key]


def encode(documents: DataFrame, model: str, text_column: str = "text", ids_column: str | None = "ids", count_column: str | None = "n_tokens", digest_column: str | None = None, decoded_digest_column: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """documents with, for each text, the columns that have a name: ids, their number, SHA-256 of the ids as 32-bit numbers and of the decoded text.

    model: a model file on the driver; its size is bounded by its vocabulary, so tasks get it by broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_model(model))
    kinds = {ids_column: T.ArrayType(T.IntegerType()), count_column: T.LongType(), digest_column: T.StringType(), decoded_digest_column: T.StringType()}
    kinds.pop(None, None)
    if clash := [c for c in kinds if c.lower() in {x.lower() for x in documents.columns}]:
        raise ValueError(f"columns exist: {', '.join(clash)}")
    names = documents.columns
    arrow = {T.ArrayType: pa.list_(pa.int32()), T.LongType: pa.int64(), T.StringType: pa.string()}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces_of(model, shared.value)
        first, last = (np.array([i] * on, "<u4").tobytes() for i, on in ((encoder.begin, begin), (encoder.end, end)))
        for batch in batches:
            start, held, out = 0, 0, {c: [] for c in kinds}
            for row, text in enumerate(batch.column(text_column), 1):
                ids, decoded = encoder.ids_and_text(text.as_py() or "")
                ids = first + ids + last
                if ids_column:
                    out[ids_column].append(np.frombuffer(ids, "<u4").astype(np.int32))
                if count_column:
                    out[count_column].append(len(ids) // 4)
                if digest_column:
                    out[digest_column].append(hashlib.sha256(ids).hexdigest())
                if decoded_digest_column:
                    out[decoded_digest_column].append(hashlib.sha256(decoded).hexdigest())
                held += len(ids) // 4
                if held >= HELD_IDS or row == batch.num_rows:
                    done = batch.slice(start, row - start)
                    yield pa.RecordBatch.from_arrays([*done.columns, *(pa.array(v, arrow[type(kinds[c])]) for c, v in out.items())], names=[*names, *out])
                    start, held, out = row, 0, {c: [] for c in kinds}

    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, k) for c, k in kinds.items())])
    return documents.mapInArrow(apply, schema)


def decode(encoded: DataFrame, model: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """encoded with the text that each row's ids stand for; null ids give null, an unknown id fails the job."""
    if text_column.lower() in {c.lower() for c in encoded.columns}:
        raise ValueError(f"column exists: {text_column}")
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model))
    names = encoded.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = pieces_of(model, shared.value)
        for batch in batches:
            texts = [None if ids is None else decoder.decode(ids) for ids in batch.column(ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text_column])

    return encoded.mapInArrow(apply, T.StructType([*encoded.schema.fields, T.StructField(text_column, T.StringType())]))


def encode_digests(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(rows, model, ids_column=None, digest_column="ids_sha256", decoded_digest_column="decoded_sha256").drop("text")
