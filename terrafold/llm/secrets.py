"""Secrets by patterns and by a battery of randomness tests.

The base patterns always count. Beyond them, every long token is a candidate. Its encoding is inferred
from its characters (hexadecimal, base 32, letters and digits, base 64), and under that alphabet four
tests ask whether it could be uniformly random: chi-squared uniformity over characters and over classes of
characters, runs about the median, serial correlation. Their joint p value (Fisher) is the candidate's score: the higher, the likelier random.

How high is enough depends on the length and on how much is tested. Every text lends decoys: of a stretch of
its own prose names in the characters of each encoding in DECOYS, of one of the lengths BANDS, in turn by its
hash, scored like candidates of that encoding. A candidate's p value under natural text is the share of the decoys
of its encoding and band of lengths that score at least as high; the Benjamini-Hochberg step-up rule over all
candidates that touch no base span keeps the expected share of false ones at most MOST_FALSE. And what the
battery itself refuses as random at RANDOM is never added. The scores of all documents are counted by Spark
into bounded histograms first.

Defined results: null and empty texts have no spans; repeated rows are scanned each; of equal starts the
kinds come in the order of KINDS; a candidate that overlaps a base span is not added; with too few texts to
lend decoys none is added.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
WORDS = ("password", "passwd", "secret", "token", "api")
#: Lower ends of the bands of lengths.
BANDS = (20, 28, 40, 64)
STEP, LOWEST, MOST_FALSE = 0.25, -40.0, 0.05
#: log10 of the joint p value under randomness that a secret must have; of random tokens 999 in 1000 do.
RANDOM = -3.0
#: The alphabets in their standard order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Encodings that decoys are taken in: all that can hold a letter and a digit.
DECOYS = ("hex", "base32", "alnum", "base64")
#: Where each alphabet passes from one class of characters to the next.
_ENDS = {"hex": [10], "base32": [26], "lower": [], "alnum": [26, 52], "base64": [26, 52]}
STRATA = len(BANDS) * len(DECOYS)
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_VALUES = {k: np.array([v.find(chr(c)) for c in range(128)]) for k, v in ALPHABETS.items()}
_OTHERS = {"hex": re.compile("[^0-9a-f]+"), "base32": re.compile("[^A-Z2-7]+"), "alnum": re.compile("[^A-Za-z0-9]+"), "base64": re.compile("[^A-Za-z0-9+/]+")}
_ODD_WORDS = re.compile(r"^\S+|\S+$|\S*[0-9]\S*|\S{20,}")
_CLASSES = (re.compile("[0-9]"), re.compile("[A-Za-z]"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding_of(token: str) -> str:
    """The smallest alphabet that holds all its characters; URL-safe base 64 counts as base 64."""
    used = set(token)
    if used <= _SETS["hex"] or used <= set("0123456789ABCDEF"):
        return "hex"
    return next((k for k in ("base32", "lower", "alnum") if used <= _SETS[k]), "base64")


def _upper_normal(z: float) -> float:
    return max(math.erfc(z / math.sqrt(2)) / 2, 1e-300)


def battery(token: str, kind: str | None = None) -> float:
    """log10 of the joint p value of the four tests under uniform randomness; 0 is as random as can be."""
    token = token.rstrip("=")
    kind = kind or encoding_of(token)
    shown = token.lower() if kind == "hex" else token.replace("-", "+").replace("_", "/")
    x = _VALUES[kind][np.frombuffer(shown.encode("ascii"), np.uint8)]
    n, m = len(x), len(ALPHABETS[kind])
    # Uniformity: chi-squared with its exact mean and variance for few characters.
    chi = m / n * float((np.bincount(x, minlength=m) ** 2).sum()) - n
    p_uniform = _upper_normal((chi - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n))
    # Runs above and below the middle of the alphabet.
    up = x >= m / 2
    a, b = int(up.sum()), int(n - up.sum())
    if a and b:
        runs, mean = 1 + int((up[1:] != up[:-1]).sum()), 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = min(1.0, 2 * _upper_normal(abs(runs - mean) / spread))
    else:
        p_runs = max(2.0 ** (1 - n), 1e-300)
    # Serial correlation at lag one.
    d = x - x.mean()
    power = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / power if power else 1.0
    p_serial = min(1.0, 2 * _upper_normal(abs(r + 1 / n) * math.sqrt(n)))
    # Uniformity over capitals, small letters and the rest, or over letters and digits.
    ends = _ENDS[kind]
    shares = np.diff([0, *ends, m]) / m
    coarse = float(((np.bincount(np.searchsorted(ends, x, "right"), minlength=len(shares)) / n - shares) ** 2 / shares).sum()) * n
    p_class = 1.0 if not ends else math.exp(-coarse / 2) if len(ends) == 2 else math.erfc(math.sqrt(coarse / 2))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_class, p_runs, p_serial))
    return (-half + math.log(1 + half + half**2 / 2 + half**3 / 6)) / math.log(10)  # upper tail of chi-squared with eight degrees


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if all(c.search(m[0]) for c in _CLASSES)]


def decoys(text: str) -> Iterator[tuple[str, str]]:
    """Names made of a text's prose in the characters of each encoding, with the encoding; none from a text too short for it."""
    h = zlib.crc32(text.encode())
    low = BANDS[h % len(BANDS)]
    n = low + h // 64 % low // 2
    at = h // 4096 % max(1, len(text) - 12 * n)
    # Whole words without digits: what might be a secret itself lends nothing.
    part = _ODD_WORDS.sub("", text[at : at + 12 * n])
    words, number = part.split(), str(h % 10_000)
    # As names are written: words joined by hyphens or by capitals, with a number.
    seen = {"hex": part.lower(), "base32": part.upper() + number, "alnum": number + "".join(map(str.title, words)), "base64": number + "/" + "+".join(words)}
    for kind in DECOYS:
        letters = _OTHERS[kind].sub("", seen[kind])
        if len(letters) >= n:
            yield letters[:n], kind


def stratum(length: int, kind: str) -> int:
    """Of the band of lengths and the encoding."""
    return max(i for i, low in enumerate(BANDS) if length >= low) * len(DECOYS) + DECOYS.index(kind)


def _bin(score: float) -> int:
    return int(max(score, LOWEST) / STEP)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            text = text.as_py() or ""
            for other, kind in decoys(text):
                counts[stratum(len(other), kind), _bin(battery(other, kind)), 1] += 1
            if found := candidates(text):
                base = base_spans(text)
                for a, b in found:
                    if all(b <= s or e <= a for s, e, _ in base):
                        token = text[a:b].rstrip("=")
                        counts[stratum(len(token), encoding_of(token)), _bin(battery(token)), 0] += 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([counts[k] for k in keys], pa.int64())], names=["stratum", "bin", "decoy", "n"])


def cuts_of(counts: dict[tuple[int, int, int], int], most_false: float = MOST_FALSE) -> list[int]:
    """For each stratum the lowest bin of scores that is still enough; 1 if none is. counts by (stratum, bin, whether decoys)."""
    lent = Counter()
    for (k, _, is_decoy), n in counts.items():
        lent[k] += n * is_decoy
    p_values: dict[tuple[int, int], float] = {}
    for k in range(STRATA):
        above = 0
        for x in range(0, int(LOWEST / STEP) - 1, -1):
            above += counts.get((k, x, 1), 0)
            p_values[k, x] = (1 + above) / (1 + lent[k])
    # Step up: the largest p value up to which the share expected to be false is small enough.
    tested = sorted((p_values[k, x], n) for (k, x, is_decoy), n in counts.items() if not is_decoy)
    total, rank, largest = sum(n for _, n in tested), 0, 0.0
    for i, (p, n) in enumerate(tested):
        rank += n
        if (i + 1 == len(tested) or tested[i + 1][0] > p) and p <= most_false * rank / total:
            largest = p
    return [min((x for x in range(int(RANDOM / STEP), 1) if p_values[k, x] <= largest), default=1) for k in range(STRATA)]


def fit_cuts(documents: DataFrame) -> list[int]:
    """The cuts for all documents; what comes to the driver is at most a row for each stratum, bin and sort."""
    counts = documents.select("text").mapInArrow(_histogram, "stratum int, bin int, decoy int, n long").groupBy("stratum", "bin", "decoy").agg(F.sum("n")).collect()
    return cuts_of({(r[0], r[1], r[2]): r[3] for r in counts})


def spans_of(text: str, cuts: list[int]) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    out = list(base)
    for a, b in candidates(text):
        if all(b <= s or e <= a for s, e, _ in base):
            token = text[a:b].rstrip("=")
            if _bin(battery(token)) >= cuts[stratum(len(token), encoding_of(token))]:
                out.append((a, b, "random"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each group of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(documents: DataFrame, cuts: list[int], spans_column: str = "secret_spans", redacted_column: str | None = None) -> DataFrame:
    """documents with each text's spans and, if named, the text with its secrets replaced; a null text stays null."""
    names = documents.columns
    new = [spans_column, *([redacted_column] if redacted_column else [])]
    if clash := {x.lower() for x in names} & {x.lower() for x in new}:
        raise ValueError(f"columns exist: {', '.join(sorted(clash))}")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, clean = [], []
            for text in batch.column("text"):
                text = text.as_py()
                spans = spans_of(text or "", cuts)
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                if redacted_column:
                    clean.append(text if not spans else redact(text, spans))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow), *([pa.array(clean, pa.string())] if redacted_column else [])], names=[*names, *new])

    fields = [T.StructField(spans_column, SPAN), *([T.StructField(redacted_column, T.StringType())] if redacted_column else [])]
    return documents.mapInArrow(apply, T.StructType([*documents.schema.fields, *fields]))


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans for each document."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = scan(rows, fit_cuts(rows)).select("doc_id", "secret_spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("secret_spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
