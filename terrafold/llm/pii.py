"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base spans come from four patterns with their checks and always count. Loose generators propose further,
overlapping spans: long runs of digits and number punctuation, and anything around an ``@``. Each candidate
gets small integer features of its format and context; what the base patterns ask for (a plus sign, a
checksum, parts up to 255) is not among them. Spark counts the candidates, and those that a base span covers,
for each combination of features: a table whose size the features bound, whatever the corpus. Boosted trees
of depth two are fitted on it to tell covered candidates from the rest, on half of the documents; on the
other half a threshold is calibrated at which the lower confidence bound of precision is at least PRECISION.
The trees become CASE expressions. Candidates that reach the threshold and touch no base span are added: they
look and stand like personal data but miss what a pattern asks for.

Patterns never repeat a group without limit, so a match of any length needs no deep stack: before e-mail
addresses are matched, each dot without a label after it is replaced, one character for one, and before
card numbers each separator that is not between two digits. Matches are put together CHUNK at a time, and
compared with base spans near them alone, so that a text of very many spans takes about linear time.

Defined results: null and empty texts have no spans; repeated rows are searched each; offsets count code
points; with no covered candidates nothing is added; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import checkpointed

BASE_KINDS, MORE_KINDS = ("email", "ip", "card", "phone"), ("number", "address")
PRECISION, ROUNDS, RATE = 0.9, 20, 0.3
CONTEXT = 24
#: Matches that are put together at once, an even number; candidates that share a look-up of base spans.
CHUNK, LOOK_UP = 64, 4096
#: How many values each feature has, from 0 up.
SIZES = {"source": 2, "digits": 8, "dots": 2, "separators": 4, "brackets": 2, "context": 5, "before": 3, "after": 3}
MARK, OTHER, HIDDEN = "\\u0003", "\\u0002", "\\u0001"
LOCAL = "A-Za-z0-9._%+-"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _parts(text: str, pattern: str) -> str:
    """text cut at matches: every second part is one."""
    return f"split(regexp_replace({text}, {_raw(pattern)}, '{MARK}$0{MARK}'), '{MARK}')"


def _let(value: str, name: str, body: str) -> str:
    """body with a name for value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _matched(parts: str, fields: str, kind: str, valid: str, guard: str) -> Column:
    """A struct of kind and fields for each valid match. In fields and valid: m the match, a.at its offset, x its place in parts p."""
    chunks = f"sequence(0, (size(p) - 1) div {CHUNK})"
    totals = f"transform({chunks}, c -> aggregate(slice(p, c * {CHUNK} + 1, {CHUNK}), 0L, (s, y) -> s + char_length(y)))"
    starts = "aggregate(t, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (s, y) -> named_struct('at', s.at + y, 'out', array_append(s.out, s.at)), s -> s.out)"
    one = f"""aggregate(slice(p, c * {CHUNK} + 1, {CHUNK}), named_struct('at', b[c], 'x', c * {CHUNK}, 'spans', cast(array() as array<{kind}>)),
        (a, m) -> named_struct('at', a.at + char_length(m), 'x', a.x + 1, 'spans', if(a.x % 2 = 1 and ({valid}), array_append(a.spans, named_struct({fields})), a.spans)), a -> a.spans)"""
    whole = _let(parts, "p", _let(totals, "t", _let(starts, "b", f"flatten(transform({chunks}, c -> {one}))")))
    return F.expr(f"if({guard}, {whole}, cast(array() as array<{kind}>))")


SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _spans(parts: str, kind: str, valid: str, guard: str) -> Column:
    """Valid matches with code-point offsets. valid: of the match m."""
    return _matched(parts, f"'kind', '{kind}', 'start', a.at, 'end', a.at + char_length(m)", SPAN, valid.replace("$m", "m"), guard)


def base_spans(text: str = "_text") -> Column:
    """Of a column without the characters MARK and HIDDEN: (kind, start, end) by kind as listed, then start."""
    digits = "regexp_replace($m, '[^0-9]', '')"
    dotted = f"regexp_replace({text}, {_raw('[.](?![A-Za-z0-9-])')}, '{HIDDEN}')"
    joined = f"regexp_replace({text}, {_raw('(?<![0-9])[ -]|[ -](?![0-9])')}, '{HIDDEN}')"
    local = f"{LOCAL[:-1]}\\x01-"
    return F.concat(
        _spans(_parts(dotted, rf"(?:\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++[.][A-Za-z0-9.-]++"), "email", "true", f"contains({text}, '@')"),
        _spans(_parts(text, r"(?<![0-9])[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++"), "ip", f"$m rlike {_raw(f'^{OCTET}[.]{OCTET}[.]{OCTET}[.]{OCTET}$')}", f"{text} rlike {_raw('[0-9][.][0-9]')}"),
        _spans(_parts(joined, r"(?<![0-9 -])[0-9 -]{13,}"), "card", f"length({digits}) between 13 and 19 and luhn_check({digits})", f"{text} rlike {_raw('[0-9](?:[ -]?[0-9]){12}')}"),
        _spans(_parts(text, r"[+][0-9][ ().0-9-]+[0-9]"), "phone", f"length({digits}) between 9 and 15", f"contains({text}, '+')"),
    )


def _candidates(text: str, pattern: str, kind: str, source: int, guard: str) -> Column:
    count = lambda what: f"length(regexp_replace(m, '[^{what}]', ''))"
    # The parts before and after a match are never missing.
    digits, before, after = count("0-9"), f"lower(right(p[a.x - 1], {CONTEXT}))", "p[a.x + 1]"
    features = {
        "source": str(source),
        "digits": f"case when {digits} < 9 then 0 when {digits} = 9 then 1 when {digits} < 12 then 2 when {digits} = 12 then 3 when {digits} < 16 then 4 when {digits} = 16 then 5 when {digits} < 20 then 6 else 7 end",
        "dots": f"if({count('.')} = 0, 0, 1)",
        "separators": "if(m rlike ' ', 1, 0) + if(m rlike '-', 2, 0)",
        "brackets": "if(m rlike '[()]', 1, 0)",
        "context": f"case when {before} rlike 'tel|phone|call|mobile|fax|contact|mail' then 1 when {before} rlike 'card|visa|iban|account|payment' then 2 when {before} rlike 'ip|addr|host|server' then 3 when {before} rlike 'order|invoice|ref|date|isbn|version|page|#' then 4 else 0 end",
        "before": f"case when {before} = '' then 0 when {before} rlike '[ \n\t]$' then 1 else 2 end",
        "after": f"case when {after} = '' then 0 when {after} rlike '^[.,;)\n]' then 1 else 2 end",
    }
    fields = ", ".join(f"'{k}', cast({v} as int)" for k, v in features.items())
    kind_of = f"struct<kind:string,start:bigint,end:bigint,{','.join(f'{k}:int' for k in features)}>"
    return _matched(_parts(text, pattern), f"'kind', '{kind}', 'start', a.at, 'end', a.at + char_length(m), {fields}", kind_of, "true", guard)


def _with_covered(spans: str, base: str) -> str:
    """spans, in order and apart from each other, as structs of c and whether it overlaps a base span."""
    near = lambda among, low, high: f"filter({among}, s -> s.start < {high} and s.end > {low})"
    each = "transform(k, c -> named_struct('c', c, 'covered', exists(n, s -> s.start < c.end and s.end > c.start)))"
    inner = _let(f"slice(g, i * {CHUNK} + 1, {CHUNK})", "k", _let(near("w", "k[0].start", "element_at(k, -1).end"), "n", each))
    outer = _let(f"slice({spans}, j * {LOOK_UP} + 1, {LOOK_UP})", "g", _let(near(base, "g[0].start", "element_at(g, -1).end"), "w", f"flatten(transform(sequence(0, (size(g) - 1) div {CHUNK}), i -> {inner}))"))
    return f"if(size({spans}) > 0, flatten(transform(sequence(0, (size({spans}) - 1) div {LOOK_UP}), j -> {outer})), array())"


def candidates(text: str = "_text") -> tuple[Column, Column]:
    """Numbers and addresses."""
    return (
        _candidates(text, r"(?<![0-9A-Za-z+(])[+(]?[0-9][0-9 ().-]{7,}[0-9](?![0-9A-Za-z])", "number", 0, f"{text} rlike {_raw('[0-9][0-9 ().-]{7}')}"),
        _candidates(text, r"[^\s@<>,;]{1,64}@[^\s@<>,;]{1,255}", "address", 1, f"contains({text}, '@')"),
    )


Tree = tuple[str, int, tuple[str, int, float, float], tuple[str, int, float, float]]


def boosted(cells: dict[str, np.ndarray], n: np.ndarray, covered: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[Tree]]:
    """Newton-boosted trees of depth two for the log odds of being covered, over counted feature cells."""
    start = math.log((covered.sum() + 0.5) / (n.sum() - covered.sum() + 0.5))
    z, trees = np.full(len(n), start), []

    def value(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, float]:
        a, b = g[rows].sum(), h[rows].sum() + 1
        return a / b, a * a / b

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        whole = value(rows, g, h)
        best = (whole[1], "source", 0, whole[0], whole[0])
        for name, x in cells.items():
            for cut in range(SIZES[name] - 1):
                low, high = value(rows & (x <= cut), g, h), value(rows & (x > cut), g, h)
                if low[1] + high[1] > best[0] + 1e-9:
                    best = (low[1] + high[1], name, cut, low[0], high[0])
        return best

    everything = np.ones(len(n), bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = covered - n * p, n * p * (1 - p)
        best = None
        for name, x in cells.items():
            for cut in range(SIZES[name] - 1):
                low, high = split(everything & (x <= cut), g, h), split(everything & (x > cut), g, h)
                if best is None or low[0] + high[0] > best[0] + 1e-9:
                    best = (low[0] + high[0], name, cut, low[1:], high[1:])
        _, name, cut, low, high = best
        tree = (name, cut, *((f, c, float(np.clip(a, -4, 4)) * rate, float(np.clip(b, -4, 4)) * rate) for f, c, a, b in (low, high)))
        trees.append(tree)
        z = z + applied(tree, cells)
    return start, trees


def applied(tree: Tree, cells: dict[str, np.ndarray]) -> np.ndarray:
    name, cut, low, high = tree
    leaf = lambda t: np.where(cells[t[0]] <= t[1], t[2], t[3])
    return np.where(cells[name] <= cut, leaf(low), leaf(high))


def threshold(z: np.ndarray, n: np.ndarray, covered: np.ndarray, precision: float = PRECISION) -> float | None:
    """The smallest score from which on the lower bound of precision holds; Wilson's, at about 95 %."""
    best = None
    for cut in sorted(set(z.tolist()), reverse=True):
        total, hit = n[z >= cut].sum(), covered[z >= cut].sum()
        if not total:
            continue
        share, w = hit / total, 1.645**2 / total
        low = (share + w / 2 - math.sqrt(w * (share * (1 - share) + w / 4))) / (1 + w)
        if low >= precision:
            best = cut
    return best


def _score(start: float, trees: Sequence[Tree], c: str) -> str:
    leaf = lambda t: f"if({c}.{t[0]} <= {t[1]}, {t[2]!r}D, {t[3]!r}D)"
    return " + ".join([f"{start!r}D", *(f"if({c}.{n} <= {cut}, {leaf(a)}, {leaf(b)})" for n, cut, a, b in trees)])


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) for each document."""
    clean = F.translate(F.coalesce("text", F.lit("")), "\x01\x03", "\x02\x02")
    numbers, addresses = candidates()
    rows = documents.select("doc_id", clean.alias("_text")).select("doc_id", base_spans().alias("base"), numbers.alias("_numbers"), addresses.alias("_addresses"))
    rows = rows.select("doc_id", "base", *(F.expr(_with_covered(x, "base")).alias(x) for x in ("_numbers", "_addresses")))
    rows = checkpointed(rows.select("doc_id", "base", F.concat("_numbers", "_addresses").alias("candidates")))  # spans only, no texts
    half = (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 2).alias("half")
    told = F.transform("candidates", lambda x: F.struct(*(x["c"][f].alias(f) for f in SIZES), x["covered"].alias("covered")))
    each = rows.select(half, F.explode(told).alias("x")).select("half", "x.*")
    # At most a row for each combination of features.
    counted = each.groupBy(*SIZES).agg(*(F.count_if(F.col("half") == h).alias(f"n{h}") for h in (0, 1)), *(F.count_if((F.col("half") == h) & F.col("covered")).alias(f"c{h}") for h in (0, 1))).collect()
    added = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    if counted:
        cells = {f: np.array([r[f] for r in counted]) for f in SIZES}
        n0, n1, c0, c1 = (np.array([r[k] for r in counted], float) for k in ("n0", "n1", "c0", "c1"))
        start, trees = boosted(cells, n0, c0)
        z = start + sum(applied(t, cells) for t in trees)
        cut = threshold(z, n1, c1)
        if cut is not None:
            likely = F.expr(f"filter(candidates, x -> not x.covered and {_score(start, trees, 'x.c')} >= {cut - 1e-9!r}D)")
            added = F.transform(likely, lambda x: F.struct(x["c"]["kind"].alias("kind"), x["c"]["start"].alias("start"), x["c"]["end"].alias("end")))
    return rows.select("doc_id", "base", added.alias("added"))


def find_pii_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each document."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return find_pii(documents).select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
