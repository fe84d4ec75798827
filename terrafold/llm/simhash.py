"""SimHash near-duplicates by BK-trees over shards of fingerprints.

A fingerprint of 64 bits is cut into BLOCKS blocks. Two fingerprints within RADIUS bits differ in at most
RADIUS blocks, so they agree in BLOCKS - RADIUS at least; every choice of so many blocks deals distinct
fingerprints to shards that agree there. Each shard grows a BK-tree, whose children are keyed by their
Hamming distance to the parent, and a search follows only the edges within the radius. A search takes
what it reaches out of the tree, so a shard yields a spanning forest of its links, never all pairs; it
only deals with distinct fingerprints, so copies cost nothing. A shard with more than MOST_IN_SHARD
members is dealt anew on its remaining bits, again without losing a link, until it is small enough.

A tree is grown and searched where its shard lies and not broadcast: each fingerprint would have to meet the
trees of all shards, and at a distance of 4 of 64 bits a tree of unlike fingerprints rules out next to
nothing, so broadcast trees would compare all with all, block by block. Pairs and leaves of few fingerprints
are compared at once.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows
share their component; a null doc_id keeps its row but names no component unless all ids there are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bytes_of, checkpointed, written
from terrafold.llm.components import components, stars

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 6
MOST_IN_SHARD = 20_000
LEAF = 48
#: Wide fingerprints, for links at a Jaccard similarity of 0.8: each 16 of their bits deal to one shard, the first 128 are measured.
TABLES, WIDE_RADIUS = 128, 38
#: Shards of more fingerprints, or of so many links a fingerprint, grow a tree.
AT_ONCE, MANY_LINKS = 512, 4
#: Sets of at most so many shingles also meet what lacks one of them.
FEW = 8
#: Links that a task gathers before it joins each name to the smallest that they reach.
LINKS_AT_ONCE = 1 << 20
#: Bytes of sets that are compared in one task at once; a set counts as LEAST_WEIGHT at least.
BLOCK_WEIGHT, LEAST_WEIGHT = 8 << 20, 4096
_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, TABLES // 4, np.uint64) | np.uint64(1)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """text: UTF-8. A bit is 1 if set in over half of the shingles' hashes."""
    words = text.translate(_FOLD).split()  # bytes split at \\x20 and \\x09-\\x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    h = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([h(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]), np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) for each document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            found = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(apply, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(bits: list[int], blocks: int, keep: int) -> list[int]:
    """Masks of every choice of keep out of so many nearly equal blocks of bits."""
    cut = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << b for block in chosen for b in block) for chosen in combinations(cut, keep)]


class BKTree:
    """Of distinct fingerprints, of one word or, in a matrix, of several. A node with few points keeps them as a leaf; numpy measures all at once."""

    def __init__(self, points: np.ndarray, places: np.ndarray):
        self.points, self.places, self.children = points, places, None
        self.left = len(places)
        if len(places) > LEAF:
            self.root = points[places[0]]
            d = self.apart(points[places[1:]], self.root)
            order = np.argsort(d, kind="stable")
            keys, first = np.unique(d[order], return_index=True)
            self.children = {int(k): BKTree(points, part) for k, part in zip(keys, np.split(places[1:][order], first[1:]))}
            self.places = places[:1]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits = np.bitwise_count(a ^ b)
        return bits if self.points.ndim == 1 else bits.sum(-1, dtype=np.int64)

    def take(self, point: np.ndarray, radius: int) -> list[int]:
        """Places within the radius, which leave the tree."""
        if not self.left:
            return []
        d = self.apart(self.points[self.places], point) if len(self.places) else np.zeros(0, np.uint8)
        hit = d <= radius
        out = self.places[hit].tolist()
        if self.children is None:
            if out:
                self.places = self.places[~hit]
        else:
            at = int(self.apart(self.root, point))
            for k in range(at - radius, at + radius + 1):
                if (child := self.children.get(k)) is not None:
                    out += child.take(point, radius)
                    if not child.left:
                        del self.children[k]
            if len(self.places) and hit[0]:
                self.places = self.places[:0]
        self.left -= len(out)
        return out


def spanning_links(points: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Places (a, b) that connect what links within the radius connect, fewer than there are points."""
    if len(points) < 2:
        return []
    tree, links = BKTree(points, np.arange(len(points))), []
    for start in range(len(points)):
        if not tree.left:
            break
        queue = [start]
        while queue:
            at = queue.pop()
            found = tree.take(points[at], radius)
            fresh = [x for x in found if x != at]
            links += [(at, x) for x in fresh]
            queue += fresh
    return links


def _shard_links(radius: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard."""

        def linked(fps: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            sizes = np.diff(cut)
            for at in cut[:-1][sizes == 2]:
                if int(np.bitwise_count(fps[at] ^ fps[at + 1])) <= radius:
                    a.append(fps[at]), b.append(fps[at + 1])
            for at, n in zip(cut[:-1][sizes > 2], sizes[sizes > 2]):
                own = fps[at : at + n]
                for x, y in spanning_links(own, radius):
                    a.append(own[x]), b.append(own[y])
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

        rest: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("mask", "shard", "fp")])
            if not rows.shape[1]:
                continue
            if rest:
                rows = np.concatenate([*rest, rows], axis=1)
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            if not len(new):
                rest = [rows]
                continue
            done = new[-1]
            yield linked(rows[2, :done].view(np.uint64), np.append(0, new))
            rest = [rows[:, done:]]
        if rest:
            rows = rest[0]
            yield linked(np.ascontiguousarray(rows[2]).view(np.uint64), np.array([0, rows.shape[1]]))

    return apply


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, most: int = MOST_IN_SHARD) -> DataFrame:
    """fps with distinct fp: pairs (a, b) that span the components of links within the radius."""
    masks = block_masks(list(range(64)), blocks, blocks - radius)
    dealt = lambda rows, column: rows.select(F.explode(column).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("shard"), "fp")
    todo, found = dealt(fps, F.array(*(F.lit(_signed(m)) for m in masks))), None
    while masks:
        sizes = todo.groupBy("mask", "shard").count()
        large = checkpointed(sizes.where(F.col("count") > most).select("mask", "shard"))
        hot = not large.isEmpty()
        small = todo.join(large, ["mask", "shard"], "left_anti") if hot else todo
        small = small.repartition("mask", "shard").sortWithinPartitions("mask", "shard", "fp")
        part = small.mapInArrow(_shard_links(radius), "a long, b long")
        found = part if found is None else found.union(part)
        if not hot:
            break
        # What a large shard's members agree on is given; they are dealt on the bits that are left.
        again = [(mask, finer) for mask in masks for bits in [[b for b in range(64) if not mask >> b & 1]] if len(bits) > radius for finer in (mask | m for m in block_masks(bits, radius + 1, 1))]
        masks = sorted({m for _, m in again})
        finer = fps.sparkSession.createDataFrame([(_signed(a), _signed(b)) for a, b in again], "mask long, finer long")  # some hundred masks
        rows = todo.join(large, ["mask", "shard"], "left_semi").join(F.broadcast(finer), "mask").select(F.col("finer").alias("mask"), "fp")
        todo = checkpointed(rows.distinct().select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("shard"), "fp"))
    return found


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for each document."""
    rows = checkpointed(fingerprints(documents))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp"))).select(F.col("node").alias("fp"), "root")
    classes = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Minima are written before the join, so that Spark can split a root that very many fingerprints share.
    classes = written(classes)
    ids = written(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = classes.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by the Jaccard similarity of shingles ------------------------------------------


def shingles(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """text: UTF-8. The distinct hashes of its shingles, sorted."""
    words = text.translate(_FOLD).split()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[i : i + shingle]), seed) for i in range(max(1, len(words) - shingle + 1))] if words else [], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _FACTORS[0]
    x ^= x >> np.uint64(29)
    return x


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """16 bits for each of TABLES. A bit is 1 if set in over half of the shingles' hashes, which are mixed anew for each 64 bits."""
    ones = np.zeros(TABLES * 16, np.int64)
    for i in range(0, len(hashes), 255):  # a byte counts so far
        ones += np.unpackbits(_mixed(hashes[i : i + 255, None] * _FACTORS).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint16)


def _name(points: np.ndarray) -> np.ndarray:
    """A number for each measured part, of two words, of a fingerprint; should two share one, they are candidates."""
    return _mixed(points[:, 0] * _FACTORS[1] ^ _mixed(points[:, 1] * _FACTORS[2])).view(np.int64)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint and table."""
    for batch in batches:
        if k := batch.num_rows:
            wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint16).reshape(k, TABLES)
            shard = wide.astype(np.int32) + (np.arange(TABLES, dtype=np.int32) << 16)
            points = np.repeat(np.ascontiguousarray(wide[:, :8]).view(np.int64), TABLES, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(shard.ravel()), pa.array(points[:, 0]), pa.array(points[:, 1])], names=["shard", "f1", "f2"])


def wide_links(shard: np.ndarray, points: np.ndarray, radius: int = WIDE_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by shard and point: places (a, b) that connect, in each shard, what links within the radius connect."""
    # A point that a shard holds several times stands in it once.
    own = np.flatnonzero(np.append(True, (np.diff(shard) != 0) | (points[1:] != points[:-1]).any(1))) if len(shard) else np.zeros(0, np.int64)
    shard, points = shard[own], points[own]
    cut = np.append(np.flatnonzero(np.append(True, np.diff(shard) != 0)), len(shard)) if len(shard) else np.zeros(1, np.int64)
    size = np.diff(cut)
    number = np.repeat(np.arange(len(size)), size)
    at, step, a, b = np.flatnonzero(size[number] <= AT_ONCE), 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at := at[at + step < cut[number[at] + 1]]):
        near = np.bitwise_count(points[at] ^ points[at + step]).sum(1, dtype=np.int64) <= radius
        a.append(at[near]), b.append(at[near] + step)
        step += 1
    a, b = np.concatenate(a), np.concatenate(b)
    trees = (size > AT_ONCE) | (np.bincount(number[a], minlength=len(size)) > MANY_LINKS * size)
    few = ~trees[number[a]]
    a, b = [a[few]], [b[few]]
    for k in np.flatnonzero(trees):
        spanning = np.array(spanning_links(points[cut[k] : cut[k + 1]], radius), np.int64).reshape(-1, 2) + cut[k]
        a.append(spanning[:, 0]), b.append(spanning[:, 1])
    return own[np.concatenate(a)], own[np.concatenate(b)]


def _wide_shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and fingerprint."""

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        points = np.ascontiguousarray(rows[1:].T).view(np.uint64)
        a, b = wide_links(rows[0], points)
        told = stars(_name(points[a]), _name(points[b]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in told], names=["a", "b"])

    rest = [np.zeros((3, 0), np.int64)]
    for batch in batches:
        rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("shard", "f1", "f2")])
        new = np.flatnonzero(np.diff(rows[0])) + 1
        done = new[-1] if len(new) else 0
        if not done and (not rows.shape[1] or not rest[0].shape[1] or rest[0][0, -1] == rows[0, 0]):
            rest.append(rows)
            continue
        yield linked(np.concatenate([*rest, rows[:, :done]], axis=1))
        rest = [rows[:, done:]]
    yield linked(np.concatenate(rest, axis=1))


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, LINKS_AT_ONCE at a time, as links to the smallest that they reach. A group of near copies meets in many shards, by other links in each; here most become the same ones."""
    found, held = [np.zeros((2, 0), np.int64)], 0

    def gathered() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*np.concatenate(found, axis=1))], names=["a", "b"])

    for batch in batches:
        found.append(np.stack([np.asarray(batch.column(c)) for c in ("a", "b")]))
        held += batch.num_rows
        if held > LINKS_AT_ONCE:
            yield gathered()
            found, held = [np.zeros((2, 0), np.int64)], 0
    yield gathered()


def alike_links(sets: list[np.ndarray], parts: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Places (a, b) of sets that are least alike and connect what such links connect, fewer than there are sets; of sets of two parts, only links between the parts are asked for."""
    m, n = len(sets), np.array([len(x) for x in sets], np.int64)
    flat, first, owner = np.concatenate(sets), np.cumsum(n) - n, np.repeat(np.arange(m), n)
    place = np.unique(flat, return_inverse=True)[1]
    # Of 1024 parts of all shingles, those of which one set holds an odd and the other an even number hold one at least that only one set has.
    odd = np.packbits(np.bincount(owner * 1024 + (flat >> np.uint64(54)).astype(np.int64), minlength=m * 1024).reshape(m, 1024) & 1, axis=1).view(np.uint64)
    label, seen, links, crossing = np.arange(m), np.zeros(len(flat), bool), [], bool((parts != parts[0]).any())
    for x in range(m - 1):
        y = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1
        if crossing:
            y = y[parts[y] != parts[x]]
        y = y[(n[y] >= least * n[x] - 1e-9) & (n[x] >= least * n[y] - 1e-9)]
        y = y[np.bitwise_count(odd[y] ^ odd[x]).sum(1, dtype=np.int64) <= (n[x] + n[y]) * ((1 - least) / (1 + least)) + 1e-6]
        if not len(y):
            continue
        own, start = place[first[x] : first[x] + n[x]], np.cumsum(n[y]) - n[y]
        seen[own] = True
        both = np.add.reduceat(seen[place[np.repeat(first[y] - start, n[y]) + np.arange(n[y].sum())]], start, dtype=np.int64)
        seen[own] = False
        for z in y[both >= least * (n[x] + n[y] - both)].tolist():
            if label[z] != label[x]:
                label[label == label[z]] = label[x]
                links.append((x, z))
    return links


def _block_links(least: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block."""
        block, nodes, parts, sets = None, [], [], []

        def linked() -> pa.RecordBatch:
            pairs = alike_links(sets, np.array(parts), least) if len(sets) > 1 else []
            told = stars(*(np.array([nodes[x[k]] for x in pairs], np.int64) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in told], names=["a", "b"])

        for batch in batches:
            for *own, part, node, x in zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "part", "node", "hashes"))):
                if own != block:
                    yield linked()
                    block, nodes, parts, sets = own, [], [], []
                nodes.append(node), parts.append(part), sets.append(np.frombuffer(x, np.uint64))
        yield linked()

    return apply


def survivors(documents: DataFrame, key: str, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, key) of one document of each component of links: the smallest id, nulls last, of equals the smallest key. key: a column that tells rows with one id apart.

    A link is a Jaccard similarity of at least so much between the sets of shingles, computed on SimHash's candidates. At 0.8
    some 0.15 of a fingerprint's bits differ, so it is wide: it is dealt to a shard by each 16 of its bits, and in a shard what lies
    within the radius in 128 bits is linked by a spanning forest, in a large one by a BK-tree. Two that are 0.8 alike meet in a
    shard but for some one in 10,000, and lie within the radius; sets of at most FEW shingles also meet what lacks one of
    theirs, which no link of theirs goes beyond. Components of these links hold the candidates: within them the sets are
    compared, a component of more than BLOCK_WEIGHT in blocks of two of its parts. Texts without words are one set."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column("text"))
            nodes, wide, less = np.zeros(len(at) - 1, np.uint64), [], []
            for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                hashes = shingles(data[a:b].tobytes(), shingle)
                nodes[i] = int.from_bytes(xxhash.xxh64_digest(hashes.tobytes(), SEED), "big") if len(hashes) else 0
                wide.append(wide_fingerprint(hashes))
                fewer = [wide_fingerprint(np.delete(hashes, k))[:8].view(np.uint64) for k in range(len(hashes))] if 1 < len(hashes) <= FEW else []
                less.append(_name(np.array(fewer)).tolist() if fewer else [])
            names = _name(np.array([w[:8].view(np.uint64) for w in wide], np.uint64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(key), pa.array(nodes.view(np.int64)), pa.array(names), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(less, pa.list_(pa.int64()))], names=["doc_id", key, "node", "name", "wide", "less"])

    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in ("doc_id", key))
    texts = documents.select("doc_id", key, F.coalesce("text", F.lit("")).alias("text"))
    rows = written(texts.mapInArrow(marked, f"{kinds}, node long, name long, wide binary, less array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)).alias("first")
    classes = rows.groupBy("node").agg(first, F.min("name").alias("name"))
    dealt = rows.where("node <> 0").select("node", "wide").dropDuplicates(["node"]).select("wide").mapInArrow(_dealt, "shard int, f1 long, f2 long")
    met = dealt.repartition("shard").sortWithinPartitions("shard", "f1", "f2").mapInArrow(_wide_shard_links, "a long, b long")
    lacking = rows.where("node <> 0").select(F.col("name").alias("a"), F.explode("less").alias("b"))
    met = met.union(lacking).repartition(documents.sparkSession.sparkContext.defaultParallelism).mapInArrow(_starred, "a long, b long")
    near = components(met).select(F.col("node").alias("name"), F.col("root"))
    named = written(classes.where("node <> 0").join(near, "name", "left").select("node", "first", F.coalesce("root", "name").alias("root")))
    several = named.groupBy("root").count().where("count > 1").select("root")
    asked = named.join(several, "root", "left_semi").select("root", F.col("first.doc_id").alias("_named"), f"first.{key}")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, text in zip(batch.column("root"), batch.column("text")):
                hashes = shingles(text.as_py().encode(), shingle).tobytes()
                node = int.from_bytes(xxhash.xxh64_digest(hashes, SEED), "big", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([root.as_py()], pa.int64()), pa.array([node], pa.int64()), pa.array([hashes], pa.binary())], names=["root", "node", "hashes"])

    theirs = texts.join(asked, [texts[key] == asked[key], F.col("doc_id").eqNullSafe(F.col("_named"))]).select("root", "text").mapInArrow(sets, "root long, node long, hashes binary")
    held = written(theirs.dropDuplicates(["node"]))
    weight = F.sum(F.greatest(F.octet_length("hashes"), F.lit(LEAST_WEIGHT)))
    parts = held.groupBy("root").agg(F.ceil(weight / BLOCK_WEIGHT).alias("parts"))
    part = held.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    blocks = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    blocks = blocks.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "hashes")
    links = blocks.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "part", "node").mapInArrow(_block_links(least), "a long, b long")
    kept = classes.select("node", "first").join(components(links), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return kept.select("first.doc_id", f"first.{key}")
