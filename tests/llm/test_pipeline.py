"""Stages of the pipeline on small awkward tables."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import simhash, toxicity
from terrafold.llm.common import table
from tests.llm.conftest import passage
from tests.llm.test_operators import brute_secrets, plain_alignment, plain_toxicity, reference_encoding  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA).repartition(3)


def test_ids_do_not_decide_which_texts_go(spark, data):
    """Different texts under a null or a shared id all stay; of copies one row stays, whatever their ids."""
    texts = [passage(10 * k) for k in range(6)]
    pairs = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[4]), (9, texts[4]), (None, texts[5]), (None, texts[5]), (8, texts[2]), (8, None), (None, "")]
    found = corpus_pipeline.drop_near_duplicates(spark, rows_of(spark, pairs), data)
    assert found.columns == list(corpus_pipeline.COLUMNS)
    expected = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[4]), (None, texts[5]), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, rows_of(spark, pairs).limit(0), data).count() == 0


def test_near_copies_by_jaccard(spark, data):
    """Of a text and its copy with words changed, one stays from similarity 0.8 on, both below; large groups of near copies leave one."""
    rng = random.Random(11)
    pairs, sets = [], {}
    for k in range(150):
        words = [f"v{rng.randrange(10**6)}" for _ in range(150)]
        copy = [f"x{rng.randrange(10**6)}" if rng.random() < 0.012 * (k % 4) else w for w in words]
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    base = passage(5, 200).split()
    pairs += [(1000 + k, " ".join([*base[:k], f"edit{k}", *base[k + 1 :]])) for k in range(100)]
    for i, text in pairs:
        w = text.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    found = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows_of(spark, pairs), data).collect()}
    expected = {2 * k for k in range(150)} | {2 * k + 1 for k in range(150) if jaccard(2 * k, 2 * k + 1) < 0.8} | {1000}
    assert 20 < sum(0.8 <= jaccard(2 * k, 2 * k + 1) < 0.95 for k in range(150))
    assert found == expected


def test_links_at_the_edge_of_large_groups(spark, data):
    """Texts that are near one member of a large group alone, and texts that share most of their words without being near, against all pairs."""
    rng = random.Random(41)
    edited = lambda words, at, mark: [f"{mark}{i}" if i in at else w for i, w in enumerate(words)]
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    members = [edited(base, {3 * k + 2}, f"m{k}x") for k in range(60)]
    texts = members[:]
    for k in range(40):  # near member k alone, at several similarities about 0.8
        texts.append(edited(members[k], set(rng.sample(range(5, 195), 3 + k % 3)), f"e{k}x"))
        texts.append(edited(texts[-1], set(rng.sample(range(5, 195), 4)), f"f{k}x"))
    texts += [base[:140] + [f"t{k}x{i}" for i in range(60)] for k in range(80)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    found = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows_of(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]), data).collect()}
    assert found == set(root) and 82 < len(found) < 160


def test_near_copies_come_by_fingerprints():
    """Wide fingerprints of texts about 0.8 alike lie within the radius and meet in a shard, others do not; shards with trees link the same; few shingles meet by what lacks one."""
    rng = np.random.default_rng(5)
    number = lambda n: rng.integers(0, 2**64, n, np.uint64)
    apart = lambda a, b: int(np.bitwise_count(a[:8] ^ b[:8]).sum())
    for n in (18, 90, 900):
        for _ in range(60):
            same = number(n * 8 // 9)
            a, b, c = (simhash.wide_fingerprint(np.concatenate([x, number(n - len(same))])) for x in (same, same, number(len(same))))
            assert apart(a, b) <= simhash.WIDE_RADIUS < apart(a, c) and (a == b).any()
    near = number((1, 2)) ^ (np.uint64(1) << rng.integers(0, 64, (700, 2), np.uint64))
    points = np.concatenate([near, near[:3], number((40, 2))])
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    for shard in (np.zeros(len(points), np.int64), np.arange(len(points)) // 30):
        a, b = simhash.wide_links(shard, points)
        root = np.arange(len(points))
        for x, y in zip(a.tolist(), b.tolist()):
            assert shard[x] == shard[y] and np.bitwise_count(points[x] ^ points[y]).sum() <= simhash.WIDE_RADIUS
            root[root == root[y]] = root[x]
        known = np.isin(points[:, 0], near[:, 0])
        for k in set(shard.tolist()):
            at = np.flatnonzero((shard == k) & known)
            first = at[np.unique(points[at], axis=0, return_index=True)[1]]  # of equal points the first stands for all
            assert len(set(root[first].tolist())) <= 1
        assert len(a) < simhash.MANY_LINKS * len(points) + 1


def test_group_of_near_copies_gives_few_links():
    """Near copies meet in many shards; what components are made of are hardly more links than texts, over all shards and tasks, and connect the same."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, simhash.TABLES * 2, np.uint8)
    wide = [(base ^ np.packbits(rng.random(simhash.TABLES * 16) < 0.06)).tobytes() for _ in range(400)]
    dealt = pa.Table.from_batches(simhash._dealt([pa.record_batch({"wide": pa.array(wide)})])).sort_by([("shard", "ascending"), ("f1", "ascending"), ("f2", "ascending")])
    met = pa.Table.from_batches(simhash._wide_shard_links(dealt.to_batches(2000))).to_pylist()
    tasks = [pa.RecordBatch.from_pylist(met[k::4]) for k in range(4)]
    links = {(r["a"], r["b"]) for task in tasks for batch in simhash._starred([task]) for r in batch.to_pylist()}
    assert len({(r["a"], r["b"]) for r in met}) < 2 * 400 and len(links) < 1.5 * 400 and all(a > b for a, b in links)

    def roots(pairs):
        root = {x: x for pair in pairs for x in pair}
        for a, b in pairs:
            if root[a] != root[b]:
                root = {x: root[b] if r == root[a] else r for x, r in root.items()}
        return {frozenset(x for x in root if root[x] == r) for r in set(root.values())}

    assert roots(links) == roots([(r["a"], r["b"]) for r in met]) and len(roots(links)) == 1


def test_unlinked_alike_texts_make_no_pairs():
    """Sets that are all much alike, most below 0.8, yield fewer links than sets, the right components, in one block and in blocks of two parts."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 300, np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - d], rng.integers(0, 2**64, d, np.uint64)])) for d in rng.integers(20, 60, 150).tolist()]
    alike = {(i, j) for i in range(150) for j in range(i) if len(both := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(both))}

    def roots(pairs):
        root = list(range(150))
        for i, j in pairs:
            root = [root[j] if r == root[i] else r for r in root]
        return {frozenset(k for k in range(150) if root[k] == r) for r in root}

    whole = simhash.alike_links(sets, np.zeros(150, np.int64), 0.8)
    assert len(whole) < 150 and roots(whole) == roots(alike) and 1 < len(roots(alike)) < 149
    parts = np.arange(150) % 3
    found = []
    for low in range(3):
        for high in range(low, 3):
            at = np.flatnonzero((parts == low) | (parts == high))
            found += [(at[a], at[b]) for a, b in simhash.alike_links([sets[k] for k in at], parts[at], 0.8)]
    assert roots(found) == roots(alike)


def test_few_words_and_components_in_blocks(spark, data, monkeypatch):
    """Texts of 4 and 5 shingles that differ by one are all found, and a component compared in several blocks leaves one text."""
    rng = random.Random(12)
    words = [[f"s{rng.randrange(10**6)}" for _ in range(9)] for _ in range(150)]
    pairs = [(2 * k, " ".join(w[:8])) for k, w in enumerate(words)] + [(2 * k + 1, " ".join(w)) for k, w in enumerate(words)]
    base = passage(5, 200).split()
    pairs += [(1000 + k, " ".join([*base[:k], f"edit{k}", *base[k + 1 :]])) for k in range(60)]
    monkeypatch.setattr(simhash, "BLOCK_WEIGHT", 10 * simhash.LEAST_WEIGHT)
    found = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows_of(spark, pairs), data).collect()}
    assert found == {2 * k for k in range(150)} | {1000}


def brute_force(spark, rows, items, model):
    """Every stage by plain Python: scores gram by gram, all pairs of texts, all pairs of texts and items."""
    kept = [r for r in rows if plain_toxicity(r[1], model) < 0.5]
    sets = []
    for _, text in kept:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()})
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    first = {}
    for r, k in sorted(zip(kept, root), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(k, r)
    out = []
    for i, text in first.values():
        words = re.findall(r"\w+", (text or "").lower())
        joined = f" {' '.join(words)} "
        if any(any(f" {' '.join(item[k : k + 3])} " in joined for k in range(len(item) - 2)) and plain_alignment(item, words) >= min(len(item), 100) for item in items):
            continue
        clean, at = "", 0
        for kind, a, b in brute_secrets(text or ""):
            if a >= at:
                clean += (text or "")[at:a] + f"[{kind}]"
            at = max(at, b)
        out.append((i, clean + (text or "")[at:]))
    return out


def test_run_by_brute_force(spark, tmp_path, reference_encoding):
    rng = random.Random(31)
    words = [f"{a}{b}" for a in ("ka", "mo", "ti", "ru", "sen", "dor") for b in ("l", "n", "ra", "po", "is", "um", "ek")]
    text = lambda n: " ".join(rng.choice(words) + (f"{rng.randrange(40)}" if rng.random() < 0.3 else "") for _ in range(n))
    items = [[f"q{k}w{j}" for j in range(30)] for k in range(4)]
    rows = [(i, text(60) + (" vileword vileword" if i % 5 == 0 else "")) for i in range(400)]
    for i in range(400, 440):  # copies, whole or with one word changed, some under smaller ids
        source = rows[rng.randrange(1, 400)][1].split()
        if i % 2:
            source[rng.randrange(len(source))] = f"edit{i}"
        rows.append((i if i % 4 else -i, " ".join(source)))
    for i in range(440, 470):
        part = items[i % 4][:]
        part[rng.randrange(30)] = "changed"
        rows.append((i, f"{text(30)} {' '.join(part[: 30 if i % 3 else 9])} {text(30)}"))
    rows += [(470 + i, f"{text(40)} Password: {'abcdefgh12345678'[: 6 + i]} AKIA{'ABCDEFGH23456789'} {text(10)}") for i in range(8)]
    rows += [(None, text(50)), (None, text(50)), (None, rows[7][1]), (500, None), (501, ""), (502, " \n"), (503, rows[9][1]), (503, text(60)), (504, text(4000))]
    rng.shuffle(rows)
    rows_of(spark, rows).withColumn("N_Tokens", F.lit("another column")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("vileword" in (t or "")), 0) for i, t in rows if i is not None and i % 3], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = toxicity.train(table(spark, str(tmp_path), "documents").select(*corpus_pipeline.COLUMNS), table(spark, str(tmp_path), "labels"))
    expected = brute_force(spark, rows, items, model)
    found = [(r["doc_id"], r["ids"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    ids = [(i, reference_encoding.encode_ordinary(t)) for i, t in expected]
    assert sorted(found, key=repr) == sorted([(i, x, len(x)) for i, x in ids], key=repr)
    assert 250 < len(found) < 400 and any("[assign]" in t for _, t in expected)


def test_run_of_empty_tables(spark, tmp_path):
    rows_of(spark, [(1, "x")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
