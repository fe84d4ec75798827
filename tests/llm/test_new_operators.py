"""SentencePiece, the filter audit and ranked search against the library, brute force and plain formulas."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from terrafold.llm import audit, lexical, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Pieces(pieces.read_model(MODEL))


def test_pieces_equal_the_library(library, encoder):
    some = random.Random(7)
    letters = " " * 6 + "\n\t\r abcdetinghsr" + "éßü日本語の😀ａ▁\xa0\x00 .,-:/0123456789ABCD"
    texts = ["".join(some.choice(letters) for _ in range(some.randrange(40))) for _ in range(4000)]
    texts += [" " * k + a + " " * k for k in range(40) for a in ("", "t", "\n")] + ["<s>x</s><0x41><unk>", "ab" * 50_000, "é" * 70_000, "0123456789abcdef" * 9000]
    for text in texts:
        ids = library.encode(text)
        assert encoder.encode(text) == ids
        own, decoded = encoder.ids_and_text(text)
        assert np.frombuffer(own, "<u4").tolist() == ids and decoded.decode() == library.decode(ids) == encoder.decode(ids)


def test_any_ids_decode_as_in_the_library(library, encoder):
    some = random.Random(8)
    for _ in range(4000):
        ids = [some.choice([some.randrange(32000), 1, 2, 3 + some.randrange(256), 29871, 259]) for _ in range(some.randrange(7))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_prefix_table_holds_each_prefix_last_token(library, encoder):
    unit = "▁unbelievablyinternationalisation"
    last = encoder.last_tokens(unit)
    for n in range(1, len(unit) + 1):
        assert last[n] == library.encode(unit[1:n])[-1] if n > 1 else last[n] == library.piece_to_id("▁")


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    own = pieces.Pieces(pieces.read_model(MODEL))
    text = "the quick brown fox jumps over the lazy dog and the cat " * 3
    assert np.frombuffer(own.ids_and_text(text)[0], "<u4").tolist() == library.encode(text)


def test_encode_query_and_operator(documents, nothing, library, rows):
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_digests(documents, MODEL).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = [(r[0], library.encode(r[1] or "", add_bos=True, add_eos=True)) for r in rows]
    assert found == {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x).encode())) for i, x in ids}
    assert pieces.encode_digests(documents, MODEL).count() == len(rows)
    back = pieces.decode(pieces.encode(documents.select("doc_id", "text"), MODEL, begin=False), MODEL).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") and r.ids[-1] == 2 for r in back)
    assert pieces.encode_digests(nothing, MODEL).collect() == []
    with pytest.raises(ValueError, match="exist"):
        pieces.encode(documents, MODEL, ids_column="N")


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        data = file.read()
    # The kind of the model and the treatment of spaces, in its last two parts.
    for was, now in ((b"\x06tok_v0\x18\x02", b"\x06tok_v0\x18\x01"), (b"identity\x12\x00\x18\x01 \x00", b"identity\x12\x00\x18\x01 \x01")):
        path = tmp_path / "m.model"
        path.write_bytes(data.replace(was, now))
        with pytest.raises(ValueError):
            pieces.read_model(str(path))


# --- filter audit ----------------------------------------------------------------------------------


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    return {f for f, on in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", bool(re.search("[#$%&*|]", text)))) if on}


def audited(rows, labels):
    """(part, order, step): figures, by going through the documents in each order."""
    texts = [(i, t or "", s or "") for i, t, s in rows]
    low = {}
    for i, t, _ in texts:
        if i is not None:
            low[t] = min(low.get(t, i), i)
    docs = [(failing(t) | ({"E"} if i is not None and low[t] < i else set()), s, any(x == i and q == 1 for x, q, _ in labels), any(x == i and v == 1 for x, _, v in labels)) for i, t, s in texts]
    out, by_filter = {}, Counter()
    for part in {s for _, _, s in texts}:
        own = [d for d in docs if d[1] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(d[0] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                by_filter[part, f] += len(gone)
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_going_through_the_documents(spark):
    some = random.Random(5)
    prose = [" ".join(some.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(some.randrange(k)) for _ in range(n)) for k, n in ((900, 60), (2, 70), (900, 20), (900, 80))]
    prose += ["AB CD " + prose[0], prose[0] + " #", prose[0].upper(), "", " \t", "x\x0by\x1cz" + prose[3]]
    rows = [(some.choice([None, *range(12)]), some.choice([None, *prose]), some.choice([None, "", "a", "b"])) for _ in range(150)]
    rows += [(20 + k, prose[0], "hot") for k in range(60)] + [(1, prose[1], "a")] * 5
    labels = [(k, some.choice([0, 1, None]), some.choice([0, 1])) for k in (*range(10), 3, 4, 25, 30, 77)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as word", "1 as times", "'y' as digest").repartition(3)
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = audited(rows, labels)
    assert len(found) == len(expected)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found} == expected


def test_audit_of_nothing_and_of_odd_rows(spark, nothing, documents, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(nothing, labels).collect() == []
    found = audit.audit(documents, labels).where("step = 5 and filter_order = 'ABCDE'").collect()
    expected = audited([(r[0], r[1], r[3]) for r in rows], [])
    assert {r.part: (r.kept, r.removed, r.shapley) for r in found} == {k[0]: (v[0], v[1], v[6]) for k, v in expected.items() if k[1:] == ("ABCDE", 5)}


def test_places_count_like_plain_sums():
    some = np.random.default_rng(1)
    places, expected = audit.Places(), np.zeros(32, np.int64)
    for n in (0, 1, 2, 3, 5000):
        words, times = some.integers(0, 1 << 32, n), some.integers(0, 1 << 40, n)
        places.add(words, times)
        for b in range(32):
            expected[b] += times[words >> b & 1 == 1].sum()
        assert all(len(p) <= 2 for p in places.planes)
        assert places.counts().tolist() == expected.tolist()


# --- ranked search ---------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(documents, items, top=10):
    docs = [(i, terms(t)) for i, t in documents]
    docs = [(i, Counter(w), len(w)) for i, w in docs if w]
    n, length = len(docs), sum(d[2] for d in docs)
    out = []
    for item, text in items:
        scores = []
        for doc, tf, size in docs:
            m, score = 25 + (75 * size * n) // length, 0
            for t, times in Counter(terms(text)).items():
                if tf[t]:
                    df = sum(t in d[1] for d in docs)
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, k, doc, -s) for k, (s, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def corpus():
    some = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["É", "été", "ünï", "日本", "ſ", "x_y", "Zz", "don't"]
    text = lambda n: " ".join(words[min(int(some.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(k, text(some.randrange(1, 90))) for k in range(160)] + [(200 + k, "w0 w1 w2") for k in range(30)] + [(300, None), (301, ""), (302, " ?! \x7f"), (None, "w1 w5"), (303, "w3 " * 20000)]
    items = [(k, text(some.randrange(1, 60))) for k in range(25)]
    return docs, [*items, (50, None), (51, ""), (52, "absent words"), (53, items[3][1]), (54, "w1 w1 w1 W1"), (55, items[4][1] + " " + items[5][1])]


@pytest.mark.parametrize("block, held", [(1 << 20, 1 << 21), (90, 300)])
def test_search_equals_plain_scores(spark, monkeypatch, block, held):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "HELD_SUMS", held)
    docs, items = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as terms", "2 as score").repartition(5)
    own = spark.createDataFrame([*items, items[0]], "item_id long, text string").selectExpr("*", "3 as rank")
    found = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(rows, own).collect())
    assert found == ranked(docs, items)


def test_search_of_two_texts_under_one_id_and_of_nothing(spark, nothing):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c"), (4, "z")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a"), ("i", "c"), (None, "b")], "item_id string, text string")
    found = lexical.search(docs, items)
    assert sorted((r.item_id or "", r.text_number, r["rank"], r.doc_id) for r in found.collect()) == [("", 0, 1, 1), ("", 0, 2, 2), ("i", 0, 1, 1), ("i", 1, 1, 3), ("i", 1, 2, 2)]
    assert lexical.search(nothing, items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
    assert found.schema["item_id"].dataType.simpleString() == "string"


def test_shared_sets_become_nodes():
    items = [[b"a", b"b", b"c", b"d"], [b"a", b"b", b"c", b"e"], [b"a", b"b", b"f"], [b"c", b"c", b"e"]]
    sharing = lexical.mined(items)
    # a and b are one leaf, for the same items hold them; with c once they are a node that two items share.
    assert sharing.leaf[sharing.leaf_at[sharing.terms[b"a"]]] == sharing.leaf[sharing.leaf_at[sharing.terms[b"b"]]]
    assert sum(len(left) for left, _ in sharing.levels) >= 1
    each = np.array([7, 11, 13, 17, 19, 23], np.int64)
    weight, m = each * 1000, np.array([25])
    tf = np.ones(len(each), np.int64)
    scores = lexical.sums_of(sharing, weight, m, np.array([6]), np.arange(6), tf)[:, 0]
    order = list(sharing.terms)
    for item, score in zip(items, scores):
        assert score == sum(int(weight[order.index(t)]) * (1_000_000_000 // 1200) for t in item)


def test_search_keeps_no_more_than_its_best(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'common ' || if(id % 3 = 0, 'rare', 'x') as text")
    found = lexical.search(docs, spark.createDataFrame([(1, "rare")], "item_id int, text string"))
    assert [r.doc_id for r in found.orderBy("rank").collect()] == list(range(0, 30, 3))
