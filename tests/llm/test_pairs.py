"""Near and exact duplicates against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrove.llm import bytesops as B
from lexgrove.llm import op6_ngram_join as J
from lexgrove.llm import op8_radix_dedup as R


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))


def grams(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, t, n=3):
    sets = {i: s for i, x in rows if i is not None and x is not None and (s := grams(x, n))}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def corpus(seed, count=120):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    out = []
    for k in range(count):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            w = [r.choice(vocab) if r.random() < r.choice((0, 0.05, 0.2)) else x for x in w]
        else:
            w = [vocab[min(59, int(r.expovariate(0.08)))] for _ in range(r.choice((1, 2, 5, 40, 80)))]
        out.append((k, " ".join(w)))
    return out


def classes(pairs):
    """(doc_id, class_id, links) by all pairs of documents."""
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    least = {}
    for i in sorted(around):
        todo = [] if i in least else [i]
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = i
                todo += around[x]
    return sorted((i, least[i], len(x)) for i, x in around.items())


@pytest.mark.parametrize("threshold, small, sets", [(0.5, 2, 7), (0.8, 64, 1024)])
def test_classes(frame, threshold, small, sets, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", sets)  # blocks in shards
    rows = corpus(int(threshold * 10) + small)
    want = brute(rows, threshold)
    got = sorted(map(tuple, J.near_classes(frame(rows), threshold, small_cell=small).collect()))
    assert got == classes(want) and len(want) > 10
    same = {}
    for i, x in rows:
        same.setdefault(frozenset(grams(x)), i)
    pairs = {(r.doc_a, r.doc_b): r.jaccard for r in J.near_pairs(frame(rows), threshold, small_cell=small).collect()}
    heads = set(same.values())
    assert pairs.keys() == {(a, b) for a, b in want if a in heads and b in heads}
    assert all(abs(pairs[k] - want[k]) < 1e-12 for k in pairs)


def test_frequent_grams_and_equal_sums(frame, monkeypatch):
    """N-grams in more sets than the sketch's step, and sets whose first sums are the same."""
    monkeypatch.setattr(J, "FREQUENT", 3)
    both = J.signatures
    monkeypatch.setattr(J, "signatures", lambda bounds, g: (both(bounds, g)[0] % 16, both(bounds, g)[1]))
    rows = corpus(9)
    assert sorted(map(tuple, J.near_classes(frame(rows), 0.4).collect())) == classes(brute(rows, 0.4))


def test_keep_one(frame):
    rows = corpus(5)
    gone = {i for i, least, _ in classes(brute(rows, 0.5)) if i != least}
    assert sorted(r.doc_id for r in J.keep_one(frame(rows)).collect()) == [i for i, _ in rows if i not in gone]


def test_classes_of_odd_rows(odd, empty, frame):
    assert sorted(map(tuple, J.near_classes(odd).collect())) == [(1, 1, 1), (2, 1, 1), (10, 10, 1), (11, 10, 1)]
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 8, 9, 10, 10]
    assert J.near_classes(empty).count() == 0 and J.keep_one(empty).count() == 0 and J.near_pairs(empty).count() == 0
    docs = frame([(1, "x y z"), (2, "X, y z"), (2, "quite other words")])
    assert sorted(r.text for r in J.keep_one(docs).collect()) == ["quite other words", "x y z"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=2, max_size=8), st.sampled_from([0.2, 0.5, 0.75, 1.0]), st.randoms())
def test_trie(sets, t, rng):
    J.DENSE = rng.choice([0, 1, 64])  # items by lists, or by bits
    arrays = [np.array(sorted(s)) for s in sets]
    got = {(i, j): o for i, j, o in J.trie_pairs(arrays, t)}
    want = {(i, j): len(a & b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if len(a & b) >= t * len(a | b) - 1e-9}
    assert got == want
    n = len(sets)
    weights = np.array([rng.randint(1, 3) for _ in sets])
    for side in (np.full(n, 2), np.array([rng.randint(0, 1) for _ in sets])):
        masks = np.array([[rng.choice([0, 0, 1, 2, 3])] for _ in sets], np.uint64)
        links, group = J._links(arrays, weights, side, masks, t)
        for i in range(n):
            met = [j for j in range(n) if (min(i, j), max(i, j)) in want and (side[i] == 2 or side[i] != side[j]) and not int(masks[i, 0]) & int(masks[j, 0])]
            assert links[i] == sum(weights[j] for j in met)
        assert all(group[i] == group[j] for i, j in want)
        assert all(group[i] in [i] + [j for p in want for j in p] for i in range(n))


def test_trie_in_time():
    """Nested sets, related sets with few pairs, near copies of one text."""
    J.DENSE = 64
    import time

    r = np.random.default_rng(1)
    nested = [np.arange(k) for k in range(1, 1501)]
    related = [np.unique(np.r_[r.choice(400, 60, replace=False), 1000 + r.choice(10**6, 60)]) for _ in range(2000)]
    base = r.choice(10**6, 300, replace=False)
    copies = [np.unique(np.r_[r.permutation(base)[: 300 - r.integers(1, 90)], 10**7 + r.choice(10**6, 30)]) for _ in range(2000)]
    for sets in (nested, related, copies):
        began = time.process_time()
        links, _ = J._links(sets, np.ones(len(sets)), np.full(len(sets), 2), np.zeros((len(sets), 1), np.uint64), 0.5)
        took = time.process_time() - began
        print("took", round(took, 2))
        for i in (0, 7, len(sets) - 1):
            assert links[i] == sum(len(np.intersect1d(sets[i], x)) >= 0.5 * len(np.union1d(sets[i], x)) for x in sets) - 1
        assert took < 4


def test_words():
    import pyarrow as pa

    texts = ["", "A-b c", None, "x", " é漢 1_2", "end"]
    data, off = B.buffers(pa.array(texts))
    h, s, e, row = B.words(data, off)
    assert [(int(r), bytes(data[a:b]).lower()) for r, a, b in zip(row, s, e, strict=True)] == [(k, w) for k, t in enumerate(texts) for w in words(t or "")]
    assert len(set(h.tolist())) == len({w for t in texts for w in words(t or "")})


def copies(rows):
    first, out = {}, []
    for i, x in sorted((r for r in rows if None not in r), key=lambda r: r[0]):
        if x in first:
            out.append((i, first[x]))
        else:
            first[x] = i
    return sorted(out)


@pytest.mark.parametrize("first, grow", [(1, 1), (2, 3), (64, 8)])
def test_copies(frame, first, grow):
    r = random.Random(first)
    rows = [(k, "".join(r.choice("ab") for _ in range(r.choice((0, 1, 2, 3, 4, 64, 65))))) for k in range(80)]
    rows += [(k + 100, "x" * k) for k in (63, 64, 65, 575, 576, 577)] + [(300 + k, "x" * 576) for k in range(3)] + [(400, "é" * 32), (401, "é" * 32 + "a")]
    if grow == 1:
        rows = [(i, x[:6]) for i, x in rows]
    got = sorted((x.doc_id, x.keep_doc_id) for x in R.copies(frame(rows), first, grow).collect())
    assert got == copies(rows)


def test_copies_of_odd_rows(odd, empty):
    assert sorted((r.doc_id, r.keep_doc_id) for r in R.copies(odd).collect()) == [(2, 1), (4, 3), (8, 8), (11, 10)]
    kept = R.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 6), (False, 7), (False, 8), (False, 9), (False, 10), (False, 10), (True, 0), (True, 0)]
    assert R.copies(empty).count() == 0 and R.drop_copies(empty).count() == 0


def test_no_unique_text_goes(frame):
    """Ids that several texts share, at the first digit and beyond it."""
    long = "x" * 100
    rows = [(1, "x y z"), (2, "x y z"), (2, "quite other words"), (3, long + "a"), (4, long + "a"), (4, long + "b"), (3, long + "c"), (5, long + "c"), (5, "A" * 70), (5, "U" * 70), (7, "A" * 70), (8, "U" * 70), (6, "z"), (6, "z"), (6, "z")]
    docs = frame(rows)
    kept = [(r.doc_id, r.text) for r in R.drop_copies(docs).collect()]
    assert sorted(kept) == sorted((min(i for i, t in rows if t == text), text) for text in {t for _, t in rows})
    want = sorted((i, k) for text in {t for _, t in rows} for own in [sorted(i for i, t in rows if t == text)] for k in own[:1] for i in own[1:])
    assert sorted(map(tuple, R.copies(docs).collect())) == want


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("1", "a"), ("2", "a"), ("x", "a"), ("y", "b")], "doc_id string, text string")
    assert sorted(map(tuple, R.copies(docs).collect())) == [(2, 1)]
    assert sorted(r.doc_id for r in R.drop_copies(docs).collect()) == ["1", "x", "y"]


def test_large_ids_beside_nulls(spark, frame):
    from lexgrove.llm.common import keys, without

    ids = [2**62 + k for k in range(50)]
    docs = frame([(i, "x") for i in ids] + [(None, "y")])
    gone = docs.where("doc_id % 2 = 0").select(*keys())
    got = [r.doc_id for r in without(docs, gone).collect()]
    assert sorted(i for i in got if i is not None) == ids[1::2] and got.count(None) == 1
