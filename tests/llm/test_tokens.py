"""BPE, binary shards, the suffix tree, mixing and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrove.llm import bytesops as B
from lexgrove.llm import op5_bpe, op7_token_binary, op9_suffix_tree_lm, op10_mixing
from lexgrove.llm import pretok as P
from lexgrove.llm.op7_token_binary import EliasFano, document


@pytest.fixture(scope="module")
def vocab():
    return P.Vocabulary()


alphabet = st.sampled_from([*"ab '’.,!?12é\n\t", " ", "　", "½", "€", "😀", "'s", "'re", "'ll", "'ve", "don't", "  ", "\x1c", "\x85", "​"])


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(alphabet, max_size=20).map("".join), min_size=1, max_size=4))
def test_ids(vocab, texts):
    data, off = B.buffers(pa.array(texts))
    ids, bounds = P.encode_rows(vocab, data, off)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [vocab.coder.encode_ordinary(t) for t in texts]
    assert vocab.decode(ids)[0].tobytes() == data.tobytes()


def test_bpe(spark, sf, vocab):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coded = op5_bpe.encode(docs, buckets=3).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = coded.collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert all(r.token_ids == vocab.coder.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in rows)
    assert {r.doc_id: r.text for r in op5_bpe.decode(coded).collect()} == texts
    assert op5_bpe.token_bytes(spark).count() == vocab.size


def test_bpe_of_odd_rows(spark, odd, empty, vocab):
    got = sorted(op5_bpe.encode(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 6, 7, 8, 8, 9, 10, 10, 11, None] and all(r.round_trip for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (3, 4)] == [0, 0]
    assert op5_bpe.encode(empty).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        op5_bpe.decode(spark.createDataFrame([(1, [vocab.size])], "doc_id long, token_ids array<int>")).collect()
    assert op5_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")).orderBy("doc_id").collect() == [(1, None), (2, "")]


def test_bytes_that_are_no_text(spark, vocab):
    by = {t: i for t, i in vocab.ranks.items()}
    odd = spark.createDataFrame([(1, [by[b"\xc3"], by[b"a"]]), (1, [by[b"\xc3"], by[b"\xa9"]])], "doc_id long, token_ids array<int>, x int".replace(", x int", ""))
    assert sorted(r.text for r in op5_bpe.decode(odd).collect()) == ["\u00e9", "\ufffda"]


def test_words_are_encoded_once(vocab, monkeypatch):
    """A bucket's words over many small batches."""
    calls = []
    words = op5_bpe._Words(vocab)
    encode = vocab.encode
    monkeypatch.setattr(vocab, "encode", lambda ws: (calls.extend(ws), encode(ws))[1])
    for some in ([b"ab", b"cd"], [b"cd", b"xyzzy"], [b"ab", b"xyzzy"]):
        n = words.numbers(some)
        assert [words.ids[words.bounds[k] : words.bounds[k + 1]].tolist() for k in n] == [vocab.coder.encode_ordinary(w.decode()) for w in some]
    assert calls == [b"ab", b"cd", b"xyzzy"]


def test_varints():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert op5_bpe._from_varint(op5_bpe._varint(x)).tolist() == x.tolist()


@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.integers(0, 1 << 20))
def test_elias_fano(steps, more):
    values = np.cumsum(steps) if steps else np.zeros(0, np.int64)
    if len(values) and values[-1] > 1 << 44:
        values = values >> 20
    top = int(values[-1]) + more if len(values) else more
    if top // max(len(values), 1) > 1 << 40:
        return
    ef = EliasFano.build(values, top)
    again = EliasFano(ef.n, ef.low_bits, ef.high.tobytes(), ef.low.tobytes(), ef.samples.tobytes())
    assert again.values().tolist() == values.tolist() == [again.select(i) for i in range(ef.n)]
    with pytest.raises(IndexError):
        again.select(ef.n)


@pytest.mark.parametrize("size", [1, 500, 1 << 20])
def test_shards(spark, sf, vocab, size, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for r in op7_token_binary.shards(docs, shard_tokens=size).collect():
        assert r.n_docs == len(r.doc_ids) and (r.n_tokens <= size or r.n_docs == 1 or size == 1)
        bits = 8 * (len(r.high) + len(r.low) + len(r.samples))
        assert bits < 64 * r.n_docs + 512
        for k, i in enumerate(r.doc_ids):
            assert document(r, k).tolist() == vocab.coder.encode_ordinary(texts[i])
            seen.append(i)
    assert sorted(seen) == sorted(texts)
    assert sum(r.n_docs for r in op7_token_binary.shards(odd, shard_tokens=size).collect()) == 13
    assert op7_token_binary.shards(empty).count() == 0


def test_saved_shards(spark, sf, vocab, tmp_path, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = None
    for parts in (1, 3):
        op7_token_binary.save(docs.repartition(parts), f"{tmp_path}/s", shard_tokens=5000, ordered=True)
        saved = op7_token_binary.load(spark, f"{tmp_path}/s")
        rows = [(r.doc_ids, bytes(r.ids)) for r in saved.orderBy("part", "shard").collect()]
        one = rows if one is None else one
        assert rows == one
    for r in docs.limit(5).collect():
        assert [x.tolist() for x in op7_token_binary.tokens(saved, r.doc_id)] == [vocab.coder.encode_ordinary(r.text)]
    op7_token_binary.save(odd, f"{tmp_path}/o")
    assert len(op7_token_binary.tokens(op7_token_binary.load(spark, f"{tmp_path}/o"), 8)) == 2


def test_suffix_tree(spark, sf, odd, empty):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    states = op9_suffix_tree_lm.train(docs)
    got = {r.doc_id: r.bits for r in op9_suffix_tree_lm.score(docs, states).collect()}
    want = op9_suffix_tree_lm.brute_force([r.text for r in rows], [r.text for r in rows])
    assert all(abs(got[r.doc_id] - w) < 1e-6 * w for r, w in zip(rows, want, strict=True))
    assert len({r.depth for r in states.collect()}) > 3
    assert op9_suffix_tree_lm.score(odd, states).count() == 13
    blank = op9_suffix_tree_lm.train(empty)
    assert blank.count() == 1 and op9_suffix_tree_lm.score(odd, blank).count() == 13 and op9_suffix_tree_lm.score(empty, blank).count() == 0


def test_suffix_tree_holds_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    states = op9_suffix_tree_lm.train(docs.where("doc_id % 2 = 0"))
    other = docs.where("doc_id % 2 = 1")

    def bits(s):
        return op9_suffix_tree_lm.score(other, s).agg({"bits": "sum"}).first()[0]

    assert bits(states) < 0.65 * bits(states.where("depth = 0"))


def test_suffix_tree_has_no_cap(spark):
    """Other scripts' bytes are told apart, and contexts have no greatest length."""

    def docs(texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    rng = random.Random(1)
    names = [f"w{k}" for k in range(30)]
    cyrillic = "мама мыла раму и папа мыл окно "
    mixed = list(cyrillic)
    rng.shuffle(mixed)
    lines = [f"a a a a a a b {rng.choice(names)}" for _ in range(3000)]
    texts = [cyrillic * 3] * 5 + lines
    tree = op9_suffix_tree_lm.train(docs(texts))
    tests = [cyrillic, "".join(mixed), "漢字仮名", "Мама"]
    got = [r.bits for r in op9_suffix_tree_lm.score(docs(tests), tree).orderBy("doc_id").collect()]
    assert got == pytest.approx(op9_suffix_tree_lm.brute_force(texts, tests))
    assert 3 * got[0] < got[1]
    assert max(r.depth for r in tree.select("depth").distinct().collect()) > 5  # contexts of five symbols


def test_suffix_tree_in_buckets(spark, odd, empty, sf):
    """Scores without a table of states are those with one, with and without large contexts and contexts beyond the subtrees."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).collect()
    rows += [(1000 + k, f"a a a a a a b w{k % 7}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = op9_suffix_tree_lm.brute_force([r[1] for r in rows], [r[1] for r in rows])
    for large, bucket in ((1 << 21, 1 << 20), (300, 2000)):
        got = {r.doc_id: r for r in op9_suffix_tree_lm.train_and_score(docs, large=large, bucket=bucket).collect()}
        assert [got[r[0]].bits for r in rows] == pytest.approx(want)
    plain = op9_suffix_tree_lm.score(odd, op9_suffix_tree_lm.train(odd)).collect()
    key = lambda r: (r.doc_id or 0, r.n_symbols, r.bits)
    for got, w in zip(sorted(op9_suffix_tree_lm.train_and_score(odd, large=100).collect(), key=key), sorted(plain, key=key), strict=True):
        assert got.doc_id == w.doc_id and got.n_symbols == w.n_symbols and got.bits == pytest.approx(w.bits)
    assert op9_suffix_tree_lm.train_and_score(empty).count() == 0


def test_suffix_tree_reads_texts_twice(spark):
    """Deep contexts are grown from the corpus in numbers, not from the texts level by level."""
    rows = [(k, "a a a a a a b c d e f g a b " * (k % 7 + 1) + f"w{k % 7}") for k in range(300)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = {r.doc_id: r.bits for r in op9_suffix_tree_lm.train_and_score(docs, large=200, bucket=500).collect()}
    assert [got[k] for k, _ in rows] == pytest.approx(op9_suffix_tree_lm.brute_force([t for _, t in rows], [t for _, t in rows]))
    assert read.value <= 3 * len(rows)  # once more if their number is asked for


def test_least_occurrences():
    """Fewer occurrences than the least give no gain that passes, as many give one at best."""
    for most in (5.0, 12.0, 19.0, 25.0):
        least = op9_suffix_tree_lm._least(4.0, most, 12.0)
        for m in range(1, 60):
            up = min(m / np.exp(most), 0.99)
            p = (m + 4 * up) / (m + 4)
            gain = m * (p * np.log(p / up) + (1 - p) * np.log(4 / (m + 4)))
            assert gain <= 12 or m >= least
    assert op9_suffix_tree_lm._least(4.0, 19.0, 12.0) == 3


def test_mix_matches_sql(spark, sf, same):
    same(op10_mixing.op10_mixing(spark, sf), op10_mixing.SQL["op10_mixing"])


def test_budgets(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s3", 10), ("b", "en", "s4", 5000)], "domain string, lang string, source string, supply long")
    from pyspark.sql import functions as F

    none = ({}, {}, {})
    got = {r.source: r.budget for r in op10_mixing.budgets(leaves, F.lit(2000), 1, none).collect()}
    # a and b get 1000 each; de can take 10, so en has 990: s1 its 100, s2 the rest
    assert got == {"s1": 100, "s2": 890, "s3": 10, "s4": 1000}
    got = {r.source: r.budget for r in op10_mixing.budgets(leaves, F.lit(4000), 1, none).collect()}
    assert got == {"s1": 100, "s2": 1000, "s3": 10, "s4": 2890}  # a is used up: the shortage goes to b
    got = {r.source: r.budget for r in op10_mixing.budgets(leaves, F.lit(10**6), 2, none).collect()}
    assert got == {"s1": 200, "s2": 2000, "s3": 20, "s4": 10000}


def test_mix_of_odd_rows(odd, empty):
    got = op10_mixing.mix(odd, share=(1, 1), epochs=1).collect()
    assert sum(r.take for r in got) <= sum(r.tokens for r in got)
    assert {r.doc_id for r in got} <= {1, 2, None, 6, 7, 8, 9, 10, 11}
    whole = op10_mixing.mixed_rows(odd, share=(2, 1), epochs=2)
    assert whole.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in whole.where("doc_id in (8, 10)").collect()) == [8] * 4 + [10] * 4
    assert op10_mixing.mix(empty).count() == 0 and op10_mixing.mixed_rows(empty).count() == 0


@pytest.mark.parametrize("share", [(1, 5), (1, 2), (7, 20), (3, 2)])
def test_mix_ends_in_repeated_rows(frame, share):
    """Five rows that no order tells apart: as many are taken as the budget has room for, the last in part."""
    docs = frame([(1, "sixteen bytes ..", "en", "src1")] * 5)
    want = sorted([4] * (5 * 4 * share[0] // share[1] // 4) + [x for x in [5 * 4 * share[0] // share[1] % 4] if x])
    got = op10_mixing.mix(docs, share=share)
    assert sorted(r.take for r in got.collect()) == want
    assert op10_mixing.mixed_rows(docs, share=share).count() == len(want)


def test_mix_is_seeded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def rows(seed):
        return sorted(map(tuple, op10_mixing.mix(docs, share=(1, 2), seed=seed).collect()))

    assert rows("a") == rows("a") != rows("b")


def _quality(text):
    """Covered share, longest repeat and share of words there again, from the places of equal runs of words."""
    import re

    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    n, covered, longest, again, places, seen = len(w), set(), 0, set(), {}, set()
    for i in range(n - 5):
        places.setdefault(tuple(w[i : i + 6]), []).append(i)
    for at in places.values():
        for i in at if len(at) > 1 else ():
            k = 0
            for j in at:
                m = 0
                while i != j and max(i, j) + m < n and w[i + m] == w[j + m]:
                    m += 1
                k = max(k, m)
            covered |= set(range(i, i + k))
            longest = max(longest, k)
    for i in range(n - 1):
        again |= {i, i + 1} if (w[i], w[i + 1]) in seen else set()
        seen.add((w[i], w[i + 1]))
    return len(covered) / max(n, 1), longest, len(again) / max(n, 1)


def test_pipeline(spark, sf, vocab):
    """Against a straightforward version of all stages that uses none of the operators; the mix is that of the SQL."""
    import importlib.util
    import sys
    from pathlib import Path

    import duckdb

    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline here")
    import corpus_pipeline
    from test_pairs import brute, classes

    from lexgrove.llm.common import held, release

    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    kept = [r for r in rows if (q := _quality(r.text)) and q[0] <= 0.85 and q[1] <= 30 and q[2] <= 0.5]
    assert 0 < len(kept) < len(rows)
    texts, unique = set(), []
    for r in kept:
        if r.text not in texts:
            texts.add(r.text)
            unique.append(r)
    gone = {i for i, least, _ in classes(brute([(r.doc_id, r.text) for r in unique], 0.5)) if i != least}
    unique = {r.doc_id: r for r in unique if r.doc_id not in gone}
    documents = pa.table({c: [r[c] for r in unique.values()] for c in rows[0].asDict()})
    taken = duckdb.connect().register("documents", documents).sql(op10_mixing.SQL["op10_mixing"]).select("doc_id").fetchall()
    want = sorted((i, *vocab.coder.encode_ordinary(unique[i].text)) for (i,) in taken)
    before = held()
    out = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, *r.token_ids) for r in out.collect()) == want
    assert held() - before == {out.written_path}
    release(spark, since=before)
    assert held() == before
    assert len(corpus_pipeline.STAGES) == 5


def test_nothing_is_left_in_the_shared_folder(spark, frame, sf):
    """What an operator wrote goes once its result is stored."""
    import os

    from lexgrove.llm import op6_ngram_join, op8_radix_dedup
    from lexgrove.llm.common import release, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    release(spark)
    before = set(os.listdir(folder))
    docs = frame([(k, f"one two three four five {k % 3}", "en", "src1") for k in range(9)])
    for op in (op8_radix_dedup.copies, op8_radix_dedup.drop_copies, op6_ngram_join.near_classes, op10_mixing.mix):
        op(docs).write.format("noop").mode("overwrite").save()
        release(spark)
        assert set(os.listdir(folder)) == before
