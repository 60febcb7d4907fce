import pytest
from pyspark.sql import functions as F

from lexgrove.errors import NotFound
from lexgrove.functions import text
from lexgrove.functions.distance import osa
from lexgrove.functions.porter2 import stem


@pytest.mark.parametrize(
    "word, want",
    [
        ("consistency", "consist"), ("consisted", "consist"), ("knightly", "knight"), ("generously", "generous"), ("running", "run"), ("flies", "fli"),
        ("dying", "die"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("relational", "relat"), ("operator", "oper"), ("happiness", "happi"),
        ("sky", "sky"), ("skies", "sky"), ("controlling", "control"), ("news", "news"), ("inning", "inning"), ("by", "by"), ("say", "say"), ("cries", "cri"),
        ("ties", "tie"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("luxuriated", "luxuri"), ("bed", "bed"), ("sized", "size"), ("'tis", "tis"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def rows(spark, analyzer, value):
    df = spark.createDataFrame([(value,)], "t string").select(analyzer(F.col("t")).alias("x"))
    got = df.first().x
    return None if got is None else [(t.text, t.position, t.offset) for t in got]


def test_standard(spark):
    assert rows(spark, text.STANDARD, "The quick foxes can't run") == [("quick", 0, 3), ("fox", 1, 8), ("can't", 2, 13), ("run", 3, 18)]
    assert rows(spark, text.STANDARD, "the of and") == []
    assert rows(spark, text.STANDARD, "") == []
    assert rows(spark, text.STANDARD, None) is None


def test_gaps(spark):
    gaps = text.Analyzer("gaps", text.standard_tokenizer, (text.stop_words(),), positions="gaps")
    assert [(t, p) for t, p, _ in rows(spark, gaps, "quick the fox")] == [("quick", 0), ("fox", 2)]


def test_long_words_take_no_position(spark):
    assert [(t, p) for t, p, _ in rows(spark, text.SIMPLE, "a " + "é" * 128 + " b")] == [("a", 0), ("b", 1)]


def test_vietnamese(spark):
    assert rows(spark, text.VIETNAMESE, "Xin Chào") == [("xin", 0, 0), ("chào", 1, 4)]


def test_ngrams(spark):
    grams = text.Analyzer("grams", text.simple_tokenizer, (text.ngram_filter(2, 3),))
    want = ["ab", "bc", "abc"]
    assert [t for t, _, _ in rows(spark, grams, "abc x")] == want
    assert grams.plain("abc x") == want


def test_plain_agrees(spark):
    value = "Don't re-use 3.14 of l’eau — the Çays ABC_d"
    for a in (text.STANDARD, text.VIETNAMESE, text.SIMPLE):
        assert [t for t, _, _ in rows(spark, a, value)] == a.plain(value)


def test_registry():
    r = text.Registry()
    r.register(text.Analyzer("mine", text.simple_tokenizer))
    assert r.get("mine").name == "mine"
    with pytest.raises(NotFound):
        r.get("none")


def test_swaps():
    assert osa("pythno", "python") == 1
    assert osa("abc", "") == 3


def test_arrow_batches_stay_arrow():
    """Words of a batch aren't made Python objects, but for the distinct ones; null and empty lists stay."""
    import tracemalloc

    import pyarrow as pa

    words = ["running", "cats", "généreux", "generously"]
    lists = [None, [], words, *[[words[(k + i) % 4] for i in range(300)] for k in range(2000)], None]
    found = pa.array(lists, pa.list_(pa.string()))
    tracemalloc.start()
    stems = text.stem_words.func(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20
    assert stems.to_pylist() == [None if ws is None else [stem(w) for w in ws] for ws in lists]
    assert text.stem_words.func(found[1:3]).to_pylist() == [[], [stem(w) for w in words]]
    assert text.running_sums.func(pa.array([[3, 4, 5], None, [], [7, 1]], pa.list_(pa.int32()))).to_pylist() == [[0, 3, 7], None, [], [0, 7]]
