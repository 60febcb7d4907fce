import pytest

from lexgrove import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf, same):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLE:
        same(df, catalogue.ORACLE[name])
    else:
        assert name in ("stem_english", "standard_tokens")  # these are tested below


def words(text):
    import regex

    return [w for w in regex.findall(r"[\p{L}\p{M}\p{N}_]+(?:['’.·:][\p{L}\p{M}\p{N}_]+)*", text.lower()) if len(w.encode()) <= 255]


def test_stems(spark, sf):
    """Words of the stemmer's published sample, and every word of the corpus against rules that hold for all stems."""
    sample = {
        "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori",
        "consolidate": "consolid", "consonant": "conson", "conspicuously": "conspicu", "conspiracy": "conspiraci", "constable": "constabl", "constantly": "constant", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead",
        "kneeling": "kneel", "knightly": "knight", "knitting": "knit", "knives": "knive", "knocker": "knocker", "knots": "knot", "skies": "sky", "dying": "die", "news": "news", "generously": "generous", "hopping": "hop", "hoping": "hope",
    }
    from lexgrove.functions.porter2 import stem

    assert {w: stem(w) for w in sample} == sample
    got = {r.term: r.stem for r in catalogue.QUERIES["stem_english"](spark, sf).collect()}
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    import regex

    assert set(got) == {w for t in texts for w in regex.findall(r"[\p{L}\p{N}_]+", t.lower()) if len(w.encode()) <= 255}
    assert all(s == stem(w) and len(s) <= len(w) + 1 and s[:2] == w[:2] for w, s in got.items() if w not in ("dying", "lying", "tying"))


def test_standard_tokens(spark, sf):
    from lexgrove.functions.porter2 import stem
    from lexgrove.functions.text import ENGLISH_STOP_WORDS

    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        at, kept = 0, []
        for w in words(r.text):
            if w not in ENGLISH_STOP_WORDS:
                kept.append((stem(w), at, len(w.encode())))
            at += len(w.encode())
        want += [(r.doc_id, t, k, o, n, "word") for k, (t, o, n) in enumerate(kept)]
    df = catalogue.QUERIES["standard_tokens"](spark, sf)
    assert sorted(map(tuple, df.select("doc_id", "text", "position", "offset", "length", "token_type").collect())) == sorted(want)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
