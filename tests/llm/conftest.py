import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of documents; missing columns are null."""
    names = ("doc_id", "text", "lang", "source", "n_chars")

    def make(rows, extra=""):
        rows = [r if isinstance(r, dict) else dict(zip(names, r, strict=False)) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long" + extra
        cols = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    extra = ", grp long, text_1 string, sig long, sum string, __id long, __nth long, __times long, row string, key_a long, epoch long, at long, stays boolean, probe long"
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "src1", 30),
        (2, "alpha beta gamma delta epsilon", None, None, None),
        (3, "", "en", "src1", 0),
        (4, "", "en", "src2", 0),
        (5, None, "en", "src2", None),
        (None, "alpha beta gamma delta epsilon", "en", "src3", 30),
        (6, long, "de", "src4", len(long)),
        (7, "  \n\t ", "fr", "src5", 5),
        (8, "mail me at jo.doe@example.com now", "en", "src6", 33),
        (8, "mail me at jo.doe@example.com now", "en", "src6", 33),
        (9, "é ñ ß 漢字 😀 don't", "es", "src7", 16),
        (None, None, None, None, None),
        (10, "one text of the id ten", "en", "src1", 22),
        (10, "quite other words under that same number", "en", "src1", 40),
        (11, "one text of the id ten", "en", "src1", 22),
    ]
    return frame(rows, extra)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
