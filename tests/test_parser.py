import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexgrove.errors import InvalidArgument, ParseError
from lexgrove.plans.ast import Bool, Fuzzy, MatchAll, Node, Phrase, Prefix, Range, Term, Wildcard
from lexgrove.plans.parser import Parser
from lexgrove.plans.validate import Limits, rewrite, validate

T = lambda v: Term("content", v)
P = Parser().parse


@pytest.mark.parametrize(
    "text, node",
    [
        ("  ", MatchAll()),
        ('"quick brown fox"', Phrase("content", ("quick", "brown", "fox"))),
        ('""', Phrase("content", ())),
        ("foo NOT bar", Bool(should=(T("foo"),), must_not=(T("bar"),))),
        ("foo AND bar", Bool(must=(T("bar"),), should=(T("foo"),))),
        ("title:x AND y", Bool(must=(T("y"),), should=(T("title:x"),))),
        ("title:pre*", Prefix("title", "pre")),
        ("title:*", Prefix("title", "")),
        ("title:p*e?", Wildcard("title", "p*e?")),
        ("pre*", Wildcard("content", "pre*")),
        ("title:x y", Term("title", "x y")),
        ("content:quik~1", Term("content", "quik~1")),
        ("quik~", Fuzzy("content", "quik", 1)),
        ("quik~7", Fuzzy("content", "quik", 2)),
        ("quik~x", Fuzzy("content", "quik", 2)),
        ("price:[10 TO 20}", Range("price", gte=10.0, lt=20.0)),
        ("price:{* TO 5]", Range("price", gt="*", lte=5.0)),
        ("rust programming", T("rust programming")),
    ],
)
def test_compat(text, node):
    assert P(text) == node


@pytest.mark.parametrize("text", ["price:[10 20]", "price:[1 TO 2", "price:[ TO"])
def test_bad_ranges(text):
    with pytest.raises(ParseError):
        P(text)


def test_extended():
    x = Parser(syntax="extended").parse
    assert x('title:(a OR b) AND NOT "c d"~2') == Bool(must=(Bool(should=(Term("title", "a"), Term("title", "b"))),), must_not=(Phrase("content", ("c", "d"), 2),))
    assert x("rust^2.5") == Term("content", "rust", 2.5)
    assert x("n:[1 TO 2] quik~1") == Bool(should=(Range("n", gte=1.0, lte=2.0), Fuzzy("content", "quik", 1)))
    for bad in ("(a", "a)", "AND"):
        with pytest.raises(ParseError):
            x(bad)


def test_multi_term_or():
    assert Parser(multi_term="or").parse("a b") == Bool(should=(T("a"), T("b")))


@given(st.text(max_size=40))
def test_parse_gives_a_node_or_a_parse_error(text):
    try:
        assert isinstance(P(text), Node)
    except ParseError:
        assert ":[" in text.replace(" ", "") or ":{" in text.replace(" ", "")


def test_limits():
    deep = T("a")
    for _ in range(11):
        deep = Bool(must=(deep,))
    with pytest.raises(InvalidArgument):
        validate(deep)
    with pytest.raises(InvalidArgument):
        validate(Bool(should=(T("a"),) * 1025))
    with pytest.raises(InvalidArgument):
        validate(Wildcard("content", "*a"), Limits(allow_leading_wildcard=False))
    validate(Wildcard("content", "*a"))


nodes = st.recursive(
    st.sampled_from([T("a"), T("b"), T("c"), MatchAll()]),
    lambda inner: st.builds(lambda m, s, n, f: Bool(tuple(m), tuple(s), tuple(n), tuple(f)), *[st.lists(inner, max_size=2)] * 4),
    max_leaves=6,
)


def holds(q, words):
    if isinstance(q, MatchAll):
        return True
    if isinstance(q, Term):
        return q.value in words
    return all(holds(c, words) for c in (*q.must, *q.filter)) and not any(holds(c, words) for c in q.must_not) and (not q.should or any(holds(c, words) for c in q.should))


@given(nodes)
def test_rewrites_keep_matches(q):
    for words in ("", "a", "b", "ab", "bc", "abc"):
        assert holds(rewrite(q), words) == holds(q, words)
