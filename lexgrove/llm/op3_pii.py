"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, schemes
(``://``), plus signs before a digit, pairs of digits, and cue words of identifiers
and secrets.  From an anchor a deterministic parser expands to both sides and
validates what it has: e-mail addresses, web and IPv4 addresses, telephone, card,
account, social security and IBAN numbers, access keys and secrets.  No search for
patterns runs over the text outside the anchors' surroundings.

Reaches: a number is at most 19 digits long, in groups with single spaces, hyphens or
full stops between; an account number begins within 16 characters of its cue, a sign
within 4 of a secret's cue and the value within 4 more; an IBAN follows its cue but for
spaces, colons and the like.  Each run of characters is read a fixed number of
times, however many anchors are in it: parsers remember the run that they read last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table, whole_id

_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DIGITS = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_DOMAIN = _ALNUM | frozenset(".-")
_SECRETS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key")
_ACCOUNTS = ("account", "acct", "konto", "cuenta", "compte")
SCHEMA = "doc_id long, kind string, begin int, end int, value string"
FINDING = "array<struct<kind: string, begin: int, end: int, value: string>>"


@cache
def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in (("@", "email"), ("://", "url"), ("akia", "key"), ("iban", "iban"), *((w, "secret") for w in _SECRETS), *((w, "account") for w in _ACCOUNTS)):
        a.add_word(word, (kind, len(word)))
    for i in range(10):
        a.add_word(f"+{i}", ("phone", 2))
        for j in range(10):
            a.add_word(f"{i}{j}", ("number", 2))
            a.add_word(f"{i}.{j}", ("number", 3))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(d := c.lower()) != 1 else d for c in text)


def _right(text: str, at: int, chars: frozenset[str]) -> int:
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def _left(text: str, at: int, chars: frozenset[str], floor: int) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[str, int, int] | None:
    a = _left(text, at, _LOCAL, floor)
    while a < at and text[a] in "._%+-":
        a += 1
    b = _right(text, at + 1, _DOMAIN)
    while b > at + 1 and text[b - 1] in ".-":
        b -= 1
    local, domain = text[a:at], text[at + 1 : b]
    labels = domain.split(".")
    while len(labels) > 1 and not (len(labels[-1]) > 1 and labels[-1].isalpha()):
        labels.pop()  # a domain ends in a label of letters
    domain = ".".join(labels)
    if not local or len(local) > 64 or local[-1] == "." or ".." in local or len(labels) < 2 or len(domain) > 253:
        return None
    if any(not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" for x in labels):
        return None
    return "email", a, at + 1 + len(domain)


_SCHEME = _ALNUM | frozenset("+.-")
_HOST = _ALNUM | frozenset("[_")


def _url(text: str, at: int, floor: int) -> tuple[str, int, int] | None:
    if at + 3 >= len(text) or text[at + 3] not in _HOST:
        return None
    a = _left(text, at, _SCHEME, floor)
    while a < at and not text[a].isalpha():
        a += 1
    if at - a < 2:
        return None
    b = at + 4
    while b < len(text) and not text[b].isspace() and text[b] not in "<>\"'`{}|\\^":
        b += 1
    while text[b - 1] in ".,;:!?)]*":
        b -= 1
    return "url", a, b


def _phone(text: str, at: int) -> tuple[str, int, int] | None:
    """From the plus sign: groups of digits, 8 to 15 in all, 11 with the country code 1; one separator, or a bracket with a space, between groups."""
    if at and text[at - 1] in _ALNUM:
        return None
    k, n, b = at + 1, 0, 0
    most = 11 if text[at + 1 : at + 2] == "1" and text[at + 2 : at + 3] not in _DIGITS else 15
    while True:
        e = _right(text, k, _DIGITS)
        if e == k or n + e - k > most or (e < len(text) and text[e] in _ALNUM):
            break
        n, b = n + e - k, e
        k = e
        while k < len(text) and k < e + 2 and text[k] in " ()-./" and (k == e or text[k] != text[k - 1]):
            k += 1
        if k == e or n == most:
            break
    return ("phone", at, b) if n >= 8 and (most == 15 or n == 11) else None


_DOTTED = _DIGITS | frozenset(".")
_LONGEST = 19


class _Runs:
    """What parsers remember of the runs that they read last in one text."""

    def __init__(self) -> None:
        self.dotted = (0, 0, -1)  # begin, end and floor of a run of digits and full stops that is no address
        self.digits = 0  # end of a run of digits that is no number
        self.value = (0, 0, -1)  # begin, end and last digit of a run without white space
        self.unquoted: dict[str, int] = {}  # where there is no closing quote any more


def _ip(text: str, at: int, end: int, floor: int, runs: _Runs) -> tuple[str, int, int] | None:
    a, b, known = runs.dotted
    if known == floor and a <= at and end <= b:
        return None
    a, b = _left(text, at, _DOTTED, floor), _right(text, end, _DOTTED)
    runs.dotted = (a, b, floor)
    while a < b and text[a] == ".":
        a += 1
    while b > a and text[b - 1] == ".":
        b -= 1
    if b - a > 15 or (a and text[a - 1] in _ALNUM) or (b < len(text) and text[b] in _ALNUM):
        return None
    parts = text[a:b].split(".")
    good = len(parts) == 4 and all(0 < len(p) < 4 and int(p) < 256 and (p == "0" or p[0] != "0") for p in parts)
    return ("ip", a, b) if good else None


def _number(text: str, at: int, end: int, floor: int, runs: _Runs) -> tuple[str, int, int] | None:
    """Around digits: IPv4, social security, telephone and card numbers; other long numbers need a cue."""
    found = _ip(text, at, end, floor, runs)
    if found:
        return found
    if text[at + 1] == "." or end <= runs.digits:
        return None
    a, b = _left(text, at, _DIGITS, floor), _right(text, end, _DIGITS)
    runs.digits = b
    if b - a > _LONGEST or (a and text[a - 1] in _ALNUM):
        return None
    # groups of digits with single marks between; the first may be in brackets
    bracket = b - a == 3 and a > floor and text[a - 1] == "(" and text[b : b + 1] == ")"
    groups, marks, ends, total, k = [b - a], "", [b], b - a, b
    while total < _LONGEST:
        n = 1 + (bracket and k == b and text[k + 1 : k + 2] in (" ", "-"))
        if not (text[k : k + 1] == ")" if bracket and k == b else text[k : k + 1] in (" ", "-", ".")) or text[k + n : k + n + 1] not in _DIGITS:
            break
        e = _right_most(text, k + n, _LONGEST + 1)
        total += e - k - n
        marks += text[k]
        groups.append(e - k - n)
        ends.append(e)
        k = e
    for take in range(len(groups), 0, -1):
        shape = groups[:take]
        card = 13 <= total <= _LONGEST and (take == 1 or min(shape[:-1]) == 4) and "." not in marks[: take - 1]
        total -= groups[take - 1]
        if not card and shape not in ([3, 2, 4], [3, 3, 4]):
            continue
        e, between = ends[take - 1], set(marks[: take - 1])
        if e < len(text) and text[e] in _ALNUM:
            continue
        number = "".join(c for c in text[a:e] if c in _DIGITS)
        if card and ")" not in between and luhn(number):
            return "card", a, e
        if shape == [3, 2, 4] and between == {"-"} and number[:3] not in ("000", "666") and number[0] != "9":
            return "ssn", a, e
        if shape == [3, 3, 4] and number[0] > "1" and number[3] > "1":
            return "phone", a - bracket, e
    return None


def _right_most(text: str, at: int, most: int) -> int:
    """As ``_right`` over digits, but no further than ``most``."""
    end = min(len(text), at + most)
    while at < end and text[at] in _DIGITS:
        at += 1
    return at


def _secret(text: str, at: int, runs: _Runs) -> tuple[str, int, int] | None:
    """After a cue: a sign, a value of six characters or more with a digit, to the closing quote or up to white space."""
    k = at
    if k < len(text) and text[k] in "\"'":
        k += 1
    while k < len(text) and k < at + 4 and text[k] in " \t":
        k += 1
    if k >= len(text) or text[k] not in "=:":
        return None
    k += 1
    while k < len(text) and k < at + 8 and text[k] in " \t":
        k += 1
    quote = text[k] if k < len(text) and text[k] in "\"'" else ""
    k += len(quote)
    if quote and k < runs.unquoted.get(quote, len(text)):
        e = text.find(quote, k)
        if e < 0:
            runs.unquoted[quote] = k
        elif "\n" not in (value := text[k:e]):
            return ("secret", k, e) if len(value) >= 6 and any(c in _DIGITS for c in value) else None
    a, e, last = runs.value
    if not a <= k < e:
        e, last = k, -1
        while e < len(text) and not text[e].isspace() and text[e] not in "\"'<>":
            if text[e] in _DIGITS:
                last = e
            e += 1
        runs.value = (k, e, last)
    if last < k:
        return None
    while e > last + 1 and text[e - 1] in ".!?),;*#%$&:":
        e -= 1
    return ("secret", k, e) if e - k >= 6 else None


def _key(text: str, at: int) -> tuple[str, int, int] | None:
    if at and text[at - 1] in _ALNUM:
        return None
    value = text[at : at + 21]
    e = _right(value, 0, _ALNUM)
    return ("key", at, at + 20) if e == 20 and value[:20] == value[:20].upper() else None


def _iban(text: str, at: int) -> tuple[str, int, int] | None:
    k = at
    while k < len(text) and text[k] in " :=#":
        k += 1
    e, value = k, ""
    if not (text[k : k + 2].isalpha() and text[k : k + 2].isupper() and text[k + 2 : k + 4].isdigit()):
        return None
    while e < len(text) and len(value) < 34 and (text[e] in _ALNUM or (text[e] == " " and e + 1 < len(text) and text[e + 1] in _ALNUM)):
        value += text[e].strip()
        e += 1
        if len(value) >= 15 and (e == len(text) or text[e] not in _ALNUM):
            turned = "".join(str(int(c, 36)) for c in value[4:] + value[:4])
            if int(turned) % 97 == 1:
                return "iban", k, e
    return None


def _account(text: str, at: int) -> tuple[str, int, int] | None:
    k = at
    while k < len(text) and k < at + 16 and text[k] not in _DIGITS:
        k += 1
    e = _right(text, k, _DIGITS | frozenset("-"))
    n = sum(c in _DIGITS for c in text[k:e])
    if not 6 <= n <= 19 or text[k - 1] in _ALNUM or (e < len(text) and text[e] in _ALNUM):
        return None
    return "account", k, e


def findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) in the order of the text, in characters; they don't overlap."""
    out: list[tuple[str, int, int]] = []
    done, runs = 0, _Runs()
    for last, (kind, n) in automaton().iter(_lower(text)):
        at, end = last - n + 1, last + 1
        if at < done:
            continue
        if kind == "email":
            found = _email(text, at, done)
        elif kind == "url":
            found = _url(text, at, done)
        elif kind == "phone":
            found = _phone(text, at)
        elif kind == "number":
            found = _number(text, at, end, done, runs)
        elif kind == "key":
            found = _key(text, at)
        elif kind == "iban":
            found = _iban(text, end)
        elif kind == "account":
            found = _account(text, end)
        else:
            found = _secret(text, end, runs)
        if not found:
            continue
        if kind == "email" or kind == "url":  # these expand to the left, over what a cue before may have found
            while out and out[-1][2] > found[1]:
                out.pop()
        out.append(found)
        done = found[2]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, kind, begin, end and value of every finding; places count characters from 0.

    Documents without findings, null and empty texts and empty tables give no row.  Repeated rows
    give repeated findings; a doc_id that is null or no whole number is null.  Only doc_id and text are
    read, whatever other columns there are; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                rows += [(doc, kind, a, b, text[a:b]) for kind, a, b in findings(text)]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "kind", "begin", "end", "value"])

    return docs.select(whole_id().alias("doc_id"), "text").where("text is not null").mapInArrow(frugal(run), SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each finding in text replaced by its kind in square brackets.

    All other columns and rows stay as they are, repeated rows and columns of any name too;
    null texts stay null, empty ones empty; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for kind, a, b in findings(text):
                out += [text[at:a], f"[{kind}]"]
                at = b
            return "".join([*out, text[at:]])

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", clean("text"))


def op3_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii_anchors": op3_pii_anchors}
SQL: dict[str, str] = {}
