"""Pseudonyms against plain Python: every day, sampled numbers of every form, and whole texts."""

import datetime
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import pii

BEFORE, AFTER = r"(?<![\w.+-])", r"(?![\w-])"
SHAPES = [
    ("ssn", BEFORE + r"\d{3}-\d{2}-\d{4}" + AFTER),
    ("date_iso", BEFORE + r"\d{4}-\d{2}-\d{2}" + AFTER),
    ("date_day", BEFORE + r"\d{2}[/.]\d{2}[/.]\d{4}" + AFTER),
    ("phone", BEFORE + r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + AFTER),
    ("ip", BEFORE + r"\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)"),
    ("card", BEFORE + r"\d(?:[ -]?\d){12,18}" + AFTER),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
]
GROUPS = BEFORE + r"(?:\d{13,19}|\d{4}(?P<a>[ -])\d{4}(?P=a)\d{4}(?P=a)\d{4}|\d{4}(?P<b>[ -])\d{6}(?P=b)\d{5})" + AFTER
FIRST = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SHAPES), re.ASCII)
_SECOND = "|".join(f"(?P<{k}>{GROUPS if k == 'card' else p})" for k, p in SHAPES)
SECOND, BEHIND = re.compile(_SECOND, re.ASCII), re.compile(rf"(?!\A)(?:{_SECOND})", re.ASCII)
DAY0 = datetime.date(1900, 1, 1)


def permuted(a, b, ma, mb, key, tweak):
    for i in range(8):
        f = lambda x, m: int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:14], 16) % m  # noqa: B023, E731
        a, b = ((a + f(b, ma)) % ma, b) if i % 2 == 0 else (a, (b + f(a, mb)) % mb)
    return a, b


def check_digit(payload):
    twice = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(payload))]
    return str(-sum(x - 9 if x > 9 else x for x in twice) % 10)


def date_of(kind, d):
    y, m, day = (d[:4], d[4:6], d[6:]) if kind == "date_iso" else (d[4:], d[2:4], d[:2])
    try:
        x = datetime.date(int(y), int(m), int(day))
    except ValueError:
        return None
    return x if 1900 <= x.year <= 2099 else None


def renamed(kind, m, key):
    """The pseudonym, or None if the match is not valid."""
    d = re.sub("[^0-9]", "", m)
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, b = permuted(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind in ("date_iso", "date_day"):
        day = date_of(kind, d)
        if day is None:
            return None
        n = (day - DAY0).days
        a, b = permuted(n // 4297, n % 4297, 17, 4297, key, "date")
        new = DAY0 + datetime.timedelta(a * 4297 + b)
        new = new.strftime("%Y%m%d" if kind == "date_iso" else "%d%m%Y")
    elif kind == "phone":
        ten = d[-10:]
        if ten[0] < "2" or ten[3] < "2":
            return None
        a, b = permuted(int(ten[:3]) - 200, int(ten[3:]) - 2_000_000, 800, 8_000_000, key, "phone")
        new = d[:-10] + f"{a + 200}{b + 2_000_000}"
    elif kind == "ip":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        a, b = permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    elif kind == "card":
        if check_digit(d[:-1]) != d[-1]:
            return None
        half = (len(d) - 1) // 2
        wide = len(d) - 1 - half
        a, b = permuted(int(d[:half]), int(d[half:-1]), 10**half, 10**wide, key, f"card{len(d)}")
        new = f"{a:0{half}d}{b:0{wide}d}"
        new += check_digit(new)
    else:
        return "u" + hashlib.sha256(f"{key}|email|{m.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    left = iter(new)
    return "".join(next(left) if c.isdigit() else c for c in m)


def replaced(text, key, forms):
    """(pieces, kinds): text and replaced strings in turn; a match that is not valid stays in its text."""
    pieces, kinds, at = [""], [], 0
    for m in forms.finditer(text):
        kind = next(k for k, _ in SHAPES if m[k] is not None)
        new = renamed(kind, m[0], key)
        pieces[-1] += text[at : m.start()] + (m[0] if new is None else "")
        at = m.end()
        if new is not None:
            pieces += [new, ""]
            kinds.append(kind)
    pieces[-1] += text[at:]
    return pieces, kinds


def expected(text, key):
    if text is None:
        return None, []
    pieces, kinds = replaced(text, key, FIRST)
    out, found = "", []
    for i, p in enumerate(pieces):
        if i % 2:
            out, found = out + p, [*found, kinds[i // 2]]
        else:
            again, more = replaced(p, key, BEHIND if i else SECOND)
            out, found = out + "".join(again), found + more
    return out, found


def one_column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "m string")


@pytest.mark.parametrize("form,kind", [("yyyy-MM-dd", "date_iso"), ("dd.MM.yyyy", "date_day")])
def test_every_day_goes_to_another_day(spark, form, kind):
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), form).alias("m"))
    got = days.select("m", pii.pseudonym(F.col("m"), F.lit("k")).alias("p")).select("m", "p", pii.kind_of(F.col("p")).alias("k")).collect()
    assert {r.m for r in got} == {r.p for r in got} and {r.k for r in got} == {kind}
    assert all(renamed(kind, r.m, "k") == r.p for r in got[::997])


def test_numbers_keep_their_form_and_stay_apart(spark):
    r = np.random.RandomState(3)
    ssn = [f"{a:03d}-{b:02d}-{c:04d}" for a, b, c in zip([1, 665, 667, 899, *r.randint(1, 666, 300)], [1, 99, 1, 99, *r.randint(1, 100, 300)], [1, 9999, 1, 9999, *r.randint(1, 10000, 300)])]
    phone = [f"({a}) {b}-{c:04d}" for a, b, c in zip(r.randint(200, 1000, 300), r.randint(200, 1000, 300), r.randint(0, 10000, 300))]
    ip = ["0.0.0.0", "255.255.255.255"] + [".".join(map(str, x)) for x in r.randint(0, 256, (300, 4))]
    for kind, values in (("ssn", ssn), ("phone", phone), ("ip", ip)):
        got = one_column(spark, values).select("m", pii.pseudonym(F.col("m"), F.lit("k")).alias("p")).select("m", "p", pii.kind_of(F.col("p")).alias("k")).collect()
        assert {x.k for x in got} == {kind}
        assert len({x.p for x in got}) == len(set(values)) and all(x.p == renamed(kind, x.m, "k") for x in got)


def test_whole_texts_against_plain_python(spark):
    r = np.random.RandomState(5)
    digits = lambda n: "".join(map(str, r.randint(0, 10, n)))

    def card(n):
        x = "4" + digits(n - 2)
        return x + check_digit(x)

    bits = [
        lambda: card(16), lambda: " ".join(re.findall("....", card(16))), lambda: card(15), lambda: digits(16), lambda: digits(r.randint(1, 9)),
        lambda: f"{r.randint(1850, 2150)}-{r.randint(1, 14):02d}-{r.randint(1, 33):02d}", lambda: f"{r.randint(1, 33):02d}.{r.randint(1, 14):02d}.{r.randint(1890, 2110)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"+1 {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)} {digits(4)}",
        lambda: ".".join(str(x) for x in r.randint(0, 300, 4)), lambda: f"{digits(2)}.x@mail-{digits(1)}.example.org", lambda: "word", lambda: "é№", lambda: "v1.2.3", lambda: "\n", lambda: ",", lambda: "-",
    ]
    texts = [None, "", "1", "a@b.c"] + ["".join(bits[i]() + [" ", "", ", ", " - "][r.randint(0, 4)] for i in r.randint(0, len(bits), r.randint(1, 30))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x.doc_id: x for x in pii.pii_pseudonyms(docs, "k").collect()}
    for i, t in enumerate(texts):
        assert (rows[i].text, rows[i].kinds) == expected(t, "k"), t
        assert rows[i].n_found == len(rows[i].kinds)
    assert sum(r.n_found for r in rows.values()) > 500
