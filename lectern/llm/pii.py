"""Replaces personal numbers and dates by keyed pseudonyms of the same format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import unpack

#: The forms that are looked for, in this order where several fit at one place.
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"
SSN = r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE_ISO = r"(?<![\w.+-])\d{4}-\d{2}-\d{2}(?![\w-])"
DATE_DAY = r"(?<![\w.+-])\d{2}[/.]\d{2}[/.]\d{4}(?![\w-])"
PHONE = r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
IP = r"(?<![\w.+-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
FORMS = {"ssn": SSN, "date_iso": DATE_ISO, "date_day": DATE_DAY, "phone": PHONE, "ip": IP, "card": CARD, "email": EMAIL}
ANY = "|".join(f"(?:{p})" for p in FORMS.values())
#: What is looked for again where a run of numbers was no card: printed groups of a card, and the forms of other kinds.
GROUPED = r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])"
AGAIN = "|".join(f"(?:{p})" for p in (FORMS | {"card": GROUPED}).values())
#: The same behind a replaced string: nothing begins where that ends.
AGAIN_BEHIND = rf"(?!\A)(?:{AGAIN})"

#: The 73,049 days from 1900-01-01 up to 2099-12-31 are 17 * 4297.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297
ROUNDS = 8


def _round(key: Column, tweak: Column, i: Column, x: Column, m: Column) -> Column:
    """A keyed function of x into 0 .. m - 1: 56 bits of SHA-256, reduced."""
    digest = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), x.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), m)


def feistel(a: Column, b: Column, ma: Column, mb: Column, key: Column, tweak: Column) -> Column:
    """A keyed permutation of pairs (a below ma, b below mb), as a struct (a, b).

    Each round adds a keyed function of one half to the other, modulo its size;
    each round can be undone, so different pairs stay different.
    """
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s, i):
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["a"] + _round(key, tweak, i, s["b"], ma), ma)).otherwise(s["a"])
        right = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + _round(key, tweak, i, s["a"], mb), mb))
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _padded(x: Column, width: Column) -> Column:
    return F.lpad(x.cast("string"), width, F.lit("0"))


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order, by those of ``digits``; all other characters stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s, c):
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows these digits."""
    places = F.reverse(F.split(payload, ""))
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(F.transform(doubled, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda s, x: s + x)
    return F.pmod(-total, F.lit(10))


def kind_of(m: Column) -> Column:
    """The kind of a matched string, or null if it is not valid: of a card the Luhn digit, of a date the calendar
    and the years 1900 to 2099, of an address the octets, of a phone or social security number the reserved ranges."""
    fits = lambda p: m.rlike(f"^(?:{p.replace('(?<![A-Za-z0-9._%+-])', '').replace('(?<![' + chr(92) + 'w.+-])', '')})$")
    d = _digits(m)
    n = F.length(d)
    octets = F.split(m, r"\.")
    part = lambda a, k: F.substring(d, a, k)
    day = F.when(fits(DATE_ISO), F.try_to_date(m, "yyyy-MM-dd")).when(fits(DATE_DAY), F.try_to_date(F.concat_ws("-", part(5, 4), part(3, 2), part(1, 2)), "yyyy-MM-dd"))
    in_range = day.isNotNull() & day.between(F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit("2099-12-31")))
    last_ten = F.substring(d, -10, 10)
    return (
        F.when(fits(SSN), F.when(~part(1, 3).isin("000", "666") & (part(1, 1) != "9") & (part(4, 2) != "00") & (part(6, 4) != "0000"), F.lit("ssn")))
        .when(fits(DATE_ISO), F.when(in_range, F.lit("date_iso")))
        .when(fits(DATE_DAY), F.when(in_range, F.lit("date_day")))
        .when(fits(PHONE), F.when((F.substring(last_ten, 1, 1) >= "2") & (F.substring(last_ten, 4, 1) >= "2"), F.lit("phone")))
        .when(fits(IP), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ip")))
        .when(fits(CARD), F.when(luhn_digit(F.substring(d, F.lit(1), n - 1)).cast("string") == F.substring(d, -1, 1), F.lit("card")))
        .when(fits(EMAIL), F.lit("email"))
    )


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of a matched string; a string that is not valid stays as it is."""
    kind, d = kind_of(m), _digits(m)
    n = F.length(d)
    long = lambda x: x.cast("long")
    last_ten = F.substring(d, -10, 10)
    ten = F.pow(F.lit(10.0), F.lit(1.0))
    power = lambda k: F.pow(ten, k).cast("long")

    # A card keeps its length; all digits but the last are permuted, the last follows from them.
    half = F.floor((n - 1) / 2).cast("int")
    c = feistel(long(F.substring(d, F.lit(1), half)), long(F.substring(d, half + 1, n - 1 - half)), power(half), power(n - 1 - half), key, F.concat(F.lit("card"), n.cast("string")))
    body = F.concat(_padded(c["a"], half), _padded(c["b"], n - 1 - half))
    card = _refill(m, F.concat(body, luhn_digit(body).cast("string")))

    # Area codes and exchanges begin with 2 to 9, in the pseudonym too; a country code stays.
    p = feistel(long(F.substring(last_ten, 1, 3)) - 200, long(F.substring(last_ten, 4, 7)) - 2_000_000, F.lit(800), F.lit(8_000_000), key, F.lit("phone"))
    phone = _refill(m, F.concat(F.substring(d, F.lit(1), n - 10), (p["a"] + 200).cast("string"), (p["b"] + 2_000_000).cast("string")))

    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    i = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    ip = F.concat_ws(".", *(x.cast("string") for x in (F.floor(i["a"] / 256), i["a"] % 256, F.floor(i["b"] / 256), i["b"] % 256)))

    # Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
    area = long(F.substring(d, 1, 3))
    s = feistel(area - F.when(area > 666, 2).otherwise(1), (long(F.substring(d, 4, 2)) - 1) * 9999 + long(F.substring(d, 6, 4)) - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    ssn = F.concat_ws("-", _padded(s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), F.lit(3)), _padded(F.floor(s["b"] / 9999) + 1, F.lit(2)), _padded(s["b"] % 9999 + 1, F.lit(4)))

    ymd = F.when(kind == "date_iso", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2)))
    days = F.datediff(F.try_to_date(ymd, "yyyy-MM-dd"), F.to_date(F.lit(FIRST_DAY)))
    t = feistel(F.floor(days / DAYS_B), days % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), key, F.lit("date"))
    new_day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (t["a"] * DAYS_B + t["b"]).cast("int"))
    date = _refill(m, F.when(kind == "date_iso", F.date_format(new_day, "yyyyMMdd")).otherwise(F.date_format(new_day, "ddMMyyyy")))

    # A mail address is no number: its local part becomes a keyed hash, its domain a reserved one.
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))
    return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind.isin("date_iso", "date_day"), date).when(kind == "email", email).otherwise(m)


def _replaced(text: Column, key: Column, forms: str) -> Column:
    """text, in which no run of numbers is a card as a whole, with the given forms replaced: a struct (text, kinds)."""
    new = F.transform(F.regexp_extract_all(text, F.lit(forms), F.lit(0)), lambda m: F.struct(kind_of(m).alias("kind"), pseudonym(m, key).alias("to")))
    pieces = F.zip_with(F.split(text, forms, -1), F.concat(F.transform(new, lambda x: x["to"]), F.array(F.lit(""))), lambda g, x: F.concat(g, x))
    return F.struct(F.array_join(pieces, "").alias("text"), F.filter(F.transform(new, lambda x: x["kind"]), lambda x: x.isNotNull()).alias("kinds"))


def _pieces(gaps: Column, new: Column) -> Column:
    """Structs (text, kind) that make up the text: replaced strings, and between them the rest as it stands (no kind)."""
    piece = "struct<text:string,kind:string>"
    start = F.struct(F.array().cast(f"array<{piece}>").alias("done"), F.lit("").alias("open"))
    rest = lambda x: F.array(F.struct(x.alias("text"), F.lit(None).cast("string").alias("kind")))

    def step(s, x):
        here = F.concat(s["open"], x["gap"])
        kept = F.struct(s["done"].alias("done"), F.concat(here, x["to"]).alias("open"))
        return F.when(x["kind"].isNull(), kept).otherwise(F.struct(F.concat(s["done"], rest(here), F.array(F.struct(x["to"].alias("text"), x["kind"].alias("kind")))).alias("done"), F.lit("").alias("open")))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(new)), new, lambda g, x: F.struct(g.alias("gap"), x["kind"].alias("kind"), x["to"].alias("to")))
    return F.aggregate(pairs, start, step, lambda s: F.concat(s["done"], rest(F.concat(s["open"], F.element_at(gaps, -1)))))


def pii_pseudonyms(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The columns of docs with the text's personal data replaced, plus n_found and kinds (of each replacement, in order).

    Card, social security and phone numbers, dates and network addresses that
    are valid go through a keyed Feistel permutation of the valid values of
    their format: separators, length, country codes and check digits hold, equal
    values get equal pseudonyms in all documents, different values different ones.
    A date or a number written in two formats keeps its link in each of them. Mail
    addresses, which have no such format, become keyed hashes. Strings that
    only look like one of these stay. Where numbers stand next to each other and are no card as a whole,
    the other forms and the printed groups of a card are looked for among them.

    A null text stays null, an empty one empty, with none found; very long texts are
    handled whole. Where several forms fit at one place, the first of FORMS counts. Repeated rows
    are rewritten each, to the same text; an empty table gives no rows. Input columns n_found and kinds are
    replaced, others kept whatever their names. Rows are rewritten where they are: there is no
    shuffle and no state, and any lost task can run again with the same result. The key
    is a parameter; who has it can undo the permutation.
    """
    k = F.lit(key)
    t = F.col(f"`{text_col}`")
    found = F.when(t.rlike(r"[0-9]") | t.contains("@"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    held = docs.select(F.struct("*").alias("d"), F.coalesce(found, F.array().cast("array<string>")).alias("m"))
    new = F.transform("m", lambda m: F.struct(kind_of(m).alias("kind"), pseudonym(m, k).alias("to")))
    held = held.select("d", F.when(F.size("m") > 0, new).alias("new"))
    gaps = F.split(F.col(f"d.`{text_col}`"), ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.transform("new", lambda x: x["to"]), F.array(F.lit(""))), lambda g, x: F.concat(g, x)), "")
    kinds = F.filter(F.transform("new", lambda x: x["kind"]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    plain = F.struct(joined.alias("text"), kinds.alias("kinds"))
    asis = lambda x: F.struct(x["text"].alias("text"), F.array(x["kind"]).alias("kinds"))
    pieces = F.transform(_pieces(gaps, F.col("new")), lambda x, i: F.when(x["kind"].isNotNull(), asis(x)).when(i == 0, _replaced(x["text"], k, AGAIN)).otherwise(_replaced(x["text"], k, AGAIN_BEHIND)))
    again = F.struct(F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("text"), F.flatten(F.transform("pieces", lambda x: x["kinds"])).alias("kinds"))
    held = held.withColumn("pieces", F.when(F.exists("new", lambda x: x["kind"].isNull()), pieces))
    held = held.withColumn("out", F.when(F.col("pieces").isNotNull(), again).when(F.col("new").isNotNull(), plain))
    text, kinds = F.when(F.col("new").isNull(), F.col(f"d.`{text_col}`")).otherwise(F.col("out.text")), F.col("out.kinds")
    kinds = F.coalesce(kinds, none)
    return unpack(held, docs.columns, {text_col: text, "kinds": kinds, "n_found": F.size(kinds).cast("long")})
