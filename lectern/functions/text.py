"""Tokens of texts: by built-in functions, and exactly as Unicode asks, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = r"[^\p{L}\p{N}]+"
#: All that str.isalnum() denies.
_OTHERS = re.compile(r"[\W_]+")


def fast_normal(text: Column) -> Column:
    """Lower case, letters and digits, single spaces. Differs from the exact form for ß, ligatures and the like."""
    return F.trim(F.regexp_replace(F.lower(text), _WORDS, " "))


def fast_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), _WORDS, " "), " "), lambda x: x != "")


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens of at least two characters."""
    return F.array_distinct(F.filter(fast_tokens(text), lambda x: F.length(x) >= 2))


def words(text: Column) -> Column:
    """How many runs without white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")).cast("long")


def digit_runs(normal: Column) -> Column:
    return F.sort_array(F.regexp_extract_all(normal, F.lit(r"\p{Nd}+"), F.lit(0)))


def same_digits(a: Column, b: Column) -> Column:
    """The gate of near matches: both sides hold the same digit strings, in any order."""
    return digit_runs(a) == digit_runs(b)


def normal(text: str) -> str:
    """Compatibility form, case folded, everything but letters and digits a space."""
    return " ".join(_OTHERS.sub(" ", unicodedata.normalize("NFKC", text).casefold()).split())


@F.arrow_udf(T.ArrayType(T.StringType()))
def exact_tokens(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normal(t).split() for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def exact_normal(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normal(t) for t in text.to_pylist()], pa.string())


def token_line(text: Column, tokens: Callable[..., Column] = exact_tokens) -> Column:
    """A text's tokens in one string, a space between them; empty where there are none. Tokens hold no white space."""
    of = {fast_tokens: fast_normal, exact_tokens: exact_normal}.get(tokens)
    return F.coalesce(of(text) if of else F.array_join(tokens(text), " "), F.lit(""))


@F.arrow_udf(T.StringType())
def decomposed_ascii(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in text.to_pylist()], pa.string())


def slug_exact(text: Column, most: int = 48) -> Column:
    from lectern.functions.scalars import slug

    return slug(decomposed_ascii(text), most)
