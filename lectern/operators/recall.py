"""Hard tokens of a transcript, and how many of them a brief has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What counts as a hard token, on raw text.
HARD = {
    "unit": r"\b\d+(?:\.\d+)?\s?(?:%|ms|s|sec|min|hours?|fps|gb|mb|kb|tb|k|b|x|×)\b",
    "version": r"\bv?\d+\.\d+(?:\.\d+)*\b",
    "acronym": r"\b[A-Z][A-Z0-9]{1,5}\b",
    "flag": r"--[a-z][\w-]+",
    "identifier": r"\b\w+(?:[-_]\w+)+\b",
}
#: Classes and boundaries are those of Unicode; units are found in either case.
FLAGS = {"unit": "(?iU)"}


def hard_tokens(texts: DataFrame, key: str = "talk_id", col: str = "text") -> DataFrame:
    """(key, family, token) of every match of every family."""
    found = F.array(*(F.struct(F.lit(f).alias("family"), F.regexp_extract_all(F.col(col), F.lit(FLAGS.get(f, "(?U)") + p), F.lit(0)).alias("m")) for f, p in HARD.items()))
    each = texts.select(key, F.explode(found).alias("x")).select(key, "x.family", F.explode("x.m").alias("token"))
    return each.withColumn("token", F.trim("token"))


def eligible(texts: DataFrame, key: str = "talk_id", col: str = "text", min_count: int = 2) -> DataFrame:
    """(key, token, n): tokens of two characters or more that come at least min_count times."""
    return hard_tokens(texts, key, col).groupBy(key, "token").agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & (F.length("token") >= 2))


def recall(texts: DataFrame, briefs: DataFrame, key: str = "talk_id", col: str = "text", brief: str = "brief", min_count: int = 2, most: int = 20) -> DataFrame:
    """(key, recall, missing): the share of eligible tokens that the brief has, in either case, null if there are
    none; and the most frequent missing ones, of equals the least."""
    tokens = eligible(texts, key, col, min_count)
    held = tokens.join(briefs.select(key, F.lower(brief).alias("b")), key, "left")
    held = held.withColumn("is_missing", ~F.coalesce(F.contains(F.col("b"), F.lower("token")), F.lit(False))).drop("b")
    rank = Window.partitionBy(key, "is_missing").orderBy(F.desc("n"), "token")
    held = held.withColumn("r", F.row_number().over(rank))
    share = F.round(1 - F.count_if("is_missing") / F.count("*"), 3)
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_missing") & (F.col("r") <= most), F.struct("r", "token")))), lambda x: x["token"])
    got = held.groupBy(key).agg(share.alias("recall"), top.alias("missing"))
    return texts.select(key).distinct().join(got, key, "left").select(key, "recall", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
