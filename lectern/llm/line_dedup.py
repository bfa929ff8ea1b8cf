"""Drops lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, fold, two_hashes, unpack, with_row_key
from lectern.sources.tables import materialize


def line_key(line: Column) -> Column:
    return fold(F.trim(line, F.lit(SPACE)))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with the text's frequent lines dropped, plus n_lines and n_dropped.

    A text is split at each \\n; a null or empty text is one empty line. A line's
    key is the line stripped of spaces and \\x09-\\x0D with A-Z in lower case. A
    key of at least min_chars code points that at least min_docs rows hold loses
    all its lines everywhere; the other lines stay in order, joined by \\n.

    Each row counts as a document, repeated rows too; a key repeated within one
    row counts once. A null id is an id like any other. Input columns named
    n_lines or n_dropped are replaced, others kept whatever their names. Ties cannot arise: counts are compared with
    a bound, and lines stand by position. Very long texts and lines are read whole. An empty table gives an empty table.

    Lines are hashed to 128 bits, counted with map-side sums, and only hashes and
    positions move; the text itself moves once, to meet its dropped positions,
    or not at all if these are few enough for the planner to broadcast.
    """
    rows = with_row_key(docs, id_col, text_col)
    lines = F.split("t", "\n", -1)
    h1, h2 = two_hashes(F.col("key"))
    per_row = rows.select(F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key"))
    frequent = (
        per_row.where(F.char_length("key") >= min_chars)
        .groupBy(h1.alias("h1"), h2.alias("h2"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2")
    )
    frequent = materialize(frequent, "frequent-lines")
    placed = rows.select("k1", "k2", F.posexplode(lines).alias("pos", "line")).select("k1", "k2", "pos", line_key(F.col("line")).alias("key"))
    placed = placed.where(F.char_length("key") >= min_chars).select("k1", "k2", "pos", h1.alias("h1"), h2.alias("h2"))
    dropped = placed.join(frequent, ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    dropped = materialize(dropped, "dropped-lines")
    again = F.split(F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")), "\n", -1)
    joined = rows.drop("t").join(dropped, ["k1", "k2"], "left").select("d", again.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    joined = joined.select("d", "lines", "gone", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone").alias("stay"))
    kept = F.when(F.size("gone") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    return unpack(joined, docs.columns, {text_col: kept, "n_lines": F.size("lines").cast("long"), "n_dropped": F.size("gone").cast("long")})
