"""Exact duplicates by recipes of content-defined chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import two_hashes, with_row_key, without
from lectern.sources.tables import materialize

#: A chunk ends after a sentence's end that has min to max characters before it, or else after max characters: cuts follow the content, not the offset.
CHUNK = r"(?s).{{{low},{high}}}?(?:[.!?\n]\s|[\u3002\uFF01\uFF1F\uFF61\u0964])|.{{1,{high}}}"


def chunks(text: Column, low: int = 512, high: int = 4096) -> Column:
    """The text cut into content-defined chunks; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK.format(low=low, high=high)), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 512, high: int = 4096, hashes: Callable[..., list[Column]] = two_hashes) -> DataFrame:
    """One row (id_col, keep_id, group_size, kept, text_sha256, k1, k2, repeats) per row of docs.

    Rows with identical texts (null counts as empty) form a group; keep_id is its
    largest id. Each text becomes a recipe, the ordered list of its chunks'
    identifiers, and recipes are what is compared. An identifier is a 128-bit
    hash; the chunks behind each hash are compared as text, and chunks that share
    a hash get different ordinals, so equal recipes mean equal texts. Chunk text
    moves once, after equal chunks have met map-side; texts never move.

    Rows that agree in id and text are repeats of one document: exactly one of
    the repeats of the id that stays is marked kept. Null ids lose against any
    other; a group of null ids keeps one row. k1 and k2 are the key of
    ``with_row_key``; repeats counts its rows. An empty table gives no rows. Very long texts become
    long recipes, and are never cut. Other columns are not read, so their names cannot clash.
    """
    rows = with_row_key(docs, id_col, text_col).select(F.col(f"d.`{id_col}`").alias("id"), "k1", "k2", "t")
    names = ("h1", "h2")
    cut = chunks(F.col("t"), low, high)
    each = rows.select(F.explode(cut).alias("chunk")).select(*(h.alias(n) for h, n in zip(hashes(F.col("chunk")), names)), "chunk")
    stored = each.distinct()
    shared = stored.groupBy(*names).agg(F.count("*").alias("n"), F.min(F.struct("chunk")).alias("least"))
    shared = materialize(shared.where("n > 1").select(*names), "shared-hashes")
    plain = lambda c: F.struct(*(h.alias(n) for h, n in zip(hashes(c), names)), F.lit(0).alias("ord"))
    sha = F.sha2("t", 256).alias("text_sha256")
    if shared.isEmpty():
        recipes = rows.select("id", "k1", "k2", sha, F.transform(cut, plain).alias("recipe"))
    else:
        recipes = _told_apart(rows, each, shared, names, cut, sha, hashes)
    recipes = recipes.groupBy("recipe", "id", "k1", "k2", "text_sha256").agg(F.count("*").alias("repeats"))
    recipes = materialize(recipes, "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.sum("repeats").alias("group_size"), F.min(F.when(F.col("id").isNull(), F.struct("k1", "k2"))).alias("of_null"))
    groups = materialize(groups, "recipe-groups")
    stays = F.when(F.col("keep_id").isNull(), F.struct("k1", "k2") == F.col("of_null")).otherwise(F.col("id").eqNullSafe(F.col("keep_id")))
    found = recipes.join(groups, "recipe").select("id", "k1", "k2", "repeats", "text_sha256", "keep_id", "group_size", stays.alias("stays"), F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "k1", "k2", "repeats")


def one_of_each_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for exact duplicates: of each text the row of the largest id stays, one of it if it is repeated."""
    found = exact_dedup(docs, id_col, text_col)
    keys = found.groupBy("k1", "k2").agg(F.max("kept").alias("stays"), F.max("repeats").alias("times"), F.max("group_size").alias("held"))
    return without(docs, materialize(keys.where("held > 1").drop("held"), "copies"), id_col, text_col)


def _told_apart(rows: DataFrame, each: DataFrame, shared: DataFrame, names, cut: Column, sha: Column, hashes) -> DataFrame:
    """Recipes where some hashes stand for several chunks: those chunks carry their rank among them."""
    listed = each.join(shared, list(names), "left_semi").distinct()
    listed = listed.groupBy(*names).agg(F.array_sort(F.collect_list("chunk")).alias("texts"))
    listed = materialize(listed, "shared-chunks")
    placed = rows.select("id", "k1", "k2", sha, F.posexplode_outer(cut).alias("pos", "chunk")).select("*", *(h.alias(n) for h, n in zip(hashes(F.col("chunk")), names)))
    told = placed.join(listed, list(names), "left")
    step = F.struct("pos", *names, F.coalesce(F.array_position("texts", F.col("chunk")).cast("int") - 1, F.lit(0)).alias("ord"))
    one = told.dropDuplicates(["id", "k1", "k2", "pos"])
    lists = one.groupBy("id", "k1", "k2", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), step))).alias("steps"))
    lists = lists.select("id", "k1", "k2", "text_sha256", F.transform("steps", lambda s: F.struct(*(s[n].alias(n) for n in (*names, "ord")))).alias("recipe"))
    times = rows.groupBy("k1", "k2").agg(F.count("*").alias("times"))
    return lists.join(times, ["k1", "k2"]).select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_")).drop("times", "_")
