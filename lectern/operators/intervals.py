"""Joins and unions of time spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import overlaps


def bucketed_overlap_join(a: DataFrame, b: DataFrame, width_ms: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of a (a_start, a_end) and b (b_start, b_end) that overlap, and agree in keys.

    Both go into the buckets that they touch; a pair comes out of the bucket
    alone where the later of the two starts. So it is an equi join, which deals
    out long talks too, and no nested loop.
    """
    into = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width_ms), F.floor(F.greatest(F.col(lo), F.col(hi) - 1) / width_ms)))
    left = a.withColumn("bucket", into("a_start", "a_end"))
    right = b.withColumn("bucket", into("b_start", "b_end"))
    joined = left.join(right, [*keys, "bucket"]).where(overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    return joined.where(F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / width_ms)).drop("bucket")


def overlap_sums(slides: DataFrame, windows: DataFrame, width_ms: int = 600_000) -> DataFrame:
    """(talk_id, slide_id, window_id, w_ord, overlap_ms) for each slide and window with time in common."""
    spans = slides.select("talk_id", "slide_id", F.explode("spans").alias("s")).select("talk_id", "slide_id", F.col("s.start_ms").alias("a_start"), F.col("s.end_ms").alias("a_end"))
    wins = windows.select("talk_id", "window_id", "w_ord", F.col("lo_ms").alias("b_start"), F.col("hi_ms").alias("b_end"))
    joined = bucketed_overlap_join(spans, wins, width_ms, ("talk_id",))
    part = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return joined.groupBy("talk_id", "slide_id", "window_id", "w_ord").agg(F.sum(part).alias("overlap_ms"))


def assign_slides(slides: DataFrame, windows: DataFrame, min_context_ms: int = 8000) -> DataFrame:
    """(talk_id, slide_id, window_id, w_ord, role, overlap_ms).

    A slide is primary in the window that it overlaps most, the earliest of
    equals; one that overlaps none, in the window whose middle is nearest to its
    first sight. It is context in all others with at least 8 s, or 15 % of its time.
    """
    sums = overlap_sums(slides, windows)
    best = sums.groupBy("talk_id", "slide_id").agg(F.min_by("w_ord", F.struct(-F.col("overlap_ms"), F.col("w_ord"))).alias("best"))
    lost = slides.select("talk_id", "slide_id", "first_seen_ms").join(best, ["talk_id", "slide_id"], "left_anti")
    far = F.abs(2 * F.col("first_seen_ms") - F.col("lo_ms") - F.col("hi_ms"))
    near = lost.join(windows, "talk_id").groupBy("talk_id", "slide_id").agg(F.min_by("w_ord", F.struct(far.alias("far"), F.col("w_ord"))).alias("best"))
    homes = best.unionByName(near)
    primary = homes.select("talk_id", "slide_id", F.col("best").alias("w_ord"), F.lit("primary").alias("role"))
    floor = F.greatest(F.lit(min_context_ms), F.col("on_screen_ms") * 0.15)
    context = sums.join(homes, ["talk_id", "slide_id"]).join(slides.select("talk_id", "slide_id", "on_screen_ms"), ["talk_id", "slide_id"])
    context = context.where((F.col("w_ord") != F.col("best")) & (F.col("overlap_ms") >= floor)).select("talk_id", "slide_id", "w_ord", F.lit("context").alias("role"))
    both = primary.unionByName(context).join(sums.select("talk_id", "slide_id", "w_ord", "overlap_ms"), ["talk_id", "slide_id", "w_ord"], "left")
    return both.join(windows.select("talk_id", "w_ord", "window_id"), ["talk_id", "w_ord"]).select("talk_id", "slide_id", "window_id", "w_ord", "role", F.coalesce("overlap_ms", F.lit(0)).cast("long").alias("overlap_ms"))


def window_slides(assigned: DataFrame, slides: DataFrame) -> DataFrame:
    """(talk_id, window_id, role, slide_ids): ids in order of first sight."""
    seen = assigned.join(slides.select("talk_id", "slide_id", "first_seen_ms", "idx"), ["talk_id", "slide_id"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("first_seen_ms", "idx", "slide_id"))), lambda x: x["slide_id"])
    return seen.groupBy("talk_id", "window_id", "role").agg(ids.alias("slide_ids"))


def fuse(spans: DataFrame, keys: tuple[str, ...], eps_ms: int = 1) -> DataFrame:
    """(keys, start_ms, end_ms): spans that overlap or touch, by a millisecond, made one."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    upto = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(upto.isNull() | (F.col("start_ms") > upto + eps_ms), 1).otherwise(0)
    marked = spans.select(*keys, "start_ms", "end_ms", new.alias("new")).withColumn("island", F.sum("new").over(order))
    return marked.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def on_screen(fused: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, on_screen_ms, times_returned) of fused spans."""
    return fused.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("on_screen_ms"), (F.count("*") - 1).alias("times_returned"))


def window_words(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """(talk_id, window_id, word_count): a segment across a boundary counts on both sides."""
    a = segments.select("talk_id", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"), "words")
    b = windows.select("talk_id", "window_id", F.col("lo_ms").alias("b_start"), F.col("hi_ms").alias("b_end"))
    return bucketed_overlap_join(a, b, 600_000, ("talk_id",)).groupBy("talk_id", "window_id").agg(F.sum("words").alias("word_count"))
