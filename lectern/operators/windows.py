"""Cutting talks into windows, and packing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import overlaps

SPAN = "struct<lo:bigint,hi:bigint,title:string>"


def _span(lo: Column, hi: Column, title: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), title.cast("string").alias("title"))


def _no_title() -> Column:
    return F.lit(None).cast("string")


def word_spans(segs: Column, end: Column, target: int) -> Column:
    """Windows that close at the end of the segment that brings them to ``target`` words."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("words"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(s, x):
        words = s["words"] + x["words"]
        full = words >= target
        return F.struct(
            F.when(full, x["end_ms"]).otherwise(s["lo"]).alias("lo"),
            F.when(full, F.lit(0).cast("long")).otherwise(words).alias("words"),
            F.when(full, F.concat(s["out"], F.array(_span(s["lo"], x["end_ms"], _no_title())))).otherwise(s["out"]).alias("out"),
        )

    def finish(s):
        last = F.element_at(s["out"], -1)
        tail = F.concat(s["out"], F.array(_span(s["lo"], end, _no_title())))
        longer = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(_span(last["lo"], end, _no_title())))
        return F.when(s["lo"] < end - 1, tail).when(F.size(s["out"]) > 0, longer).otherwise(F.array(_span(F.lit(0), end, _no_title())))

    return F.aggregate(segs, start, step, finish)


def chapter_spans(chapters: Column, end: Column) -> Column:
    """A window for each chapter; an open end is the next start, or the talk's end, to which the last one reaches."""

    def one(c, i):
        following = F.try_element_at(chapters, i + 2)["start_ms"]
        own = F.coalesce(F.nullif(c["end_ms"], F.lit(0)), following, end)
        hi = F.when(i == F.size(chapters) - 1, F.greatest(own, end)).otherwise(own)
        return _span(c["start_ms"], hi, F.nullif(c["title"], F.lit("")))

    return F.transform(chapters, one)


def even_spans(end: Column, window_ms: int = 300_000) -> Column:
    n = F.greatest(F.lit(1), F.ceil(end / window_ms).cast("int"))
    cut = lambda i: F.round(i * end / n).cast("long")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _span(cut(i), cut(i + 1), _no_title()))


def words_in(segs: Column, lo: Column, hi: Column) -> Column:
    inside = F.filter(segs, lambda s: overlaps(s["start_ms"], s["end_ms"], lo, hi))
    return F.aggregate(inside, F.lit(0).cast("long"), lambda a, s: a + s["words"])


def split_span(span: Column, segs: Column, target: int) -> Column:
    """A span of over 1.6 times the target words is cut at segment ends into parts of about equal words."""
    lo, hi, title = span["lo"], span["hi"], span["title"]
    total_in = words_in(segs, lo, hi)
    parts = F.ceil(total_in / target).cast("int")
    inside = F.filter(segs, lambda s: (s["start_ms"] >= lo) & (s["start_ms"] < hi))
    total = F.aggregate(inside, F.lit(0).cast("long"), lambda a, s: a + s["words"])
    share = total / parts
    start = F.struct(F.lit(0).cast("long").alias("acc"), share.cast("double").alias("next"), F.array().cast("array<bigint>").alias("cuts"))

    def step(s, x):
        acc = s["acc"] + x["words"]
        previous = F.coalesce(F.try_element_at(s["cuts"], F.lit(-1)), lo)
        cut = (acc >= s["next"]) & (F.size(s["cuts"]) < parts - 1) & (previous < x["end_ms"]) & (x["end_ms"] < hi)
        return F.struct(acc.alias("acc"), F.when(cut, s["next"] + share).otherwise(s["next"]).alias("next"), F.when(cut, F.concat(s["cuts"], F.array(x["end_ms"]))).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.when(total > 0, F.aggregate(inside, start, step, lambda s: s["cuts"])).otherwise(F.array().cast("array<bigint>"))
    edges = F.concat(F.array(lo), cuts, F.array(hi))

    def part(i):
        named = F.when(title.isNotNull() & (F.size(edges) > 2), F.concat(title, F.lit(" ("), (i + 1).cast("string"), F.lit(")"))).otherwise(title)
        return _span(F.element_at(edges, i + 1), F.element_at(edges, i + 2), named)

    return F.when(total_in > 1.6 * target, F.transform(F.sequence(F.lit(0), F.size(edges) - 2), part)).otherwise(F.array(span))


def build_windows(talks: DataFrame, segments: DataFrame, chapters: DataFrame, target_words: int = 2200) -> DataFrame:
    """(talk_id, w_ord, window_id, lo_ms, hi_ms, title, word_count) of each talk.

    By chapters if a talk has two or more; else by words; else, without
    segments, in even parts of at most five minutes. Windows of over 1.6
    times the target are split. A talk is one row with its segments in an array:
    the folds run inside the executors, talk by talk.
    """
    segs = segments.groupBy("talk_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "end_ms", "words"))).alias("segs"))
    chaps = chapters.groupBy("talk_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", "title"))).alias("chaps"))
    rows = talks.select("talk_id", "duration_ms").join(segs, "talk_id", "left").join(chaps, "talk_id", "left")
    last = lambda c: F.coalesce(F.try_element_at(c, F.lit(-1))["end_ms"], F.lit(0))
    rows = rows.select(
        "talk_id",
        F.coalesce("segs", F.array().cast("array<struct<seg_idx:bigint,start_ms:bigint,end_ms:bigint,words:bigint>>")).alias("segs"),
        F.coalesce("chaps", F.array().cast("array<struct<idx:bigint,start_ms:bigint,end_ms:bigint,title:string>>")).alias("chaps"),
        "duration_ms",
    )
    rows = rows.withColumn("end", F.greatest(F.coalesce("duration_ms", F.lit(0)), last("segs"), last("chaps")).cast("long"))
    end = F.col("end")
    spans = F.when(F.size("chaps") >= 2, chapter_spans(F.col("chaps"), end)).when(F.size("segs") > 0, word_spans(F.col("segs"), end, target_words)).otherwise(even_spans(end))
    rows = rows.withColumn("spans", spans)
    final = F.flatten(F.transform("spans", lambda s: split_span(s, F.col("segs"), target_words)))
    out = rows.select("talk_id", "segs", F.posexplode(final).alias("i", "s"))
    return out.select("talk_id", (F.col("i") + 1).cast("long").alias("w_ord"), F.format_string("w%02d", F.col("i") + 1).alias("window_id"), F.col("s.lo").alias("lo_ms"), F.col("s.hi").alias("hi_ms"), F.col("s.title").alias("title"), words_in(F.col("segs"), F.col("s.lo"), F.col("s.hi")).alias("word_count"))


def pack_lines(segments: DataFrame, windows: DataFrame, words: int = 22) -> DataFrame:
    """(talk_id, window_id, line, start_ms, text): the segments that overlap a window, packed into lines of at least so
    many words; a line has the time of its first segment; the rest is the last line, where time 0 shows the window's start."""
    joined = windows.select("talk_id", "window_id", "lo_ms", "hi_ms").join(segments, "talk_id").where(overlaps(F.col("start_ms"), F.col("end_ms"), F.col("lo_ms"), F.col("hi_ms")))
    rows = joined.groupBy("talk_id", "window_id", "lo_ms").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "words", "text"))).alias("segs"))
    line = "struct<start_ms:bigint,text:string>"
    start = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit("").alias("text"), F.array().cast(f"array<{line}>").alias("out"))

    def step(s, x):
        at, n = F.coalesce(s["at"], x["start_ms"]), s["n"] + x["words"]
        text = F.when(s["text"] == "", x["text"]).otherwise(F.concat(s["text"], F.lit(" "), x["text"]))
        full = n >= words
        return F.struct(F.when(~full, at).alias("at"), F.when(full, F.lit(0).cast("long")).otherwise(n).alias("n"), F.when(full, F.lit("")).otherwise(text).alias("text"), F.when(full, F.concat(s["out"], F.array(F.struct(at.alias("start_ms"), text.alias("text"))))).otherwise(s["out"]).alias("out"))

    def finish(s):
        rest = F.struct(F.coalesce(F.nullif(s["at"], F.lit(0)), F.col("lo_ms")).alias("start_ms"), s["text"].alias("text"))
        return F.when(s["text"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(rest)))

    lines = rows.select("talk_id", "window_id", F.posexplode(F.aggregate("segs", start, step, finish)).alias("line", "x"))
    return lines.select("talk_id", "window_id", F.col("line").cast("long").alias("line"), "x.start_ms", "x.text")
