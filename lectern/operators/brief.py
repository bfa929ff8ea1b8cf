"""From windows to a verified brief: answers, an overview, six streams of quotes, stamps, totals, report rows, and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import first_line, hms
from lectern.functions.text import fast_tokens
from lectern.operators import anchor, digest, recall
from lectern.sources.tables import materialize

#: The streams of quotes of a digest, in their order.
STREAMS = ("takeaways", "glossary", "chapters", "numbers", "slides", "windows")


def first_words(text: Column, most: int = 6) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda x: x != ""), 1, most), " ")


def answers(windows: DataFrame, lines: DataFrame, assigned: DataFrame, slides: DataFrame) -> DataFrame:
    """(talk_id, w_ord, window_id, title, quote, slide_ids): what the default synthesizer says of each window.

    The quote are the first six words of the window's first line, null without a line; the slides are the
    window's primary ones in order of first sight.
    """
    said = lines.groupBy("talk_id", "window_id").agg(first_words(F.min_by("text", "line")).alias("quote"))
    shown = assigned.where("role = 'primary'").join(slides.select("talk_id", "slide_id", "first_seen_ms", "idx"), ["talk_id", "slide_id"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("first_seen_ms", "idx", "slide_id"))), lambda x: x["slide_id"])
    shown = shown.groupBy("talk_id", "window_id").agg(ids.alias("slide_ids"))
    out = windows.select("talk_id", "w_ord", "window_id", "title").join(said, ["talk_id", "window_id"], "left").join(shown, ["talk_id", "window_id"], "left")
    return out.select("talk_id", "w_ord", "window_id", "title", "quote", F.coalesce("slide_ids", F.array().cast("array<long>")).alias("slide_ids"))


def slide_entries(answered: DataFrame, slides: DataFrame) -> DataFrame:
    """(talk_id, slide_id, w_ord, window_id, heading, what_it_shows, significance, quote): an entry for each slide of an answer."""
    each = answered.select("talk_id", "w_ord", "window_id", "quote", F.explode("slide_ids").alias("slide_id"))
    named = first_line(F.col("ocr_text"), F.concat(F.lit("Slide "), F.col("idx").cast("string")))
    shown = slides.select("talk_id", "slide_id", named.alias("heading"))
    return each.join(shown, ["talk_id", "slide_id"]).select("talk_id", "slide_id", "w_ord", "window_id", "heading", F.lit("").alias("what_it_shows"), F.lit("").alias("significance"), "quote")


def window_points(answered: DataFrame) -> DataFrame:
    """(talk_id, w_ord, window_id, quote): a point for each window without slides."""
    return answered.where(F.size("slide_ids") == 0).select("talk_id", "w_ord", "window_id", "quote")


def outline(windows: DataFrame) -> DataFrame:
    """(talk_id, outline): id, time and title of each window, a line each."""
    line = F.rtrim(F.concat("window_id", F.lit(" ["), hms(F.col("lo_ms")), F.lit("] "), F.coalesce("title", F.lit(""))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("w_ord", line.alias("line")))), lambda x: x["line"])
    return windows.groupBy("talk_id").agg(F.array_join(lines, "\n").alias("outline"))


def overview(answered: DataFrame) -> DataFrame:
    """(talk_id, takeaways, glossary, chapters, numbers): the reduce step over a talk's answers. The takeaway quotes the first
    answer that has a quote, each window is a chapter with its answer's quote."""
    order = F.array_sort(F.collect_list(F.struct("w_ord", "window_id", "title", "quote")))
    rows = answered.groupBy("talk_id").agg(order.alias("a"))
    quoted = F.filter("a", lambda x: F.coalesce(x["quote"], F.lit("")) != "")
    point = "array<struct<text:string,quote:string>>"
    take = F.transform(F.slice(quoted, 1, 1), lambda x: F.struct(F.concat(F.lit("See "), x["window_id"]).alias("text"), x["quote"].alias("quote")))
    chapters = F.transform("a", lambda x: F.struct(F.coalesce(x["title"], x["window_id"]).alias("text"), x["quote"].alias("quote")))
    none = F.array().cast(point)
    return rows.select("talk_id", take.cast(point).alias("takeaways"), none.alias("glossary"), chapters.cast(point).alias("chapters"), none.alias("numbers"))


def streams(over: DataFrame, entries: DataFrame, points: DataFrame) -> DataFrame:
    """(talk_id, path, ord, quote): the six streams of a digest's quotes; empty and null ones are in it too."""
    parts = {p: over.select("talk_id", F.posexplode(p).alias("ord", "x")).select("talk_id", F.col("ord").cast("long").alias("ord"), "x.quote") for p in STREAMS[:4]}
    parts["slides"] = entries.select("talk_id", F.col("slide_id").cast("long").alias("ord"), "quote")
    parts["windows"] = points.select("talk_id", F.col("w_ord").cast("long").alias("ord"), "quote")
    return digest.quote_union(**parts)


def stamped(said: DataFrame, segments: DataFrame, slides: DataFrame, tokens=fast_tokens) -> DataFrame:
    """``streams`` with t, grounded and source: each quote where it was found; equal quotes of a talk are looked up once."""
    said = materialize(said.withColumn("quote_id", F.xxhash64("talk_id", "quote")), "said")
    ask = said.where(F.coalesce("quote", F.lit("")) != "").select("quote_id", "talk_id", "quote").distinct()
    found = anchor.anchor(ask, segments, slides, tokens).select("quote_id", "t", "grounded", "source")
    return said.join(found, "quote_id", "left").select("talk_id", "path", "ord", "quote", "t", F.coalesce("grounded", F.lit(False)).alias("grounded"), "source")


def chapter_starts(marked: DataFrame) -> DataFrame:
    """(talk_id, ord, quote, start_ms): a chapter starts where its quote was said; null where that wasn't found."""
    return marked.where("path = 'chapters'").select("talk_id", "ord", "quote", F.col("t").alias("start_ms"))


def brief_text(marked: DataFrame, entries: DataFrame) -> DataFrame:
    """(talk_id, brief): all of a digest as one JSON text, its nulls kept: names, stamps and quotes count as said in the brief."""
    points = marked.groupBy("talk_id").agg(F.array_sort(F.collect_list(F.struct("path", "ord", "quote", "t", "grounded", "source"))).alias("points"))
    heads = entries.groupBy("talk_id").agg(F.array_sort(F.collect_list(F.struct("slide_id", "heading"))).alias("slides"))
    both = points.join(heads, "talk_id", "left")
    return both.select("talk_id", F.to_json(F.struct("points", "slides"), {"ignoreNullFields": "false"}).alias("brief"))


def verified(marked: DataFrame, entries: DataFrame, segments: DataFrame) -> DataFrame:
    """(talk_id, quotes_total, quotes_grounded, token_recall, missing, weak)."""
    text = segments.groupBy("talk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    return digest.verification(marked, recall.recall(text, brief_text(marked, entries)), "talk_id")


def calls(answered: DataFrame, slides: DataFrame, most_images: int = 24) -> DataFrame:
    """(talk_id, label, images, cost): the audit of a brief's calls: one for each window, with the images that go along, and one
    to reduce them."""
    routes = digest.routed(slides.select("talk_id", "slide_id", "first_seen_ms", "on_screen_ms", "ocr_text"))
    each = answered.select("talk_id", "window_id", F.explode("slide_ids").alias("slide_id")).join(routes, ["talk_id", "slide_id"])
    images = digest.image_budget(each, most_images).where("route = 'image'").groupBy("talk_id", "window_id").agg(F.count("*").alias("images"))
    mapped = answered.select("talk_id", "window_id").join(images, ["talk_id", "window_id"], "left")
    mapped = mapped.select("talk_id", F.concat(F.lit("map_"), "window_id").alias("label"), F.coalesce("images", F.lit(0).cast("long")).alias("images"))
    reduced = answered.select("talk_id").distinct().select("talk_id", F.lit("reduce").alias("label"), F.lit(0).cast("long").alias("images"))
    return mapped.unionByName(reduced).withColumn("cost", F.lit(0.0))


def write_documents(df: DataFrame, path: str, kind: str = "json") -> None:
    """Overwrites a folder with df, as JSON with its nulls or as Parquet."""
    writer = df.write.mode("overwrite")
    if kind == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)
