"""Reading talk inputs: lists of links, metadata, caption tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.scalars import missing


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One document in each file, by a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def link_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of a batch file, trimmed, without blanks and # comments."""
    v = F.trim(F.col(col))
    return lines.select(v.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def distill(info: DataFrame) -> DataFrame:
    """(id, url, title, channel, duration_s, upload_date, language, description, chapters, manual, auto): what is kept of a video's metadata."""
    title = missing(F.col("title"), F.lit("untitled"))
    chapter = lambda c: F.struct(F.coalesce(c["title"], F.lit("")).alias("title"), F.coalesce(c["start_time"], F.lit(0.0)).alias("start_s"), F.coalesce(c["end_time"], F.lit(0.0)).alias("end_s"))
    langs = lambda c: F.sort_array(F.map_keys(F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))))
    return info.select(
        "id", F.coalesce("webpage_url", "url").alias("url"), title.alias("title"), F.coalesce(F.nullif("channel", F.lit("")), "uploader").alias("channel"),
        F.coalesce("duration", F.lit(0.0)).alias("duration_s"), "upload_date", "language", F.substring(F.coalesce("description", F.lit("")), 1, 2000).alias("description"),
        F.transform(F.coalesce("chapters", F.array().cast("array<struct<title:string,start_time:double,end_time:double>>")), chapter).alias("chapters"), langs("subtitles").alias("manual"), langs("automatic_captions").alias("auto"),
    )


def caption_choice(manual: Column, auto: Column, language: Column, preferred: tuple[str, ...] = ("en",)) -> Column:
    """(track, kind): the first that is there of: a preferred manual track (exact, then the first variant), the talk's
    own language by hand, a preferred automatic track, the own language, the first automatic original; else (null, none)."""

    def pick(tracks: Column, want: Column) -> Column:
        exact = F.when(F.array_contains(tracks, want), want)
        variant = F.array_min(F.filter(tracks, lambda t: t.startswith(F.concat(want, F.lit("-")))))
        return F.coalesce(exact, variant)

    def first(tracks: Column) -> list[Column]:
        return [pick(tracks, F.lit(p)) for p in preferred] + [pick(tracks, language)]

    hand, machine = first(manual), first(auto)
    original = F.array_min(F.filter(auto, lambda t: t.endswith("-orig")))
    by_hand, by_machine = F.coalesce(*hand), F.coalesce(*machine, original)
    kind = F.when(by_hand.isNotNull(), F.lit("manual")).when(by_machine.isNotNull(), F.lit("auto")).otherwise(F.lit("none"))
    return F.struct(F.coalesce(by_hand, by_machine).alias("track"), kind.alias("kind"))


def reading_order(boxes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, text): recognised boxes (x, y, text; y upwards) as lines from top to bottom, each from left to right."""
    line = boxes.groupBy(*keys, F.round("y", 2).alias("row")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda b: b["text"]), " ").alias("line"))
    return line.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line")), asc=False), lambda r: r["line"]), "\n").alias("text"))


def recognised(vision: Column, tesseract: Column, vision_there: Column) -> Column:
    """(text, engine): what vision read; else what tesseract did, if anything or if there was no vision; else nothing."""
    text = F.coalesce(F.nullif(vision, F.lit("")), F.nullif(tesseract, F.lit("")), F.lit(""))
    engine = F.when(vision_there & (F.coalesce(vision, F.lit("")) != ""), F.lit("vision")).when((F.coalesce(tesseract, F.lit("")) != "") | (~vision_there & tesseract.isNotNull()), F.lit("tesseract")).otherwise(F.when(vision_there, F.lit("vision")).otherwise(F.lit("none")))
    return F.struct(text.alias("text"), engine.alias("engine"))
