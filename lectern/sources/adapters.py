"""The driver's tables in the shapes of talks. Every rule is plain arithmetic, so that SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.sources.tables import table


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations as segments: 400 ms a word, a pause before each turn."""
    t = table(spark, sf_dir, "conversations")
    lines = t.select(F.col("conv_id").alias("talk_id"), "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.withColumn("words", words(F.col("text"))).where("words > 0")
    first = F.row_number().over(Window.partitionBy("talk_id", "turn").orderBy("line")) == 1
    took = F.when(first, (F.col("turn") * 7 % 5) * 20_000).otherwise(0) + 400 * F.col("words")
    talk = Window.partitionBy("talk_id").orderBy("turn", "line")
    end = F.sum("took").over(talk)
    return lines.withColumn("took", took).select("talk_id", (F.row_number().over(talk) - 1).cast("long").alias("seg_idx"), "turn", (end - 400 * F.col("words")).cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), "words", "text")


def repeated_cues(segs: DataFrame) -> DataFrame:
    """Each third segment comes twice, the second time half its length later, as rolling captions do."""
    half = F.floor((F.col("end_ms") - F.col("start_ms")) / 2)
    base = segs.select("talk_id", (F.col("seg_idx") * 2).alias("ord"), "start_ms", "end_ms", "text")
    again = segs.where("seg_idx % 3 = 0").select("talk_id", (F.col("seg_idx") * 2 + 1).alias("ord"), (F.col("start_ms") + half).alias("start_ms"), (F.col("end_ms") + half).alias("end_ms"), "text")
    return base.unionByName(again)


def chapters(segs: DataFrame, sf_dir: str) -> DataFrame:
    """A chapter for each turn, its role the title, the last one open."""
    roles = table(segs.sparkSession, sf_dir, "conversations").select(F.col("conv_id").alias("talk_id"), "turn", "role")
    per = segs.groupBy("talk_id", "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).join(roles, ["talk_id", "turn"])
    w = Window.partitionBy("talk_id").orderBy("turn")
    is_last = F.lead("turn").over(w).isNull()
    return per.select("talk_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("role").alias("title"), "start_ms", F.when(is_last, F.lit(0)).otherwise(F.col("end_ms")).cast("long").alias("end_ms"))


def talks(segs: DataFrame) -> DataFrame:
    return segs.groupBy("talk_id").agg(F.max("end_ms").alias("duration_ms"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as slides of talks: 20 s each in order of id, each third shown again for 10 s, 200 s later."""
    n = table(spark, sf_dir, "conversations").agg(F.countDistinct("conv_id").alias("n"))
    d = table(spark, sf_dir, "documents").join(F.broadcast(n))
    d = d.select((F.col("doc_id") % F.col("n")).alias("talk_id"), F.col("doc_id").alias("slide_id"), F.col("text").alias("ocr_text"))
    idx = F.row_number().over(Window.partitionBy("talk_id").orderBy("slide_id")) - 1
    d = d.withColumn("idx", idx.cast("long"))
    at = F.col("idx") * 20_000
    span = lambda lo, hi: F.struct(lo.cast("long").alias("start_ms"), hi.cast("long").alias("end_ms"))
    shown = F.when(F.col("idx") % 3 == 2, F.array(span(at, at + 20_000), span(at + 200_000, at + 210_000))).otherwise(F.array(span(at, at + 20_000)))
    return d.select("talk_id", "slide_id", "idx", at.cast("long").alias("first_seen_ms"), shown.alias("spans"), F.when(F.col("idx") % 3 == 2, 30_000).otherwise(20_000).cast("long").alias("on_screen_ms"), "ocr_text")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quote_id, kind, quote) from benchmark items: first eight words, the same with two words left out in the
    middle and an ellipsis, with a word changed, and with digits put in."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    b = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 12)
    kinds = {
        "exact": F.array_join(F.slice("w", 1, 8), " "),
        "ellipsis": F.concat(F.array_join(F.slice("w", 1, 4), " "), F.lit(" … "), F.array_join(F.slice("w", 7, 4), " ")),
        "fuzzy": F.concat(F.array_join(F.slice("w", 1, 5), " "), F.lit(" "), F.element_at("w", 6), F.lit("x "), F.array_join(F.slice("w", 7, 4), " ")),
        "digits": F.concat(F.array_join(F.slice("w", 1, 5), " "), F.lit(" 40 "), F.array_join(F.slice("w", 7, 4), " ")),
    }
    parts = None
    for i, (kind, q) in enumerate(kinds.items()):
        part = b.select((F.col("item_id") * 4 + i).alias("quote_id"), F.lit(kind).alias("kind"), q.alias("quote"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document a talk, each line that isn't blank a segment, 400 ms a word."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("talk_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    d = d.withColumn("words", words(F.col("text"))).where("words > 0")
    w = Window.partitionBy("talk_id").orderBy("line")
    end = F.sum(400 * F.col("words")).over(w)
    return d.select("talk_id", (F.row_number().over(w) - 1).cast("long").alias("seg_idx"), (end - 400 * F.col("words")).cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), "words", "text")


def frames(spark: SparkSession, sf_dir: str, held: int = 5) -> DataFrame:
    """(talk_id, i, bits): each embedding of a label held for five samples; bit j: is element j + 1 greater than element j?"""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("talk_id"), "vec_id", "embedding")
    at = F.row_number().over(Window.partitionBy("talk_id").orderBy("vec_id")) - 1
    bits = F.zip_with(F.slice("embedding", 2, F.size("embedding") - 1), F.slice("embedding", F.lit(1), F.size("embedding") - 1), lambda x, y: x > y)
    e = e.select("talk_id", at.alias("at"), bits.alias("bits"))
    return e.select("talk_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(held - 1)), lambda j: F.col("at") * held + j)).alias("i"), "bits").select("talk_id", F.col("i").cast("long").alias("i"), "bits")
