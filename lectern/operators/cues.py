"""Caption cues: flattening, coverage and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RAW = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"
EPS_MS = 10


def raw_cues(docs: DataFrame, json_col: str = "raw") -> DataFrame:
    """(talk_id, ord, start_ms, end_ms, text) of caption documents; events without start or text go."""
    events = docs.select("talk_id", F.posexplode(F.from_json(json_col, RAW)["events"]).alias("ord", "e"))
    text = F.array_join(F.transform(F.coalesce("e.segs", F.array()), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    end = F.col("e.tStartMs") + F.coalesce("e.dDurationMs", F.lit(0))
    return events.select("talk_id", "ord", F.col("e.tStartMs").alias("start_ms"), end.alias("end_ms"), text.alias("text")).where("start_ms is not null and text <> ''")


def merge_runs(cues: DataFrame) -> DataFrame:
    """(talk_id, seg_idx, start_ms, end_ms, text): a cue that repeats the text before it, and starts before that ends
    (and 10 ms), prolongs it. Order is the file's.

    Within a run of equal texts the greatest end so far is that of the open
    segment, for a later segment begins after all earlier ones have ended; so
    windows give the breaks, without state of our own.
    """
    talk = Window.partitionBy("talk_id").orderBy("ord")
    run = cues.withColumn("run", F.sum(F.when(F.col("text") == F.lag("text").over(talk), 0).otherwise(1)).over(talk))
    before = Window.partitionBy("talk_id", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.max("end_ms").over(before)
    breaks = F.when(upto.isNull() | (F.col("start_ms") >= upto + EPS_MS), 1).otherwise(0)
    island = run.withColumn("breaks", breaks).withColumn("island", F.sum("breaks").over(talk))
    merged = island.groupBy("talk_id", "island").agg(F.min_by("start_ms", "ord").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("text").alias("text"))
    return merged.select("talk_id", (F.row_number().over(Window.partitionBy("talk_id").orderBy("island")) - 1).cast("long").alias("seg_idx"), "start_ms", "end_ms", "text")


def choose_source(talks: DataFrame, tracks: DataFrame, asr: str = "auto") -> DataFrame:
    """(talk_id, source, track, language): speech recognition if forced, or on auto where no track is there; else the
    first track by name; else none. A track's language is what stands before the first dash."""
    first = tracks.groupBy("talk_id").agg(F.min("track").alias("track"))
    joined = talks.select("talk_id").join(first, "talk_id", "left")
    use_asr = F.lit(asr == "force") | (F.lit(asr == "auto") & F.col("track").isNull())
    source = F.when(use_asr, F.lit("asr")).when(F.col("track").isNotNull(), F.lit("captions")).otherwise(F.lit("none"))
    track = F.when(source == "captions", F.col("track"))
    return joined.select("talk_id", source.alias("source"), track.alias("track"), F.substring_index(track, "-", 1).alias("language"))


def spoken_fraction(segments: DataFrame, talks: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """(talk_id, full_minutes, spoken_minutes, spoken_fraction): of the whole minutes of a talk, those that some segment
    overlaps. A segment names its minutes by itself, so there is no join by range."""
    last = segments.groupBy("talk_id").agg(F.max_by("end_ms", "seg_idx").alias("last_end"))
    length = talks.select("talk_id", "duration_ms").join(last, "talk_id", "left")
    length = length.select("talk_id", "last_end", F.floor(F.coalesce(F.nullif("duration_ms", F.lit(0)), "last_end", F.lit(0)) / window_ms).cast("long").alias("full_minutes"))
    lo, hi = F.floor(F.col("start_ms") / window_ms), F.floor((F.col("end_ms") - 1) / window_ms)
    minutes = segments.where("end_ms > start_ms").select("talk_id", F.explode(F.sequence(lo, hi)).alias("minute")).distinct()
    heard = minutes.join(length, "talk_id").where("minute < full_minutes").groupBy("talk_id").agg(F.count("*").alias("spoken_minutes"))
    out = length.join(heard, "talk_id", "left").withColumn("spoken_minutes", F.coalesce("spoken_minutes", F.lit(0).cast("long")))
    share = F.when(F.col("last_end").isNull(), 0.0).when(F.col("full_minutes") == 0, 1.0).otherwise(F.round(F.try_divide("spoken_minutes", "full_minutes"), 3))
    return out.select("talk_id", "full_minutes", "spoken_minutes", share.alias("spoken_fraction"))


def gaps(segments: DataFrame, least_ms: int = 60_000) -> DataFrame:
    """(talk_id, start_ms, end_ms) of silences between neighbouring segments longer than least_ms."""
    w = Window.partitionBy("talk_id").orderBy("seg_idx")
    nexts = segments.select("talk_id", F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(w).alias("end_ms"))
    return nexts.where(F.col("end_ms") - F.col("start_ms") > least_ms)


def coverage(segments: DataFrame, talks: DataFrame, max_gap_ms: int = 600_000) -> DataFrame:
    """(talk_id, ok, spoken_fraction, largest_gap_ms, n_gaps) for each talk; one without segments isn't ok, its gap is its length."""
    w = Window.partitionBy("talk_id").orderBy("seg_idx")
    gap = segments.select("talk_id", (F.lead("start_ms").over(w) - F.col("end_ms")).alias("gap"))
    found = gap.groupBy("talk_id").agg(F.greatest(F.lit(0), F.max("gap")).cast("long").alias("largest"), F.count_if(F.col("gap") > 60_000).alias("n_gaps"), F.count("*").alias("n"))
    out = talks.select("talk_id", "duration_ms").join(spoken_fraction(segments, talks), "talk_id").join(found, "talk_id", "left")
    largest = F.when(F.col("n").isNull(), F.col("duration_ms")).otherwise(F.coalesce("largest", F.lit(0)))
    ok = F.col("n").isNotNull() & (F.col("spoken_fraction") >= 0.5) & (largest <= max_gap_ms)
    return out.select("talk_id", ok.alias("ok"), "spoken_fraction", largest.cast("long").alias("largest_gap_ms"), F.coalesce("n_gaps", F.lit(0)).cast("long").alias("n_gaps"))
