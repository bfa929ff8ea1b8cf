"""What has run, what must run, and what a batch still owes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the order of stages.
STAGES = ("fetch", "slides", "transcript", "align", "synthesize", "verify", "render")


def stage_order(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage)


def latest(runs: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return runs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def should_run(wanted: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """(talk_id, stage, config_hash, run): forced, never done, or done with other parameters."""
    last = latest(runs, ("talk_id", "stage")).select("talk_id", "stage", "status", F.col("config_hash").alias("old"))
    run = F.lit(force) | ~F.coalesce((F.col("status") == "done") & (F.col("old") == F.col("config_hash")), F.lit(False))
    return wanted.join(last, ["talk_id", "stage"], "left").select("talk_id", "stage", "config_hash", run.alias("run"))


def invalidate(runs: DataFrame, changed: DataFrame) -> DataFrame:
    """(talk_id, stage, status): latest states, where all later stages that were done are stale once a stage has run anew."""
    first = changed.groupBy("talk_id").agg(F.min(stage_order(F.col("stage"))).alias("from"))
    now = latest(runs, ("talk_id", "stage")).join(first, "talk_id", "left")
    stale = (F.col("status") == "done") & F.col("from").isNotNull() & (stage_order(F.col("stage")) > F.col("from"))
    return now.select("talk_id", "stage", F.when(stale, F.lit("stale")).otherwise(F.col("status")).alias("status"))


def to_resume(items: DataFrame) -> DataFrame:
    """Items neither done nor failed for good."""
    return items.where((F.coalesce("status", F.lit("")) != "done") & (F.coalesce("error_class", F.lit("")) != "FAILED_FINAL"))


def batch_work(urls: DataFrame, items: DataFrame) -> DataFrame:
    """Links but for those that failed for good; done ones are entered again and find their stages done."""
    return urls.join(items.where("error_class = 'FAILED_FINAL'").select("url"), "url", "left_anti")


def batch_summary(items: DataFrame, *keys: str) -> DataFrame:
    done = F.count_if(F.col("status") == "done")
    return items.groupBy(*keys).agg(F.count("*").alias("total"), done.alias("done"), F.when(done == F.count("*"), 0).otherwise(2).cast("long").alias("exit_code"))


def error_tail(error: Column, most: int) -> Column:
    return F.right(error, F.lit(most))


def marked(log: DataFrame, rows: DataFrame, most_error: int = 1000) -> DataFrame:
    """The log with the rows of stages that have just run: talk_id, stage, status, config_hash, error (its end), seq (after all others
    of the talk and stage). The log only grows; ``latest`` tells where a talk stands."""
    last = log.groupBy("talk_id", "stage").agg(F.max("seq").alias("seq"))
    new = rows.join(last, ["talk_id", "stage"], "left")
    new = new.select("talk_id", "stage", "status", "config_hash", error_tail(F.col("error"), most_error).alias("error"), (F.coalesce("seq", F.lit(0)) + 1).cast("long").alias("seq"))
    return log.select("talk_id", "stage", "status", "config_hash", "error", F.col("seq").cast("long").alias("seq")).unionByName(new)


def planned(only: Column) -> Column:
    """The stages to run, in order: all, or those listed and the first one, which no list leaves out."""
    stages = F.array(*map(F.lit, STAGES))
    return F.when(only.isNull() | (F.size(only) == 0), stages).otherwise(F.filter(stages, lambda s: (s == STAGES[0]) | F.array_contains(only, s)))


def asks_model(only: Column) -> Column:
    """Does a run with this list of stages need a synthesizer?"""
    return F.coalesce(only.isNull() | (F.size(only) == 0) | F.array_contains(only, "synthesize"), F.lit(True))


def existing_run(dirs: DataFrame, col: str = "path") -> DataFrame:
    """(id, path): the least of the run folders id__... of each id."""
    name = F.regexp_extract(col, r"([^/]+?)__[^/]*$", 1)
    return dirs.select(name.alias("id"), F.col(col).alias("path")).where("id <> ''").groupBy("id").agg(F.min("path").alias("path"))
