"""Streams give what batches give."""

import numpy as np
from pyspark.sql import functions as F

from lectern.operators.cues import merge_runs
from lectern.operators.frames import candidates
from lectern.operators.lineage import latest
from lectern.streaming.cues import merge_stream, spoken_minutes
from lectern.streaming.runs import key_frame_stream, log_stream, read_log

CUES = "talk_id long, ord long, start_ms long, end_ms long, text string"
ROWS = [(1, 0, 0, 2000, "a"), (1, 1, 1000, 3000, "a"), (1, 2, 3000, 4000, "b"), (1, 3, 9000, 9500, "b"), (2, 0, 0, 10, "x"), (2, 1, 500, 600, "y")]


def test_merge_stream(spark, tmp_path):
    end = [(1, 9, None, None, None)]
    for i, part in enumerate((ROWS[:2], ROWS[2:3] + ROWS[4:5], ROWS[3:4] + ROWS[5:], end)):
        spark.createDataFrame(part, CUES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema(CUES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    q = merge_stream(stream).writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {tuple(r) for r in spark.table("merged").collect()}
    want = {tuple(r) for r in merge_runs(spark.createDataFrame(ROWS, CUES)).collect()}
    still_open = {(2, 1, 500, 600, "y")}
    assert got == want - still_open and still_open <= want


def test_spoken_minutes(spark, tmp_path):
    rows = spark.range(120).select((F.col("id") % 2).alias("talk_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = spoken_minutes(stream).writeStream.format("memory").queryName("minutes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(r.cues for r in spark.table("minutes").collect()) == [30, 30, 30, 30]


def test_stage_log_holds_each_result_once(spark, tmp_path):
    kind = "talk_id long, stage string, status string, config_hash string, error string"
    parts = [[(1, "fetch", "done", "h", None), (2, "fetch", "failed", "h", "x" * 50)], [(1, "slides", "done", "h", None), (2, "fetch", "done", "h", None), (2, "fetch", "failed", "h", "again")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    log, stream = str(tmp_path / "log"), spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    for run in range(2):  # without its checkpoint the second run does every batch again
        q = log_stream(stream, log, 8).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert read_log(spark, log).count() == 5
    last = {(r.talk_id, r.stage): (r.status, r.error) for r in latest(read_log(spark, log), ("talk_id", "stage")).collect()}
    assert last == {(1, "fetch"): ("done", None), (1, "slides"): ("done", None), (2, "fetch"): ("failed", "again")}


def test_key_frame_stream(spark, tmp_path):
    r = np.random.RandomState(3)
    shown = r.rand(4, 40) < 0.5
    rows = [(talk, i, [bool(x) for x in shown[(i // 4 + talk) % 4]]) for talk in (1, 2) for i in range(24)]
    kind = "talk_id long, i long, bits array<boolean>"
    for p in range(3):
        spark.createDataFrame([x for x in rows if x[1] // 8 == p], kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={p}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    q = key_frame_stream(stream).writeStream.format("memory").queryName("leaders").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("leaders").collect())
    want = candidates(spark.createDataFrame(rows, kind), floor_s=0).select("talk_id", "cand", "rep_i").collect()
    assert got == sorted(tuple(r) for r in want) and len(got) == 8
