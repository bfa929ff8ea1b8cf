"""Stage logs and key frames as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.lineage import error_tail

LOG = "talk_id long, stage string, status string, config_hash string, error string, seq long"


def log_stream(events: DataFrame, path: str, most_error: int = 1000) -> DataStreamWriter:
    """Appends a stream of stage results (talk_id, stage, status, config_hash, error) to the log in a folder, to be started with a checkpoint.

    A batch becomes one folder named by its number, so that a batch that runs again after a failure takes its own place and the log holds
    each result once. seq grows from batch to batch; of several results of one talk and stage in a batch the order is that of
    their status, "failed" last, so that a failure is never hidden.
    """

    def put(batch: DataFrame, number: int) -> None:
        turn = Window.partitionBy("talk_id", "stage").orderBy(F.col("status") == "failed", "status", "config_hash")
        seq = F.lit(number).cast("long") * 1_000_000 + F.row_number().over(turn)
        batch.select("talk_id", "stage", "status", "config_hash", error_tail(F.col("error"), most_error).alias("error"), seq.alias("seq")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(put)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{path}/batch=*")


def key_frame_stream(frames: DataFrame, threshold: float = 0.08, stability: float = 0.05) -> DataFrame:
    """(talk_id, cand, rep_i) of each frame that leads a new cluster, as frames (talk_id, i, bits) come in, each talk's in order.

    The state of a talk are its last frame and its leaders, as packed bits: a few hundred bytes for each slide shown.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        width, last, leaders = (state.get[0], state.get[1], list(state.get[2])) if state.exists else (0, None, [])
        shown = np.asarray([np.unpackbits(np.frombuffer(x, np.uint8))[:width] for x in leaders], np.uint8).reshape(len(leaders), width)
        before = None if last is None else (int.from_bytes(last[:8], "big"), np.unpackbits(np.frombuffer(last[8:], np.uint8))[:width])
        out = []
        rows = sorted((r for b in batches for r in zip(b["i"], b["bits"])), key=lambda r: r[0])
        for i, raw in rows:
            bits = np.asarray(raw, np.uint8)
            width = len(bits)
            if before is not None and (before[1] != bits).mean() <= stability:
                near = (shown != before[1]).mean(1).min() if len(shown) else 1.0 + threshold
                if near > threshold:
                    out.append((key[0], len(leaders), before[0]))
                    leaders.append(np.packbits(before[1]).tobytes())
                    shown = np.concatenate([shown.reshape(-1, width), before[1][None]])
            before = (int(i), bits)
        if before is not None:
            state.update((width, before[0].to_bytes(8, "big") + np.packbits(before[1]).tobytes(), leaders))
        yield pd.DataFrame(out, columns=["talk_id", "cand", "rep_i"])

    keyed = frames.select("talk_id", "i", "bits").groupBy("talk_id")
    return keyed.applyInPandasWithState(step, "talk_id long, cand long, rep_i long", "width int, last binary, leaders array<binary>", "append", GroupStateTimeout.NoTimeout)
