"""Cues as streams: repeated cues merged as they come, and minutes with speech."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.cues import EPS_MS

SEGMENT = "talk_id long, seg_idx long, start_ms long, end_ms long, text string"


def _merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The open segment of a talk is its only state; it comes out once a later cue doesn't prolong it, or at the talk's end."""
    seg = list(state.get) if state.exists else None
    out = []
    for _, start, end, text in sorted((r for b in batches for r in b[["ord", "start_ms", "end_ms", "text"]].itertuples(index=False, name=None)), key=lambda r: r[0]):
        if not isinstance(text, str):
            if seg:
                out.append((key[0], *seg))
            seg = None
        elif seg and text == seg[3] and start < seg[2] + EPS_MS:
            seg[2] = max(seg[2], end)
        else:
            if seg:
                out.append((key[0], *seg))
            seg = [seg[0] + 1 if seg else 0, start, end, text]
    if seg:
        state.update((int(seg[0]), int(seg[1]), int(seg[2]), str(seg[3])))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["talk_id", "seg_idx", "start_ms", "end_ms", "text"])


def merge_stream(cues: DataFrame) -> DataFrame:
    """Segments of a stream of cues (talk_id, ord, start_ms, end_ms, text). A talk's cues must come in order of ord from
    batch to batch; a cue without text ends its talk, gives the last segment and clears the state."""
    keyed = cues.select("talk_id", "ord", "start_ms", "end_ms", "text").groupBy("talk_id")
    return keyed.applyInPandasWithState(_merge, SEGMENT, "seg_idx long, start_ms long, end_ms long, text string", "append", GroupStateTimeout.NoTimeout)


def spoken_minutes(segments: DataFrame, time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(window, talk_id, cues): cues of each minute of event time; later than ``late`` they are dropped."""
    return segments.withWatermark(time_col, late).groupBy(F.window(time_col, "1 minute"), "talk_id").agg(F.count("*").alias("cues"))
