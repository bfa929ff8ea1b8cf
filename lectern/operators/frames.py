"""Key frames of a talk from the hashes of its sampled frames."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import hamming

CANDIDATE = "talk_id long, cand long, rep_i long, source string, spans array<struct<s:long,e:long>>"


def settled(frames: DataFrame, stability: float = 0.05) -> DataFrame:
    """(talk_id, i, distance, settled): is a frame near enough to the one after it? The last of a talk has none and is left out."""
    w = Window.partitionBy("talk_id").orderBy("i")
    d = frames.withColumn("next", F.lead("bits").over(w)).where("next is not null").select("talk_id", "i", hamming(F.col("bits"), F.col("next")).alias("distance"))
    return d.withColumn("settled", F.col("distance") <= stability)


@dataclass
class _Kept:
    rep: int
    source: str
    spans: list[list[int]] = field(default_factory=list)


def key_frames(bits: np.ndarray, threshold: float, stability: float) -> list[_Kept]:
    """Leader clustering of the settled frames in time order.

    A frame goes to the nearest leader within the threshold (the first of equals), and
    prolongs its last span if it follows at once; else it leads a cluster of its own.
    """
    kept: list[_Kept] = []
    leaders = np.zeros((0, bits.shape[1]), bool)
    still = np.flatnonzero((bits[1:] != bits[:-1]).mean(1) <= stability) if len(bits) > 1 else []
    for i in map(int, still):
        d = (leaders != bits[i]).mean(1)
        j = int(d.argmin()) if len(d) else -1
        if j < 0 or d[j] > threshold:
            kept.append(_Kept(i, "hash", [[i, i]]))
            leaders = np.concatenate([leaders, bits[i : i + 1]])
        elif i <= kept[j].spans[-1][1] + 1:
            kept[j].spans[-1][1] = i
        else:
            kept[j].spans.append([i, i])
    return kept


def with_floor(kept: list[_Kept], bits: np.ndarray, interval: float, floor_s: float, stability: float) -> list[_Kept]:
    """At each tick of the floor that no span covers, the calmest of the five samples around it is put in: as a span
    of the nearest candidate, if that is all but identical, else as a candidate."""
    n, out = len(bits), list(kept)
    if floor_s <= 0 or not n:
        return out
    ahead = np.append((bits[1:] != bits[:-1]).mean(1), 0.0)
    for k in range(1, int(n * interval / floor_s) + 2):
        tick = k * floor_s
        if tick >= n * interval:
            break
        i = round(tick / interval)
        if i >= n or any(s <= i <= e for c in out for s, e in c.spans):
            continue
        lo, hi = max(0, i - 2), min(n - 1, i + 2)
        at = lo + int(ahead[lo : hi + 1].argmin())
        d = (bits[[c.rep for c in out]] != bits[at]).mean(1) if out else np.zeros(0)
        if len(d) and d.min() <= stability:
            c = out[int(d.argmin())]
            c.spans = sorted([*c.spans, [at, at]])
        else:
            out.append(_Kept(at, "floor", [[at, at]]))
    return out


def candidates(frames: DataFrame, interval: float = 2.0, threshold: float = 0.08, stability: float = 0.05, floor_s: float = 45.0) -> DataFrame:
    """(talk_id, cand, rep_i, source, spans): the detectors' candidates, talk by talk; the state is a talk's leaders."""

    def detect(got):
        got = got.sort_by("i")
        bits = np.asarray(got.column("bits").to_pylist(), bool)
        found = with_floor(key_frames(bits, threshold, stability), bits, interval, floor_s, stability)
        talk = got.column("talk_id")[0].as_py()
        rows = [{"talk_id": talk, "cand": k, "rep_i": c.rep, "source": c.source, "spans": [{"s": s, "e": e} for s, e in c.spans]} for k, c in enumerate(found)]
        span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        return pa.Table.from_pylist(rows, pa.schema([("talk_id", pa.int64()), ("cand", pa.int64()), ("rep_i", pa.int64()), ("source", pa.string()), ("spans", span)]))

    return frames.select("talk_id", "i", "bits").groupBy("talk_id").applyInArrow(detect, CANDIDATE)


def capped(cands: DataFrame, most: int = 400) -> DataFrame:
    """The candidates seen longest, at most so many of a talk, in order of first sight."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"] + 1)
    longest = Window.partitionBy("talk_id").orderBy(F.desc("total"), "cand")
    kept = cands.withColumn("total", total).withColumn("rank", F.row_number().over(longest)).where(F.col("rank") <= most)
    by_sight = Window.partitionBy("talk_id").orderBy(F.col("spans")[0]["s"], "cand")
    return kept.withColumn("ord", F.row_number().over(by_sight)).drop("rank")


def timed(cands: DataFrame, interval_ms: int = 2000) -> DataFrame:
    """Adds spans_ms, each sample as long as the interval, and rep_ms: the middle of the first longest span."""
    spans = F.transform("spans", lambda s: F.struct((s["s"] * interval_ms).alias("start_ms"), ((s["e"] + 1) * interval_ms).alias("end_ms")))
    longest = F.aggregate("spans", F.col("spans")[0], lambda a, s: F.when(s["e"] - s["s"] > a["e"] - a["s"], s).otherwise(a))
    mid = (longest["s"] + longest["e"] + 1) * interval_ms / 2
    return cands.withColumn("spans_ms", spans).withColumn("rep_ms", mid.cast("long"))


def stats(cands: DataFrame) -> DataFrame:
    return cands.groupBy("talk_id").agg(F.count_if(F.col("source") == "hash").alias("hash_candidates"), F.count_if(F.col("source") == "floor").alias("floor_candidates"), F.count("*").alias("candidates"))
