"""Deduplicates the slides of a talk by their text."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import token_set
from lectern.sources.tables import materialize

CONTAINED, ALIKE, BUILD_GAP_MS, LEAST_TOKENS = 0.90, 0.92, 15_000, 3
SLIDE = "talk_id long, slide_id long, first_seen_ms long, builds long, spans array<struct<start_ms:long,end_ms:long>>, on_screen_ms long, times_returned long"


def adjacent_containment(slides: DataFrame) -> DataFrame:
    """(talk_id, slide_id, next_id, contained, is_build): how much of a slide's tokens the next slide has."""
    w = Window.partitionBy("talk_id").orderBy("first_seen_ms", "idx")
    s = slides.select("talk_id", "slide_id", "first_seen_ms", "idx", token_set(F.col("ocr_text")).alias("a"), F.element_at("spans", -1)["end_ms"].alias("until"), F.col("spans")[0]["start_ms"].alias("since"))
    s = s.select("talk_id", "slide_id", F.lead("slide_id").over(w).alias("next_id"), "a", F.lead("a").over(w).alias("b"), (F.lead("since").over(w) - F.col("until")).alias("gap")).where("next_id is not null")
    share = F.try_divide(F.size(F.array_intersect("a", "b")), F.size("a"))
    build = (F.size("a") >= LEAST_TOKENS) & (F.size("b") > 0) & (F.col("gap") <= BUILD_GAP_MS) & (share >= CONTAINED) & (F.size("b") >= F.size("a"))
    return s.select("talk_id", "slide_id", "next_id", share.alias("contained"), F.coalesce(build, F.lit(False)).alias("is_build"))


def jaccard_pairs(texts: DataFrame, least: float = ALIKE, id_col: str = "slide_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, jaccard) of rows (id_col, toks) whose token sets are alike.

    Rows with equal sets are a class, known by its least id: the pairs are those between classes, and each other member with its
    own class, so copies never make all their pairs. Tokens are put in order from rare to frequent; two sets that
    reach the likeness must share one of their rarest tokens, so only those are joined, and pairs
    too different in size don't meet. A token of one class only takes its place in that order, but never moves. Tokens are
    known by 64-bit hashes, sets by 128 bits.
    """
    sized = texts.select(*keys, F.col(id_col).alias("id"), F.array_sort(F.transform("toks", lambda x: F.xxhash64(x))).alias("h")).where(F.size("h") >= LEAST_TOKENS)
    sized = materialize(sized.select(*keys, "id", "h", F.xxhash64("h").alias("s1"), F.xxhash64(F.lit(1), "h").alias("s2")), "token-sets")
    heads = materialize(sized.groupBy(*keys, "s1", "s2").agg(F.min("id").alias("head")), "set-heads")
    members = sized.select(*keys, "id", "s1", "s2").join(heads, [*keys, "s1", "s2"]).where("id != head").select(*keys, F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    own = materialize(sized.join(heads.select(*keys, F.col("head").alias("id")), [*keys, "id"], "left_semi").select(*keys, "id", "h", F.size("h").alias("n")), "class-sets")

    each = own.select(*keys, "id", "n", F.explode("h").alias("tok"))
    counts = materialize(each.groupBy(*keys, "tok").agg(F.count("*").alias("times")).where("times > 1"), "token-counts")
    ordered = each.join(counts, [*keys, "tok"]).groupBy(*keys, "id", "n").agg(F.array_sort(F.collect_list(F.struct("times", "tok"))).alias("o"))
    prefix = F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1 - (F.col("n") - F.size("o"))
    tokens = ordered.select(*keys, "id", "n", F.explode(F.slice("o", F.lit(1), F.greatest(prefix, F.lit(0)))).alias("x")).select(*keys, "id", "n", "x.tok")
    tokens = materialize(tokens, "prefix-tokens")
    a, b = (tokens.select(*keys, "tok", F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least
    pairs = a.join(b, [*keys, "tok"]).where((F.col("a") < F.col("b")) & near).select(*keys, "a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(own.select(*keys, F.col("id").alias(x), F.col("h").alias(f"h_{x}")), [*keys, x])
    pairs = pairs.withColumn("both", F.size(F.array_intersect("h_a", "h_b")))
    j = F.col("both") / (F.size("h_a") + F.size("h_b") - F.col("both"))
    return pairs.select(*keys, "a", "b", j.alias("jaccard")).where(F.col("jaccard") >= least).unionByName(members)


def _fused(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans, key=lambda x: x[0]):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _collapse(rows: list[dict]) -> list[dict]:
    """Builds go into the slide that completes them, then equal texts into the earlier slide.

    After a build is taken in, the survivor starts where it started, so only
    the pair before it can have become a build: going one step back finds the
    same order as starting over.
    """
    deck = sorted(rows, key=lambda r: (r["first_seen_ms"], r["idx"]))
    i = 0
    while i + 1 < len(deck):
        a, b = deck[i], deck[i + 1]
        gap = b["spans"][0][0] - a["spans"][-1][1]
        if len(a["toks"]) >= LEAST_TOKENS and b["toks"] and gap <= BUILD_GAP_MS and len(b["toks"]) >= len(a["toks"]) and len(a["toks"] & b["toks"]) / len(a["toks"]) >= CONTAINED:
            _take(b, a)
            b["builds"] += 1 + a["builds"]
            del deck[i]
            i = max(0, i - 1)
        else:
            i += 1
    out: list[dict] = []
    by_size: dict[int, list[int]] = {}
    for s in deck:
        t = s["toks"]
        n = len(t)
        # Only sets near enough in size can be alike; the first of those that are takes the slide in.
        sizes = range(math.floor(n * ALIKE), math.ceil(n / ALIKE) + 1) if n >= LEAST_TOKENS else ()
        near = heapq.merge(*(by_size[m] for m in sizes if m in by_size))
        twin = next((k for k in near if _alike(t, out[k]["toks"])), None)
        if twin is None:
            by_size.setdefault(n, []).append(len(out))
            out.append(s)
        else:
            _take(out[twin], s)
    return out


def _alike(a: set, b: set) -> bool:
    both = len(a & b)
    return bool(b) and both / (len(a) + len(b) - both) >= ALIKE


def _take(to: dict, other: dict) -> None:
    to["spans"] = sorted(to["spans"] + other["spans"], key=lambda x: x[0])
    to["first_seen_ms"] = min(to["first_seen_ms"], other["first_seen_ms"])


def collapse(slides: DataFrame) -> DataFrame:
    """(talk_id, slide_id, first_seen_ms, builds, spans, on_screen_ms, times_returned): one row for each slide that stays, its spans fused.

    Whether slides merge depends on merges before, so a talk's deck is handled in one go.
    Tokens come from the built-in tokenizer; only ids, spans and tokens reach Python.
    """

    def run(got):
        rows = [
            {"slide_id": r["slide_id"], "idx": r["idx"], "first_seen_ms": r["first_seen_ms"], "builds": 0, "spans": [(s["start_ms"], s["end_ms"]) for s in r["spans"]], "toks": set(r["toks"])}
            for r in got.to_pylist()
        ]
        talk = got.column("talk_id")[0].as_py()
        out = []
        for s in _collapse(rows):
            spans = _fused(s["spans"])
            out.append({"talk_id": talk, "slide_id": s["slide_id"], "first_seen_ms": s["first_seen_ms"], "builds": s["builds"], "spans": [{"start_ms": a, "end_ms": b} for a, b in spans], "on_screen_ms": sum(b - a for a, b in spans), "times_returned": max(0, len(spans) - 1)})
        span = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        long = pa.int64()
        return pa.Table.from_pylist(out, pa.schema([("talk_id", long), ("slide_id", long), ("first_seen_ms", long), ("builds", long), ("spans", span), ("on_screen_ms", long), ("times_returned", long)]))

    rows = slides.select("talk_id", "slide_id", "idx", "first_seen_ms", "spans", token_set(F.col("ocr_text")).alias("toks"))
    return rows.groupBy("talk_id").applyInArrow(run, SLIDE)


def renumber(slides: DataFrame) -> DataFrame:
    """Adds ord and name (s001, ...) in order of first sight."""
    w = Window.partitionBy("talk_id").orderBy("first_seen_ms", "slide_id")
    n = F.row_number().over(w)
    return slides.withColumn("ord", n.cast("long")).withColumn("name", F.format_string("s%03d", n))


def stale_files(files: DataFrame, slides: DataFrame, col: str = "file") -> DataFrame:
    """Files that no slide of the final deck has."""
    return files.join(slides.select(col), col, "left_anti")


def engines_used(slides: DataFrame) -> DataFrame:
    """(talk_id, engines: map from engine to slides, vision)."""
    per = slides.groupBy("talk_id", "engine").agg(F.count("*").cast("int").alias("n"))
    return per.groupBy("talk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "n")))).alias("engines"), F.bool_or(F.col("engine") == "vision").alias("vision"))
