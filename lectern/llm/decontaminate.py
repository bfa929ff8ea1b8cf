"""Finds benchmark passages in documents by winnowed fingerprints."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import wordvec as wv
from lectern.llm.common import passes, small_batches, token_filter, two_hashes, unpack, with_row_key
from lectern.sources.tables import materialize

FOUND = "struct<n_words:long,n_hit:long,items:array<string>>"


def winnow(h: np.ndarray, at: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Of each row's consecutive hashes, the indices of the least one (the last, if several) of each run of ``width``.

    Two texts that share a run of words of k + width - 1 choose the same hash in it.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(h, width)
    least = np.arange(n) + (width - 1 - np.argmin(runs[:, ::-1], axis=1))
    return np.unique(least[row[:n] == row[width - 1 :]])


class Index:
    """Fingerprints of some benchmark items. Items are (id as string, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram, self.width = window, gram, window - gram + 1
        self.ids = [i for i, _ in items]
        w = wv.words(*wv.buffers(pa.array([t for _, t in items], pa.large_string())), wv.ALNUM)
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.texts = [[w.text(j) for j in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
        h, at = wv.windows(w, gram)
        row = np.searchsorted(w.first, at, "right") - 1
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in winnow(h, at, row, self.width):
            self.at[int(h[i])].append((int(row[i]), int(at[i] - w.first[row[i]])))
        self.hashes = np.sort(np.fromiter(self.at, np.uint64, len(self.at)))
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, x in enumerate(self.words):
            if 0 < len(x) < window:
                self.short[len(x)][int(wv.run_hash(x))].append(i)
        self.short = {m: (np.sort(np.fromiter(v, np.uint64, len(v))), dict(v)) for m, v in self.short.items()}

    def _same(self, w: wv.Words, i: int, item: int, j: int) -> bool:
        return w.hash[i] == self.words[item][j] and w.text(i) == self.texts[item][j]

    def _extend(self, w: wv.Words, lo: int, hi: int, at: int, item: int, j: int) -> tuple[int, int]:
        """The longest run of equal words around document word ``at`` and item word j, within words lo to hi."""
        if not self._same(w, at, item, j):
            return at, at
        a, b, n = at, at + 1, len(self.words[item])
        while a > lo and j - (at - a) > 0 and self._same(w, a - 1, item, j - (at - a) - 1):
            a -= 1
        while b < hi and j + (b - at) < n and self._same(w, b, item, j + (b - at)):
            b += 1
        return a, b

    def find(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the disjoint spans of hit words, and the items that occur."""
        w = wv.words(data, off, wv.ALNUM)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        h, at = wv.windows(w, self.gram)
        row = np.searchsorted(w.first, at, "right") - 1
        chosen = winnow(h, at, row, self.width)
        chosen = chosen[_among(h[chosen], self.hashes)]
        done: dict[tuple[int, int], int] = {}
        for i in chosen:
            p, r = int(at[i]), int(row[i])
            for item, j in self.at[int(h[i])]:
                if done.get((item, p - j), -1) > p:
                    continue
                a, b = self._extend(w, int(w.first[r]), int(w.first[r + 1]), p, item, j)
                done[item, p - j] = b
                if b - a >= self.window:
                    spans[r].append((a, b))
                    items[r].add(self.ids[item])
        for m, (hashes, by_hash) in self.short.items():
            h, at = wv.windows(w, m)
            for i in np.flatnonzero(_among(h, hashes)):
                p = int(at[i])
                r = int(np.searchsorted(w.first, p, "right") - 1)
                same = [x for x in by_hash[int(h[i])] if all(self._same(w, p + j, x, j) for j in range(m))]
                if same:
                    spans[r].append((p, p + m))
                    items[r].update(self.ids[x] for x in same)
        out = []
        for r in range(len(off) - 1):
            lo = int(w.first[r])
            joined: list[tuple[int, int]] = []
            for a, b in sorted(spans.get(r, ())):
                if joined and a - lo <= joined[-1][1]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], b - lo))
                else:
                    joined.append((a - lo, b - lo))
            out.append((int(w.first[r + 1]) - lo, joined, items.get(r, set())))
        return out


def _among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


def _candidates(rows: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """(k1, k2, b1, b2) of documents and items that share a fingerprint, or a run as long as a shorter item. Written.

    Both sides' fingerprints meet by hash, in the cluster. A filter of bounded size over the items' ones passes
    over most of the documents' before these move.
    """
    width = window - gram + 1

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off in wv.slices(b.column(0)):
                w = wv.words(data, off, wv.ALNUM)
                h, at = wv.windows(w, gram)
                row = np.searchsorted(w.first, at, "right") - 1
                some = winnow(h, at, row, width)
                sizes = np.diff(w.first)
                short = np.flatnonzero((sizes > 0) & (sizes < window))
                hs = np.concatenate([h[some], np.asarray([wv.run_hash(w.hash[w.first[i] : w.first[i + 1]]) for i in short], np.uint64)])
                m = pa.array(np.concatenate([np.zeros(len(some), np.int32), sizes[short].astype(np.int32)]))
                at = pa.array(np.concatenate([row[some], short]) + lo)
                yield pa.RecordBatch.from_arrays([pa.array(hs.view(np.int64)), m, b.column(1).take(at), b.column(2).take(at)], ["token", "m", "b1", "b2"])

    marks = materialize(items.select("t", "b1", "b2").mapInArrow(of_items, "token long, m int, b1 long, b2 long").distinct(), "item-fingerprints")
    lengths = [r.m for r in marks.select("m").where("m > 0").distinct().collect()]
    shared = rows.sparkSession.sparkContext.broadcast(token_filter(marks))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for lo, _, data, off in wv.slices(b.column(0)):
                w = wv.words(data, off, wv.ALNUM)
                for m in (0, *lengths):
                    h, at = wv.windows(w, m or gram)
                    row = np.searchsorted(w.first, at, "right") - 1
                    if not m:
                        some = winnow(h, at, row, width)
                        h, row = h[some], row[some]
                    there = passes(h, bits)
                    row = pa.array(row[there] + lo)
                    yield pa.RecordBatch.from_arrays([pa.array(h[there].view(np.int64)), pa.array(np.full(len(row), m, np.int32)), b.column(1).take(row), b.column(2).take(row)], ["token", "m", "k1", "k2"])

    found = rows.select("t", "k1", "k2").mapInArrow(of_documents, "token long, m int, k1 long, k2 long").distinct()
    found = materialize(found, "document-fingerprints")
    return materialize(found.join(marks, ["token", "m"]).select("k1", "k2", "b1", "b2").distinct(), "candidates")


def _hits_by_join(rows: DataFrame, items: DataFrame, window: int, gram: int, part_items: int = 64) -> DataFrame:
    """(k1, k2, items, spans): the hits of documents in a benchmark of any size; a document with many candidate items has a row for
    each ``part_items`` of them, and its text moves once for each."""
    pairs = _candidates(rows, items, window, gram)
    parts = materialize(pairs.groupBy("k1", "k2").agg(F.ceil(F.count("*") / part_items).cast("int").alias("parts")), "candidate-parts")
    own = F.pmod(F.xxhash64("b1", "b2"), F.col("parts")).cast("int").alias("part")
    asked = pairs.join(parts, ["k1", "k2"]).join(items, ["b1", "b2"]).select("k1", "k2", own, F.lit(False).alias("doc"), "item", "t")
    texts = rows.select("k1", "k2", "t").join(parts, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    texts = texts.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("doc"), F.lit("").alias("item"), "t")

    def find(key, got):
        doc = np.asarray(got.column("doc").to_pylist(), bool)
        ids, texts = got.column("item").to_pylist(), got.column("t").to_pylist()
        index = Index([(i, t) for i, t, d in zip(ids, texts, doc) if not d], window, gram)
        _, spans, items = index.find(*wv.buffers(pa.array([texts[int(np.flatnonzero(doc)[0])]], pa.large_string())))[0]
        return pa.Table.from_pylist([{"k1": key[0].as_py(), "k2": key[1].as_py(), "items": sorted(items), "spans": [{"starts": a, "ends": b} for a, b in spans]}] if spans else [], _HITS)

    found = asked.unionByName(texts).groupBy("k1", "k2", "part").applyInArrow(find, "k1 long, k2 long, items array<string>, spans array<struct<starts:long,ends:long>>")
    return materialize(found, "hits")


_HITS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("starts", pa.int64()), ("ends", pa.int64())])))])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, block_chars: int = 8_000_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The columns of docs plus n_words, n_hit, items (sorted item ids as strings) and contaminated.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
    in lower case. A word is hit if it lies in a run of ``window`` words of an
    item; an item of fewer words counts as one run. Both sides are winnowed: of
    every window - gram + 1 consecutive hashes of ``gram`` words the least is
    kept, so each shared run of ``window`` words shares a fingerprint. A shared
    fingerprint is extended word by word, comparing the words themselves. Items
    shorter than the window are looked up in all runs of their length.

    A benchmark of at most ``block_chars`` characters, which are counted first, is broadcast, and documents are read in Arrow
    batches and never shuffled. With a larger one fingerprints meet by hash in the cluster (``_hits_by_join``); only
    texts with candidates move.

    Null and empty texts have no words; very long ones are read whole. Null items are left out, a null item id
    is listed as an empty string. Repeated items count once, repeated documents each; items with equal texts are
    listed each, in the order of their ids as strings. No items give no hits, no documents no rows. Input
    columns with the added names are replaced, others kept whatever their names.
    """
    small_batches(docs)
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").alias("t")).where(F.col("t").isNotNull())

    if (items.agg(F.sum(F.length("t"))).first()[0] or 0) <= block_chars:
        shared = spark.sparkContext.broadcast([(r.item, r.t) for r in items.collect()])
        built: list[Index] = []

        @F.arrow_udf(FOUND)
        def found(t: pa.Array) -> pa.Array:
            if not built:
                built.append(Index(shared.value, window, gram))
            out = []
            for _, _, data, off in wv.slices(t):
                for n, spans, items in built[0].find(data, off):
                    out.append({"n_words": n, "n_hit": sum(b - a for a, b in spans), "items": sorted(items)})
            return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]))

        rows = docs.select(F.struct("*").alias("d"), found(F.col(f"`{text_col}`")).alias("f"))
        added = {"n_words": F.col("f.n_words"), "n_hit": F.col("f.n_hit"), "items": F.col("f.items")}
        return unpack(rows, docs.columns, added | {"contaminated": F.col("f.n_hit") > 0})

    rows = with_row_key(docs, id_col, text_col)
    items = materialize(items.select("item", "t", *(h.alias(n) for h, n in zip(two_hashes("item", "t"), ("b1", "b2")))).dropDuplicates(["b1", "b2"]), "items")
    parts = _hits_by_join(rows, items, window, gram)
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["upto"], x["ends"]).alias("upto"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["ends"] - F.greatest(s["upto"], x["starts"]))).alias("n"))
    merged = parts.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    merged = merged.select("k1", "k2", F.aggregate(F.array_sort("spans"), start, step, lambda s: s["n"]).alias("hit"), F.array_sort(F.array_distinct("items")).alias("found"))
    joined = rows.join(materialize(merged, "merged-hits"), ["k1", "k2"], "left")
    n_words = F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return unpack(joined, docs.columns, {"n_words": n_words, "n_hit": hit, "items": F.coalesce("found", F.array().cast("array<string>")), "contaminated": hit > 0})

