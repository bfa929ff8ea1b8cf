"""Whole-document log-likelihoods under a gated recurrent language model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import gru
from lectern.llm import wordvec as wv
from lectern.llm.common import small_batches, with_row_key
from lectern.llm.quality import fold_of
from lectern.sources.tables import materialize

#: The end token's hash; a word's hash is that of its folded bytes.
END = np.uint64(0x0E0D)
#: Texts that one scoring batch holds together: about so many tokens, or one text.
BATCH_TOKENS = 1 << 20
#: Bytes, or one text, whose tokens are found at once: few enough that what is made of them stays in a core's cache.
NEAR_BYTES = 1 << 18


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, the end tokens included; where each text's tokens begin)."""
    parts, firsts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    lo, rows = 0, len(off) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + NEAR_BYTES, "right")) - 1)
        h, first = _tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        parts.append(h)
        firsts.append(first[1:] + firsts[-1][-1])
        lo = hi
    return np.concatenate(parts), np.concatenate(firsts)


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = wv.words(data, off, wv.SPACED)
    first = w.first + np.arange(len(w.first))
    h = np.full(len(w.hash) + len(off) - 1, END)
    keep = np.ones(len(h), bool)
    keep[first[1:] - 1] = False
    h[keep] = w.hash
    return h, first


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Table(NamedTuple):
    """Hashes in order, and where those begin that share their leading bits."""

    hashes: np.ndarray
    first: np.ndarray
    shift: np.uint64


def table_of(hashes: np.ndarray) -> Table:
    hashes = np.sort(hashes)
    bits = len(hashes).bit_length() + 1
    shift = np.uint64(64 - bits)
    lead = np.arange(1 << bits, dtype=np.uint64) << shift
    return Table(hashes, np.searchsorted(hashes, lead).astype(np.int32), shift)


def _find(h: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Index in the ordered table, and whether it is there."""
    last = len(table.hashes) - 1
    if last < 0:
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(table.first.take((h >> table.shift).view(np.int64)), last)
    left = np.flatnonzero(table.hashes.take(at) < h)
    while len(left):
        left = left[at[left] < last]
        at[left] += 1
        left = left[table.hashes.take(at[left]) < h[left]]
    return at, table.hashes.take(at) == h


def common_words(train: DataFrame, most: int) -> np.ndarray:
    """Hashes of about the ``most`` most frequent tokens, found from all rows: a token counts in every two megabytes
    of text that hold it three times, so a common token may miss some of its counts. Only which tokens take
    the quick way depends on it; their counts are made exactly."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, off in wv.slices(b.column(0), 1 << 21):
                h, n = np.unique(tokens(data, off)[0], return_counts=True)
                some = n >= min(3, n.max(initial=0))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h[some])), pa.array(n[some].astype(np.int64))], ["h", "n"])

    found = train.select("t").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(most).toPandas()
    return top.h.to_numpy(np.int64).view(np.uint64)


def token_counts(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """What all rows' tokens and the training rows' counts give, in one exchange by token.

    A row (h, c) for each common token with its training count, and a row (k1, k2)
    for each text with, over its other tokens: logs, the sum of log10(c + 0.1);
    known, how many have c > 0; trained, how many are in training texts; new, of how many
    counted tokens it is the first holder.
    """
    shared = rows.sparkSession.sparkContext.broadcast(table_of(common))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        size = len(table.hashes)
        total = np.zeros(size, np.int64)

        def out(h, k1, k2, n, train):
            return pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(k1), pa.array(k2), pa.array(n), pa.array(train)], ["h", "k1", "k2", "n", "train"])

        for b in batches:
            k1, k2, is_train = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for lo, hi, data, off in wv.slices(b.column(0)):
                h, first = tokens(data, off)
                row = np.repeat(np.arange(lo, hi), np.diff(first))
                at, hot = _find(h, table)
                total += np.bincount(at[hot & is_train[row]], minlength=size) if size else 0
                h, row = h[~hot], row[~hot]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(h)))
                r = row[new]
                yield out(h[new], k1[r], k2[r], n.astype(np.int32), is_train[r])
        none, counts = pa.nulls(size, pa.int64()), pa.array(total)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(table.hashes)), none, none, counts.cast(pa.int32()), pa.array(np.ones(size, bool))], ["h", "k1", "k2", "n", "train"])

    each = rows.select("t", "k1", "k2", "train").mapInArrow(spread, "h long, k1 long, k2 long, n int, train boolean")
    by_token = Window.partitionBy("h").orderBy("k1", "k2")
    whole = by_token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.select("*", F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).over(whole).alias("c"), F.row_number().over(by_token).alias("turn"))
    each = each.withColumn("first", (F.col("turn") == 1) & (F.col("c") > 0))
    common_key = F.when(F.col("k1").isNull(), F.col("h"))
    return each.groupBy("k1", "k2", common_key.alias("h")).agg(
        F.max("c").alias("c"),
        F.sum(F.col("n") * F.log10(F.col("c") + F.lit(0.1))).alias("logs"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).alias("trained"),
        F.sum(F.col("first").cast("long")).alias("new"),
    )


def fit(train: DataFrame, words: np.ndarray, counts: np.ndarray, hidden: int, classes: int, group_docs: int, updates: int, rate: float) -> gru.Params:
    """Trains on every training text, in groups of about group_docs texts that their keys' hashes make.

    First one group alone finds a model; then every group, that one too, goes on from it by
    itself and the mean of their models, weighted by group size, is the result.
    So the work grows with the corpus, side by side, and no task holds more than
    a group.
    """
    spark = train.sparkSession
    groups = max(1, round(train.count() / group_docs))
    table, rank = table_of(words), np.argsort(words)
    vocabulary = len(words) + 1
    shared = spark.sparkContext.broadcast((table, rank))

    def run(only: int | None, start: bytes, rate: float, updates: int, lanes: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(start)

        def learn(key, got):
            got = got.sort_by([("k1", "ascending"), ("k2", "ascending")])
            texts = []
            for _, _, data, off in wv.slices(got.column("t")):
                ids, first = word_ids(data, off, *shared.value)
                texts += [ids[a:b] for a, b in zip(first[:-1], first[1:])]
            p = gru.train(gru.unpack(sent.value, vocabulary, hidden, classes), texts, updates, rate, lanes=lanes)
            return pa.table({"n": pa.array([len(texts)], pa.int64()), "p": pa.array([gru.pack(p)], pa.binary())})

        dealt = train.withColumn("g", F.pmod(F.xxhash64("k1", "k2"), F.lit(groups)).cast("int"))
        if only is not None:
            dealt = dealt.where(F.col("g") == only)
        return dealt.select("g", "k1", "k2", "t").groupBy("g").applyInArrow(learn, "n long, p binary")

    first = gru.start(counts, hidden, classes)
    got = run(0, gru.pack(first), rate, updates, gru.LANES).collect()
    p = gru.unpack(got[0].p, vocabulary, hidden, classes) if got else first
    if groups > 1:
        p = gru.unpack(_mean(run(None, gru.pack(p), rate / 3, 1, gru.WIDE)), vocabulary, hidden, classes)
    return p


#: Numbers of a model that a row holds while models are summed.
PIECE = 1 << 16


def _mean(models: DataFrame) -> bytes:
    """The mean model. A task sums its own models in one array and sends that in pieces; these are summed in the cluster, and the
    driver gets one model."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = None, 0
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(raw.as_buffer(), np.float32) * np.float64(n)
                total, held = v if total is None else total + v, held + n
        if held:
            cut = [(total[i : i + PIECE] / held).astype(np.float32) for i in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([held] * len(cut), pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], ["piece", "n", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for b in batches:
            for piece, n, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                got = totals.setdefault(piece, [0, 0])
                got[0], got[1] = got[0] + np.frombuffer(raw, np.float32) * np.float64(n), got[1] + n
        means = [(v / n).astype(np.float32).tobytes() for v, n in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(n for _, n in totals.values()), pa.int64()), pa.array(means, pa.binary())], ["piece", "n", "v"])

    kind = "piece int, n long, v binary"
    got = models.mapInArrow(own, kind).repartition("piece").mapInArrow(add, kind).collect()
    return b"".join(bytes(r.v) for r in sorted(got, key=lambda r: r.piece))


def word_ids(data: np.ndarray, off: np.ndarray, table: Table, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model words of all tokens (len(rank) for any that is not in the vocabulary), and where texts begin."""
    h, first = tokens(data, off)
    at, there = _find(h, table)
    return np.where(there, rank[at] if len(rank) else 0, len(rank)), first


def lm_score(
    docs: DataFrame, folds: int = 10, vocabulary: int = 4095, common: int = 1 << 17, hidden: int = 20, classes: int = 64,
    group_docs: int = 4096, updates: int = 1200, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Tokens are a text's words (runs of anything but spaces and \\x09-\\x0D, A-Z
    in lower case) and one end token; a null text is empty and has the end token
    alone. Texts whose id's crc32 divides by ``folds`` are held out; of the others
    (null ids are among them) all tokens are counted. base_score is the smoothed
    unigram log10-likelihood with those counts.

    score is the model's: a gated recurrent network predicts each token from all
    that came before it in the text, first its class, then the word in its
    class. Tokens beyond the ``vocabulary`` most common words are one word to the
    network, times their own smoothed share among such tokens, by the same
    counts. Texts are scored from their first token to their last with the
    state carried on. The network is trained on every training text, in groups (see ``fit``).

    Tokens are known by 64-bit hashes. The ``common`` most frequent are counted
    in arrays of fixed size in each task; the rest move once, by hash, one row
    for each token and text, and give sums for each text; so a group of equal tokens is at most as large as
    the count of the first word that is not common. Tokens of equal count are put in order by hash. Very long
    texts are read and scored whole. Repeated rows count each and get equal scores. An empty table gives no rows. Other
    columns are not read, so their names cannot clash.
    """
    small_batches(docs)
    spark = docs.sparkSession
    rows = with_row_key(docs, id_col, text_col).select(F.col(f"d.`{id_col}`").alias("id"), fold_of(F.col(f"d.`{id_col}`"), folds).alias("held_out"), "k1", "k2", "t")
    rows = rows.withColumn("train", ~F.col("held_out"))
    train = rows.where("train")
    frequent = common_words(train, common)
    sums = materialize(token_counts(rows, frequent), "token-sums")
    hot = sums.where("h is not null").select("h", "c").toPandas()
    rare = sums.where("h is null").agg(F.sum("trained").alias("n"), F.sum("new").alias("v")).first()
    find = table_of(frequent)
    table = find.hashes
    c = np.zeros(len(table), np.int64)
    c[np.searchsorted(table, hot.h.to_numpy(np.int64).view(np.uint64))] = hot.c.to_numpy(np.int64)
    n_train, distinct = int(c.sum()) + int(rare.n or 0), int((c > 0).sum()) + int(rare.v or 0)

    order = np.lexsort((table, -c))[: min(vocabulary, int((c > 0).sum()))]
    words, word_counts = table[order], c[order]
    n_other, v_other = n_train - int(word_counts.sum()), distinct - len(words)
    params = fit(train, words, np.append(word_counts, n_other), hidden, classes, group_docs, updates, rate)
    rank = np.full(len(table), len(words))
    rank[order] = np.arange(len(words))
    logs = np.log10(c + 0.1)
    shared = spark.sparkContext.broadcast((find, logs, c > 0, rank, len(words), params))

    scored_type = "n_tokens long, n_other long, hot_known long, hot_logs double, hot_other_logs double, net double"

    @F.arrow_udf(f"struct<{scored_type.replace(' long', ':long').replace(' double', ':double')}>")
    def scored(t: pa.Array) -> pa.Array:
        table, logs, seen, rank, n_words, params = shared.value
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        texts: list[np.ndarray] = []
        held = 0

        def flush():
            parts[5].append(gru.score(params, texts) / np.log(10))
            texts.clear()

        for lo, hi, data, off in wv.slices(t):
            h, first = tokens(data, off)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            at, hot = _find(h, table)
            known = at[hot], row[hot]
            count = lambda r, w=None: np.bincount(r, w, hi - lo)  # noqa: E731, B023
            other = rank[known[0]] == n_words if len(rank) else np.zeros(0, bool)
            parts[0].append(np.diff(first))
            parts[2].append(count(known[1], seen[known[0]]) if len(known[0]) else np.zeros(hi - lo))
            parts[3].append(count(known[1], logs[known[0]]) if len(known[0]) else np.zeros(hi - lo))
            parts[4].append(count(known[1][other], logs[known[0][other]]) if len(known[0]) else np.zeros(hi - lo))
            ids = np.full(len(h), n_words)
            ids[hot] = rank[known[0]]
            parts[1].append(count(row[ids == n_words]))
            texts.extend(ids[a:b].astype(np.int32) for a, b in zip(first[:-1], first[1:]))
            held += len(ids)
            if held >= BATCH_TOKENS:
                flush()
                held = 0
        flush()
        names = [x.split()[0] for x in scored_type.split(", ")]
        kinds = [np.int64] * 3 + [np.float64] * 3
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(k) if x else np.zeros(0, k)) for x, k in zip(parts, kinds)], names)

    own = sums.where("h is null and k1 is not null").select("k1", "k2", "logs", "known")
    times = rows.select("id", "held_out", "k1", "k2", scored("t").alias("s"))
    copies = Window.partitionBy("k1", "k2")
    out = times.withColumn("copies", F.count("*").over(copies)).join(own, ["k1", "k2"], "left")
    share_of = lambda x: F.coalesce(F.col(x) / F.col("copies"), F.lit(0))
    base_norm = float(np.log10(n_train + 0.1 * (distinct + 1)))
    other_norm = float(np.log10(n_other + 0.1 * (v_other + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", F.col("s.n_tokens").alias("n_tokens"),
        (F.col("s.hot_known") + F.round(share_of("known")).cast("long")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("s.hot_logs") + share_of("logs") - F.col("s.n_tokens") * base_norm).alias("base_score"),
        (F.col("s.net") + F.col("s.hot_other_logs") + share_of("logs") - F.col("s.n_other") * other_norm).alias("score"),
    )
