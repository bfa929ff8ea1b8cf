"""What the operators share: column builders, all of them built-in expressions, and a filter for the operators in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that count as white space in the contracts, and the letters that are folded.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """A-Z to lower case and nothing else; pure ASCII takes the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def two_hashes(*cols: Column) -> list[Column]:
    """128 bits as two longs that do not follow from each other."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d: the row, t: its whole text, k1, k2: a key of its id and text).

    The input's columns live inside d, so no name can clash. Rows that agree in
    id and text share a key, and whatever is derived from both.
    """
    packed = docs.select(F.struct("*").alias("d"))
    t = F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))
    return packed.select("d", t.alias("t"), *(h.alias(k) for h, k in zip(two_hashes(F.col(f"d.`{id_col}`"), F.col(f"d.`{text_col}`").isNull(), t), ("k1", "k2"))))


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame, size: int = 8 << 20) -> None:
    """Lets Arrow batches hold 8 MB where the session still has Spark's default of 64 MB: several live at once in
    the executor's buffers and in each Python worker."""
    conf = df.sparkSession.conf
    if conf.get(BATCH).strip().lower() in ("67108864b", "67108864", "64mb", "64m"):
        conf.set(BATCH, str(size))


#: Rows of at most some longs each that may be broadcast; more of them are joined by shuffle.
FEW = 1_000_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= FEW else df


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without some rows. keys (written already): k1, k2, stays, times, a row for each key that has a decision.

    Rows whose key doesn't stay go; of a key that stays and that ``times`` rows have, one row stays.
    """
    rows = with_row_key(docs, id_col, text_col).select("d", "k1", "k2")
    gone = keys.where("not stays").select("k1", "k2")
    rows = rows.join(few(gone, gone.count()), ["k1", "k2"], "left_anti")
    often = keys.where("stays and times > 1").select("k1", "k2")
    n = often.count()
    if n:
        once = rows.join(few(often, n), ["k1", "k2"], "left_anti")
        rows = once.unionByName(rows.join(few(often, n), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return rows.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def unpack(df: DataFrame, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """The input's columns out of d, then the added ones; an added name replaces an input column of that name."""
    return df.select(*(F.col(f"d.`{c}`").alias(c) for c in columns if c not in added), *(v.alias(k) for k, v in added.items()))


#: Bits of the largest filter of hashes: 32 MB.
MOST_FILTER_BITS = 28


def token_filter(tokens: DataFrame) -> np.ndarray:
    """A set of 64-bit hashes (column token; written) as bits by their leading bits, at most 2**MOST_FILTER_BITS of them, sixteen for each token
    below that. The cluster makes it piece by piece; the driver gets the bits."""
    width = int(min(MOST_FILTER_BITS, max(16, np.ceil(np.log2(16 * max(1, tokens.count()))))))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - width)
            piece = at >> np.uint64(16)
            for p in np.unique(piece):
                pieces.setdefault(int(p), np.zeros(1 << 16, bool))[(at[piece == p] & np.uint64(0xFFFF)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([np.packbits(x).tobytes() for x in pieces.values()], pa.binary())], ["piece", "bits"])

    lead = F.shiftrightunsigned("token", 64 - width + 16) if width > 16 else F.lit(0)
    out = np.zeros((1 << (width - 16), 1 << 13), np.uint8)
    for r in tokens.select("token").repartition(lead).mapInArrow(make, "piece long, bits binary").collect():
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) may be in the set of a ``token_filter``."""
    at = h >> np.uint64(64 - ((len(bits) * 8).bit_length() - 1))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
