"""Near-duplicate classes by an exact Jaccard join on word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import wordvec as wv
from lectern.llm.common import FEW, few, passes, small_batches, token_filter, with_row_key, without
from lectern.llm.components import components
from lectern.sources.tables import materialize

#: Bits of the bitmap of a small set; of a larger one as many as it has elements, rounded up to a power of two, at most MOST_BITS.
BITS, MOST_BITS = 1024, 1 << 15


class Sets(NamedTuple):
    """The distinct shingles of some texts: hashes, text by text in rising order, and where each text's begin."""

    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Sets:
    """Runs of k words; of a text with fewer words, the whole of it; of one without words, nothing."""
    w = wv.words(data, off, wv.SPACED)
    h, at = wv.windows(w, k)
    row = np.searchsorted(w.first, at, "right") - 1
    sizes = np.diff(w.first)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = np.asarray([wv.run_hash(w.hash[w.first[i] : w.first[i + 1]]) for i in short], np.uint64)
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        h, row = h[new], row[new]
    return Sets(h, np.searchsorted(row, np.arange(len(off))))


def _sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    out = []
    for _, _, data, off in wv.slices(texts):
        s = shingle_sets(data, off, k)
        out += [s.hash[a:b] for a, b in zip(s.first[:-1], s.first[1:])]
    return out


def frequency_sketch(texts: DataFrame, k: int, bits: int) -> np.ndarray:
    """For 2**bits hash buckets, how many texts' shingles fall into each (a task counts 255 at most).

    Every text counts. A task sends one byte for each bucket; these are summed
    piece by piece in the cluster, and the driver gets the sum, whose size is fixed.
    """
    size, pieces = 1 << bits, 1 << max(0, bits - 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for b in batches:
            for _, _, data, off in wv.slices(b.column(0)):
                total += np.bincount((shingle_sets(data, off, k).hash >> np.uint64(64 - bits)).astype(np.int64), minlength=size).astype(np.uint32)
        raw = np.minimum(total, 255).astype(np.uint8).reshape(pieces, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.tobytes() for x in raw], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                totals[piece] = totals.get(piece, 0) + np.frombuffer(raw, np.uint8).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["piece", "counts"])

    kind = "piece int, counts binary"
    got = texts.mapInArrow(count, kind).repartition("piece").mapInArrow(add, kind).collect()
    out = np.zeros((pieces, size // pieces), np.uint32)
    for r in got:
        out[r.piece] = np.frombuffer(r.counts, np.uint32)
    return out.reshape(-1)


def prefix_length(n: int, percent: int, matches: int) -> int:
    """Two sets of at least this likeness, each cut to its first so many tokens of one common order, share ``matches`` tokens
    (or the lesser of their two numbers of matches)."""
    least = -(-percent * n // 100)
    return min(n, n - least + matches)


def choose_matches(estimate: np.ndarray, n: int, percent: int, most: int = 8, verify: float = 20.0) -> int:
    """How many shared prefix tokens to ask for: the number with the least estimated cost.

    ``estimate`` has the tokens' expected other holders, in prefix order. A
    prefix for m matches costs S, the sum over it, for reading lists; at most S / m
    texts reach m matches, and each costs ``verify``.
    """
    run = np.cumsum(estimate)
    best, cost = 1, None
    for m in range(1, min(most, -(-percent * n // 100)) + 1):
        s = run[prefix_length(n, percent, m) - 1]
        c = s * (1 + verify / m)
        if cost is None or c < cost:
            best, cost = m, c
    return best


def features(texts: DataFrame, id_type: T.DataType, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """For each row: n, a 128-bit signature of its set (two longs), weight (mean estimated frequency of its shingles), its prefix
    and number of matches, and a bitmap of the parities of its shingles' buckets. Prefix tokens whose bucket
    holds one text only are left out: nothing can share them."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    shift = np.uint64(64 - (len(sketch).bit_length() - 1))
    long = T.LongType()
    schema = T.StructType([T.StructField("id", id_type), T.StructField("k1", long), T.StructField("k2", long), T.StructField("n", long), T.StructField("s1", long), T.StructField("s2", long), T.StructField("weight", T.FloatType()), T.StructField("prefix", T.ArrayType(long)), T.StructField("matches", T.IntegerType()), T.StructField("bitmap", T.ArrayType(long))])

    def lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values.view(np.int64)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        noise = float(counts.mean())
        noise += 3 * noise**0.5
        for b in batches:
            for lo, hi, data, off in wv.slices(b.column(3)):
                s = shingle_sets(data, off, k)
                rows, n, row = hi - lo, np.diff(s.first), s.row()
                some = np.flatnonzero(n > 0)
                at = s.first[:-1][some]

                def per_row(values, some=some, at=at, rows=rows):
                    out = np.zeros(rows, values.dtype)
                    if len(at):
                        out[some] = np.add.reduceat(values, at)
                    return out

                est = counts[(s.hash >> shift).astype(np.int64)]
                weight = per_row(est.astype(np.float64)) / np.maximum(n, 1)
                order = np.lexsort((s.hash, est, row))
                h, held = s.hash[order], est[order]
                partners = np.maximum(0.0, held - noise)
                picked, cut, matches = [], [0], []
                for i in range(rows):
                    a, m = s.first[i], int(n[i])
                    asked = choose_matches(partners[a : a + m], m, percent) if m else 1
                    upto = a + (prefix_length(m, percent, asked) if m else 0)
                    picked.append(h[a:upto][held[a:upto] > 1])
                    cut.append(cut[-1] + len(picked[-1]))
                    matches.append(asked)
                bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), BITS, MOST_BITS)
                base = np.concatenate([[0], np.cumsum(bits)])
                parity = np.bincount(base[row] + (s.hash.astype(np.int64) & (bits[row] - 1)), minlength=base[-1]) & 1
                bitmap = np.packbits(parity.astype(np.uint8)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).slice(lo, rows) for i in range(3)), pa.array(n), pa.array(per_row(wv.mix(s.hash)).view(np.int64)), pa.array(per_row(wv.mix(~s.hash)).view(np.int64)), pa.array(weight.astype(np.float32)),
                        lists(np.concatenate(picked) if picked else np.zeros(0, np.uint64), np.asarray(cut)), pa.array(matches, pa.int32()), lists(bitmap, base // 64),
                    ],
                    schema.names,
                )

    return texts.select("id", "k1", "k2", "t").mapInArrow(build, schema)


def linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``sets`` are similar to which of ``others``: exact sizes of intersections by products of 0/1 matrices."""
    values = np.concatenate([*sets, *others]) if sets or others else np.zeros(0, np.uint64)
    sizes = np.asarray([len(x) for x in [*sets, *others]])
    _, token, times = np.unique(values, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kept = times > 1
    column = np.cumsum(kept) - 1
    use = kept[token]
    doc, token = doc[use], column[token[use]]
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    both = np.zeros((len(sets), len(others)), np.float64)
    width = 2048
    for lo in range(0, int(kept.sum()), width):
        a, b = np.searchsorted(token, [lo, lo + width])
        m = np.zeros((len(sizes), width), np.float32)
        m[doc[a:b], token[a:b] - lo] = 1
        both += m[: len(sets)] @ m[len(sets) :].T
    union = sizes[: len(sets), None] + sizes[None, len(sets) :] - both
    return (100 * both >= percent * union) & (both > 0)


def _groups(link: np.ndarray) -> np.ndarray:
    """The least index of each row's component in a symmetric relation."""
    out = np.full(len(link), -1)
    for i in range(len(link)):
        if out[i] < 0:
            todo, out[i] = [i], i
            while todo:
                near = np.flatnonzero(link[todo.pop()] & (out < 0))
                out[near] = i
                todo += near.tolist()
    return out


def _bits_apart(a: Column, b: Column) -> Column:
    """In how many bits two bitmaps differ; where one has twice as many bits, its halves are laid over each other, which parities allow.
    0, which proves nothing, where sizes are further apart."""

    def fold(x: Column, n: Column) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) == n, x).when(F.size(x) == 2 * n, halves)

    n = F.least(F.size(a), F.size(b))
    each = F.zip_with(fold(a, n), fold(b, n), lambda u, v: F.bit_count(u.bitwiseXOR(v)).cast("long"))
    return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda t, x: t + x), F.lit(0).cast("long"))


def may_reach(na: Column, nb: Column, a: Column, b: Column, percent: int) -> Column:
    """False only for sets that surely are less similar: by size, and since sets differ in at least as many
    elements as their parity bitmaps do."""
    return F.when(100 * F.least(na, nb) >= percent * F.greatest(na, nb), _bits_apart(a, b) * (100 + percent) <= (100 - percent) * (na + nb)).otherwise(F.lit(False))


def _texts_of(keys: DataFrame, rows: DataFrame, repeated: bool, *by: str) -> DataFrame:
    """keys (k1, k2, ...; written already) with their texts. Where several rows share a key, one row for each key and ``by``."""
    found = rows.select("k1", "k2", "t").join(few(keys, keys.count()), ["k1", "k2"])
    return found.dropDuplicates(list(by)) if repeated else found


def ngram_classes(
    docs: DataFrame, k: int = 5, percent: int = 80, block: int = 256, crowd: int = 48, near: int = 50, sketch_bits: int = 22, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id_col, n_shingles, component_id, k1, k2, class) per row of docs.

    A text's set are its distinct shingles of k words (runs of anything but
    spaces and \\x09-\\x0D, A-Z in lower case); with fewer words, the whole
    sequence is the one shingle. Two rows link when percent % of the union of their
    sets is shared; component_id is the least id reachable by links. Rows
    without words (null and empty texts among them) have no shingles and are linked with nothing: their
    component is their own id, their class null. Repeated rows are linked like any equal rows.
    Null ids never are the least if a component has another. Very long texts are read whole, in
    one slice each. Ties between tokens of equal frequency go by hash, between leaders by signature. An empty
    table gives no rows; other columns of docs are not read, so their names cannot clash. Shingles are
    64-bit hashes, sets are known by 128-bit sums, and within the
    join by 64 of their bits that tell them all apart.

    1. A sketch of fixed size, made from all texts, orders shingles from rare to frequent. Each
    set takes a prefix of that order, and asks for as many shared prefix tokens as cost least
    (``choose_matches``): any two linked sets share at least the lesser of their two numbers.
    2. Every prefix token goes through one exchange that sums it up map-side to the least and the greatest set that
    holds it. What only one set holds goes, by a filter of bounded size; the other tokens' holders are the
    postings. Equal sets are one node from here on.
    3. A token's leader is its holder whose shingles are the most frequent. A node that shares enough prefix tokens with a
    leader for the pair to be a candidate joins the family of the leader it shares the most with. Families are
    verified by exact intersections, in tasks of at most ``block`` nodes and the leader; nodes that turn out
    not to be linked with it are held against all blocks of the family. So a crowd of near copies makes no pairs.
    4. Nodes of different families that share enough prefix tokens, are near enough in size and by a bitmap that
    bounds the intersection, and aren't linked through others yet, are verified pair by pair. Tokens with more than ``crowd``
    holders are dealt out in blocks. 5. Components of all links. Families only save work: every pair that may link
    lies in one family or goes through 4. ``near`` is the likeness that size and bitmap must allow within a family; above 100
    there are none.
    """
    small_batches(docs)
    rows = with_row_key(docs, id_col, text_col).select(F.col(f"d.`{id_col}`").alias("id"), "k1", "k2", "t")
    sketch = frequency_sketch(rows.select("t"), k, sketch_bits)
    sets = materialize(features(rows, docs.schema[id_col].dataType, sketch, k, percent), "sets")
    ids = materialize(sets.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("id"), F.min(F.struct("k1", "k2")).alias("key")), "node-ids")
    salt = 0
    while not ids.groupBy(_node(salt)).count().where("count > 1").isEmpty():
        salt += 1
    sets = sets.select("id", "k1", "k2", "n", _node(salt), "weight", "prefix", "matches", "bitmap")
    ids, keys = ids.select(_node(salt), "id"), ids.select(_node(salt), "key.k1", "key.k2")

    # One row speaks for equal sets, if the nodes are few enough to tell every task; else their postings are made equal below.
    repeated = not sets.groupBy("k1", "k2").count().where("count > 1").isEmpty()
    held_by = ids.count()
    once = held_by <= FEW and not repeated
    one = sets.join(F.broadcast(keys), ["node", "k1", "k2"], "left_semi") if held_by <= FEW else sets

    # Postings of the tokens that several sets hold, and their nodes.
    held = one.select(F.explode("prefix").alias("token"), "node").groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    held = materialize(held.where("low != high").select("token"), "shared-tokens")
    posts = _among_shared(one, held)
    posts = materialize(posts if once else posts.distinct(), "postings")
    known = materialize(posts.select("node").distinct(), "posted")
    nodes = one.join(few(known, known.count()), "node", "left_semi").select("node", "k1", "k2", "n", "matches", "bitmap")
    if not once:
        nodes = nodes.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("key"), *(F.first(c).alias(c) for c in ("n", "matches", "bitmap")))
        nodes = nodes.select("node", "key.k1", "key.k2", "n", "matches", "bitmap")
    nodes = materialize(nodes, "nodes")

    family = _families(posts, nodes, near)
    edges = _linked_in_families(family, nodes, rows, repeated, k, percent, block)

    # Links between families.
    pairs = materialize(_shared_tokens(posts, family, nodes, percent, block, crowd), "sharing-pairs")
    a, b = (nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "matches", "bitmap", "k1", "k2"))) for x in "ab")
    pairs = pairs.join(a, "a").join(b, "b").where(F.col("shared") >= F.least("matches_a", "matches_b"))
    pairs = pairs.where(may_reach(F.col("n_a"), F.col("n_b"), F.col("bitmap_a"), F.col("bitmap_b"), percent))
    pairs = materialize(pairs.select("a", "b", "n_a", "n_b", "k1_a", "k2_a", "k1_b", "k2_b"), "candidates")
    if not pairs.isEmpty():
        edges = edges.unionByName(_verified(pairs, components(edges), rows, repeated, k, percent))

    # Classes.
    roots = components(edges)
    label = materialize(ids.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "labels")
    least = label.groupBy("root").agg(F.min("id").alias("component_id"))
    label = materialize(label.join(materialize(least, "least-ids"), "root").select("node", "root", "component_id"), "classes")
    out = sets.select("id", "n", "k1", "k2", "node")
    alone = out.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "k1", "k2", F.lit(None).cast("long").alias("root"))
    out = out.where("n > 0").join(label, "node").select("id", "n", "component_id", "k1", "k2", "root").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "k1", "k2", F.col("root").alias("class"))


def _node(salt: int) -> Column:
    """A set's key: 64 bits of its 128, by a salt under which no two sets have the same."""
    return F.xxhash64(F.lit(salt), "s1", "s2").alias("node")


def _among_shared(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """(node, weight, token) of the prefix tokens that pass the filter of the shared ones: all of these, and a few of the others,
    which no second set holds and which therefore give no pair. On more tokens than the filter can tell apart more of
    the others pass; the result stays the same. weight is null where the token takes no part in making families: of a set with
    many postings every fourth token does, by its hash, which is enough to find a leader."""
    shared = sets.sparkSession.sparkContext.broadcast(token_filter(tokens))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            prefix = b.column(2)
            n = np.diff(prefix.offsets.to_numpy())
            token = prefix.flatten().to_numpy()
            there = passes(token.view(np.uint64), bits)
            row = np.repeat(np.arange(len(n)), n)[there]
            token = token[there]
            many = np.bincount(row, minlength=len(n))[row] >= 16
            weight = pa.array(b.column(1).to_numpy()[row], pa.float32(), mask=many & (token & 3 != 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), weight, pa.array(token)], ["node", "weight", "token"])

    return sets.select("node", "weight", "prefix").mapInArrow(pick, "node long, weight float, token long")


def _families(posts: DataFrame, nodes: DataFrame, near: int) -> DataFrame:
    """(node, head) of nodes that share enough prefix tokens with a leader; a head is in its own family. Written.

    A token's leader is summed map-side. Leaders rise strictly in (weight, node), so heads of
    heads end; one step up is taken, and who leads others stays with itself.
    """
    posts = posts.where("weight is not null")
    leads = posts.groupBy("token").agg(F.max(F.struct("weight", "node")).alias("lead")).select("token", F.col("lead.node").alias("lead"))
    leads = materialize(leads, "leaders")
    met = posts.join(few(leads, leads.count()), "token").where("node != lead")
    met = met.groupBy("node", "lead").agg(F.count("*").alias("shared"), F.max(F.col("token").bitwiseAND(3) != 0).alias("all"))
    # Where only every fourth token could be counted, each stands for four.
    best = met.groupBy("node").agg(F.max(F.struct("shared", "lead", "all")).alias("x")).select("node", "x.lead", F.when(F.col("x.all"), F.col("x.shared")).otherwise(4 * F.col("x.shared")).alias("shared"))
    x, y = (nodes.select(F.col("node").alias(c), *(F.col(v).alias(f"{v}_{c}") for v in ("n", "matches", "bitmap"))) for c in ("node", "lead"))
    best = materialize(best, "best-leaders").join(x, "node").join(y, "lead").where(F.col("shared") >= F.least("matches_node", "matches_lead"))
    best = best.where(may_reach(F.col("n_node"), F.col("n_lead"), F.col("bitmap_node"), F.col("bitmap_lead"), near))
    first = materialize(best.select("node", F.col("lead").alias("head")), "first-heads")
    up = first.select(F.col("node").alias("head"), F.col("head").alias("above"))
    raised = materialize(first.join(up, "head", "left").select("node", F.coalesce("above", "head").alias("head")), "raised-heads")
    both = raised.unionByName(raised.select(F.col("head").alias("node"), "head"))
    both = both.groupBy("node").agg(F.min(F.struct((F.col("node") != F.col("head")).alias("other"), "head")).alias("x"))
    return materialize(both.select("node", F.col("x.head").alias("head")), "families")


def _linked_in_families(family: DataFrame, nodes: DataFrame, rows: DataFrame, repeated: bool, k: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) that give the components within each family. Written."""
    sizes = family.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = family.join(materialize(sizes, "family-sizes"), "head").join(nodes.select("node", "k1", "k2"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    is_head = F.col("node") == F.col("head")
    placed = placed.select("*", is_head.alias("is_head"), F.explode(F.when(is_head, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"))
    placed = _texts_of(materialize(placed, "placed"), rows, repeated, "node", "block")

    def settle(got):
        sets = _sets_of(got.column("t").combine_chunks(), k)
        root = _groups(linked(sets, sets, percent))
        head = np.asarray(got.column("is_head").to_pylist(), bool)
        led = np.isin(root, root[head])
        first = np.where(led & head.any(), np.flatnonzero(head)[0] if head.any() else 0, root)
        node = got.column("node").combine_chunks()
        return pa.table({"node": node, "head": got.column("head"), "blocks": got.column("blocks"), "block": got.column("block"), "k1": got.column("k1"), "k2": got.column("k2"), "root": node.take(pa.array(first)), "led": pa.array(led)})

    local = placed.groupBy("head", "block").applyInArrow(settle, "node long, head long, blocks int, block int, k1 long, k2 long, root long, led boolean")
    local = materialize(local, "settled")
    edges = local.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    apart = local.where("blocks > 1 and not led")
    if not apart.isEmpty():
        edges = edges.unionByName(_held_against_family(apart, local, rows, repeated, k, percent, block))
    return edges


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs but for near duplicates: of each class the row of the least id stays, one of it if it is repeated."""
    classes = materialize(ngram_classes(docs, id_col=id_col, text_col=text_col, **options), "row-classes")
    linked_rows = classes.where("class is not null")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("k1"), F.col("k2"))
    stay = linked_rows.groupBy("class").agg(F.min(order).alias("o"), F.count("*").alias("held"))
    stay = materialize(stay.where("held > 1").select("class", "o.k1", "o.k2"), "class-heads")
    keys = linked_rows.select("class", "k1", "k2").groupBy("class", "k1", "k2").agg(F.count("*").alias("times"))
    keys = keys.join(stay.select("class", F.struct("k1", "k2").alias("head")), "class")
    keys = materialize(keys.select("k1", "k2", (F.struct("k1", "k2") == F.col("head")).alias("stays"), "times"), "class-keys")
    return without(docs, keys, id_col, text_col)


def _held_against_family(apart: DataFrame, local: DataFrame, rows: DataFrame, repeated: bool, k: int, percent: int, block: int) -> DataFrame:
    """Links of nodes that aren't linked with their family's head, with all blocks of the family: a task holds
    one block of either. Of a node's links into one settled group, one is kept."""
    counts = apart.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("teams"))
    counts = materialize(counts, "teams")
    asked = apart.join(counts, "head").select("head", F.pmod(F.xxhash64("node", F.lit(1)), F.col("teams")).cast("int").alias("team"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "root", "k1", "k2", F.lit(True).alias("asks"))
    there = local.join(counts, "head").select("head", F.explode(F.sequence(F.lit(0), F.col("teams") - 1)).alias("team"), "block", "node", "root", "k1", "k2", F.lit(False).alias("asks"))
    both = _texts_of(materialize(asked.unionByName(there), "held-against"), rows, repeated, "head", "team", "block", "node", "asks")

    def hold(got):
        sets = _sets_of(got.column("t").combine_chunks(), k)
        asks = np.asarray(got.column("asks").to_pylist(), bool)
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        link = linked([sets[i] for i in left], [sets[i] for i in right], percent)
        root = got.column("root").to_pylist()
        node = got.column("node").combine_chunks()
        kept = {(left[i], root[right[j]]): right[j] for i, j in zip(*np.nonzero(link))}
        return pa.table({"a": node.take(pa.array([i for i, _ in kept], pa.int64())), "b": node.take(pa.array(list(kept.values()), pa.int64()))})

    return materialize(both.groupBy("head", "team", "block").applyInArrow(hold, "a long, b long"), "family-links")


def _shared_tokens(posts: DataFrame, family: DataFrame, nodes: DataFrame, percent: int, block: int, crowd: int) -> DataFrame:
    """(a, b, shared) of pairs of nodes of different families with the number of prefix tokens that they share.

    A node without family is one of its own. Tokens are summed map-side to their number of holders and
    their least and greatest family; those of one family go. Of a token with at most ``crowd`` holders
    the pairs are joined; the holders of others meet in blocks, and only pairs near enough in size and bitmap come out.
    """
    held = posts.select("token", "node").join(few(family, family.count()), "node", "left").select("token", "node", F.xxhash64(F.coalesce("head", "node")).alias("fam"))
    held = materialize(held, "family-postings")
    mixed = held.groupBy("token").agg(F.count("*").alias("held"), F.min("fam").alias("low"), F.max("fam").alias("high")).where("low != high")
    mixed = materialize(mixed.select("token", "held"), "mixed-tokens")
    held = materialize(held.join(few(mixed, mixed.count()), "token"), "mixed-postings")
    some = held.where(F.col("held") <= crowd)
    a, b = (some.select("token", F.col("node").alias(x), F.col("fam").alias(f"fam_{x}")) for x in "ab")
    pairs = a.join(b, "token").where("a < b and fam_a != fam_b").select("a", "b")
    many = held.where(F.col("held") > crowd)
    if not many.isEmpty():
        # A token's largest family doesn't meet itself: its holders are dealt out over blocks that only meet those of the others.
        each = many.groupBy("token", "held", "fam").agg(F.count("*").alias("of")).groupBy("token", "held").agg(F.max(F.struct("of", "fam")).alias("x"))
        blocks = lambda n: F.ceil(n / block).cast("int")
        each = materialize(each.select("token", F.col("x.fam").alias("main"), blocks(F.col("held") - F.col("x.of")).alias("q"), blocks(F.col("x.of")).alias("p")), "crowds")
        in_main = F.col("fam") == F.col("main")
        own = F.when(in_main, F.col("q") + F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.pmod(F.xxhash64("node"), F.col("q"))).cast("int")
        many = many.join(few(each, each.count()), "token").join(nodes.select("node", "n", "bitmap"), "node").withColumn("own", own)
        # Of the others' q blocks each two, i <= j, meet, and each meets the p blocks behind them.
        other = F.sequence(F.lit(0), F.col("q") - 1 + F.when(in_main, 0).otherwise(F.col("p")))
        meet = F.transform(other, lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
        many = many.select("token", "node", "fam", "n", "bitmap", "own", F.explode(meet).alias("at")).select("token", "at.i", "at.j", "node", "fam", "n", "bitmap", "own")

        def meet_pairs(got):
            n, fam, own = (got.column(c).to_numpy() for c in ("n", "fam", "own"))
            i, j = got.column("i")[0].as_py(), got.column("j")[0].as_py()
            bitmap = got.column("bitmap").combine_chunks()
            wide, flat = np.diff(bitmap.offsets.to_numpy()), bitmap.flatten().to_numpy().view(np.uint64)
            first = np.cumsum(wide) - wide
            maps = {w: flat[first[wide == w][:, None] + np.arange(w)] for w in np.unique(wide)}
            at = np.zeros(len(n), np.int64)
            for w in maps:
                at[wide == w] = np.arange((wide == w).sum())

            def apart_from(x: int, y: np.ndarray) -> np.ndarray:
                """In how many bits x differs from each of y, as far as lengths allow to tell."""
                out = np.zeros(len(y), np.int64)
                own, w = maps[wide[x]][at[x]], int(wide[x])
                for v in np.unique(wide[y]):
                    some = wide[y] == v
                    other = maps[v][at[y[some]]]
                    if v == w:
                        out[some] = np.bitwise_count(other ^ own).sum(1, dtype=np.int64)
                    elif v == 2 * w:
                        out[some] = np.bitwise_count(other[:, :w] ^ other[:, w:] ^ own).sum(1, dtype=np.int64)
                    elif w == 2 * v:
                        out[some] = np.bitwise_count(other ^ own[:v] ^ own[v:]).sum(1, dtype=np.int64)
                return out

            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            out = []
            for x in left:
                y = right[right > x] if i == j else right
                y = y[fam[y] != fam[x]]
                y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
                y = y[apart_from(x, y) * (100 + percent) <= (100 - percent) * (n[y] + n[x])]
                out.append(np.stack([np.full(len(y), x), y]))
            pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            node = got.column("node").combine_chunks()
            return pa.table({"a": node.take(pa.array(pairs[0])), "b": node.take(pa.array(pairs[1]))})

        crowds = many.groupBy("token", "i", "j").applyInArrow(meet_pairs, "a long, b long")
        pairs = pairs.unionByName(crowds.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def _verified(pairs: DataFrame, roots: DataFrame, rows: DataFrame, repeated: bool, k: int, percent: int) -> DataFrame:
    """Of the pairs whose nodes aren't connected yet, those that link, by their sets of shingles."""
    for x in "ab":
        own = roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        pairs = pairs.join(own, x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    pairs = materialize(pairs.where("root_a != root_b").drop("root_a", "root_b"), "open-candidates")
    keys = pairs.select("a", "k1_a", "k2_a").unionByName(pairs.select(F.col("b").alias("a"), F.col("k1_b").alias("k1_a"), F.col("k2_b").alias("k2_a")))
    keys = materialize(keys.distinct().select(F.col("a").alias("node"), F.col("k1_a").alias("k1"), F.col("k2_a").alias("k2")), "candidate-keys")

    @F.arrow_udf("array<long>")
    def shingles(t: pa.Array) -> pa.Array:
        return pa.array([s.view(np.int64) for s in _sets_of(t, k)], pa.list_(pa.int64()))

    sets = materialize(_texts_of(keys, rows, repeated, "node").select("node", shingles("t").alias("h")), "candidate-sets")
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("h").alias(f"h_{x}")), x)
    both = F.size(F.array_intersect("h_a", "h_b"))
    return materialize(pairs.where((both > 0) & (100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))).select("a", "b"), "links")
