"""Mixes sources to target weights, block by block, over output shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, with_row_key
from lectern.sources.tables import materialize


def targets(sizes: list[float], weights: list[float], share: float, stop: float) -> list[float]:
    """Splits share times the sum of sizes by weight; none gets over stop times its size, and the excess is split again."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > stop * sizes[i]]
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(stop * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """A row of quotas for each shard; columns sum to ``quotas`` exactly, rows are as even as whole blocks allow.

    The shards form a binary tree. Each node hands its left child a
    multivariate-hypergeometric draw of its own quotas, as if the blocks had
    been shuffled and cut, and the rest to the right child. A node's random
    numbers depend on the seed and the node alone.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, here = todo.pop()
        if hi - lo == 1:
            out[lo] = here
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        some = round(int(here.sum()) * (mid - lo) / (hi - lo))
        left = rng.multivariate_hypergeometric(here, some, method="marginals") if len(here) else here
        todo += [(lo, mid, left), (mid, hi, here - left)]
    return out


def running(df: DataFrame, key: str, order: str, tie: str, value: Column, *lead: str) -> DataFrame:
    """df with ``before``: the sum of value over the rows of the same key that come earlier by (lead, order, tie).

    order is a 64-bit hash. The sums of its 1,024 ranges are made map-side and put before what is summed
    within a range, so that no task orders a whole key.
    """
    at = [*lead, "piece"]
    df = df.withColumn("piece", F.shiftright(order, 54)).withColumn("value", value)
    sums = df.groupBy(key, *at).agg(F.sum("value").alias("total"))
    earlier = Window.partitionBy(key).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, *at, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy(key, *at).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    both = df.join(base, [key, *at])
    return both.withColumn("before", F.col("base") + F.coalesce(F.sum("value").over(inner), F.lit(0))).drop("piece", "value", "base")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    stop: float = 2.0,
    shards: int = 16,
    block_docs: int = 256,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row (id_col, source_col, size, source_size, target, taken, passes, part, shards, orders, k1, k2) per row of docs.

    size is the text's number of words (null: 0). Sources in code-point order,
    null last, get the weights in turn; see ``targets``. A source of n rows is
    cut by hash into blocks of about block_docs rows, at least four for each
    shard. A target of so many whole
    source sizes takes every block that often (``passes``); of the rest, blocks
    are taken in permuted order, and of the last block rows in permuted order,
    the last row in part (``part``: words of the last, partial pass). So a
    source's taken words equal its target rounded to a whole word, and no row
    gives more than ceil(stop) times its size. Each pass permutes anew.

    ``split_quotas`` deals every source's number of drawn blocks to the shards;
    a shard takes a run of the source's permuted draws, disjoint from all
    others. ``shards`` lists the shard of each copy of the row, ``orders`` the key that each copy is sorted by in its
    shard: that is the local shuffle, which ``shard_rows`` carries out. Everything
    follows from the seed, ids and texts, so reruns agree; repeated rows are
    rows of their own; draws and rows that tie in hash go by block or key. An empty table gives no rows; sources whose
    texts have no words take none. Null and empty texts have size 0 and give nothing; very long ones are counted whole. Other
    columns are not read, so their names cannot clash. The driver holds a row for each source, no more.
    """
    spark = docs.sparkSession
    keyed = with_row_key(docs, id_col, text_col)
    rows = keyed.select(F.col(f"d.`{id_col}`").alias("id"), F.col(f"d.`{source_col}`").alias("src"), "k1", "k2", F.regexp_count("t", F.lit(WORD)).cast("long").alias("size"))
    rows = materialize(rows, "sizes")
    found = [(r.src, r.n, r.size) for r in rows.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([r[2] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, stop)
    plan = []
    for i, ((src, n, size), target) in enumerate(zip(found, goal)):
        want = round(target)
        passes = want // size if size else 0
        plan.append((src, i, max(1, -(-n // block_docs), min(n, 4 * shards)), size, target, int(passes), int(want - passes * size)))
    sources = spark.createDataFrame(plan, "src string, si int, blocks int, source_size long, target double, passes int, rest long")
    placed = rows.join(F.broadcast(sources), rows.src.eqNullSafe(sources.src)).drop(sources.src)
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.col("blocks")).cast("int"))

    blocks = placed.groupBy("si", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = materialize(blocks.withColumn("order", F.xxhash64(F.lit(seed), "si", "block", "passes")), "block-sizes")
    blocks = running(blocks, "si", "order", "block", F.col("words"))
    blocks = blocks.withColumn("left", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before"))))
    blocks = materialize(blocks.select("si", "block", "words", "passes", "left"), "blocks")

    drawn = F.col("passes") + F.when(F.col("left") > 0, 1).otherwise(0)
    counted = {r.si: r.n for r in blocks.groupBy("si").agg(F.sum(drawn).alias("n")).collect()}
    quotas = np.asarray([counted.get(i, 0) for i in range(len(plan))], np.int64)
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    bounds = spark.createDataFrame([(i, [int(x) for x in ends[:, i]]) for i in range(len(plan))], "si int, ends array<long>")
    draws = blocks.where(drawn > 0).select("si", "block", F.explode(F.sequence(F.lit(0), drawn - 1)).alias("pass"))
    draws = draws.withColumn("order", F.xxhash64(F.lit(seed), "si", "block", "pass"))
    draws = running(draws, "si", "order", "block", F.lit(1), "pass").withColumnRenamed("before", "at").join(F.broadcast(bounds), "si")
    draws = draws.select("si", "block", "pass", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"))
    homes = draws.groupBy("si", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("homes"))
    homes = materialize(blocks.join(homes, ["si", "block"], "left").select("si", "block", "words", "left", "homes"), "homes")

    rows = placed.join(homes, ["si", "block"])
    cut = (F.col("left") > 0) & (F.col("left") < F.col("words"))
    inner = Window.partitionBy("si", "block").orderBy(F.xxhash64(F.lit(seed + 1), "k1", "k2"), "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    partly = rows.where(cut).withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    partly = partly.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("before")))).drop("before")
    whole = rows.where(~cut).withColumn("part", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0)))
    rows = whole.unionByName(partly)
    copies = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    home = F.slice(F.coalesce("homes", F.array().cast("array<int>")), F.lit(1), copies)
    return rows.select(
        F.col("id").alias(id_col), F.col("src").alias(source_col), "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), "passes", "part",
        home.alias("shards"), F.transform(home, lambda s, i: F.xxhash64(F.lit(seed), s, i, "k1", "k2")).alias("orders"), "k1", "k2",
    )


def shard_rows(mixed: DataFrame) -> DataFrame:
    """A row (shard, order, copy, words, ...) for each copy that the mix takes, dealt by shard and shuffled within it.

    words is how many leading words of the text the copy has. Rows that give no
    words are left out. A shard lies in eight partitions at most, by its keys' order.
    """
    each = mixed.where("taken > 0").select("*", F.posexplode("shards").alias("copy", "shard"))
    words = F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("part"))
    each = each.withColumn("words", words).withColumn("order", F.get("orders", F.col("copy"))).where("words > 0").drop("shards", "orders")
    return each.repartition("shard", F.shiftright("order", 61)).sortWithinPartitions("shard", "order", "k1", "k2")
