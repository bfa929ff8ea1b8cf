"""The pipeline's stages on odd tables, and the whole run against plain Python."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lectern.llm import quality
from tests.llm.test_operators import ODD, classes_of, edited, frame, hits_of, prose, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = prose(4, 81, words=30)


def corpus():
    good, junk = prose(40, 82, words=60, vocabulary=3000), [" ".join([x] * 30) + " ### !!!" for x in prose(40, 83, words=1)]
    near = edited(good[:6], 0.05, 84, 3)
    leaks = [f"{a} {b}" for a, b in zip(prose(4, 85, words=20, vocabulary=3000), BENCH)]
    return good + junk + near + good[:3] + leaks + ODD + [None, "", "One  two"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark as the driver's tables are laid out."""
    out = str(tmp_path_factory.mktemp("tables"))
    texts = corpus()
    sources = [["b", "a", None, "c"][i % 4] for i in range(len(texts))]
    frame(spark, texts, sources).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def one_by_one(spark, folder):
    """(name, what goes in, what comes out) of every stage but the last; then the mix."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        yield name, docs, out
        docs = out
    yield cp.STAGES[-1][0], docs, cp.STAGES[-1][1](spark, docs, folder)


def test_run_against_plain_python(spark, folder):
    steps = {name: (before, after) for name, before, after in one_by_one(spark, folder)}
    assert list(steps) == ["quality", "exact_copies", "near_copies", "benchmark_passages", "mix"]
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == [c.split()[0] for c in SCHEMA.split(", ")], name

    before, after = (texts_of(x) for x in steps["quality"])
    score = quality.score(pa.array([before[i] for i in sorted(before)]), quality.fit(steps["quality"][0], spark.read.parquet(f"{folder}/labels.parquet")))
    assert set(after) == {i for i, s in zip(sorted(before), score) if s >= 0.3}
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 8 and np.mean([(i in after) == (i < 40) for i in held]) >= 0.9 and all(after[i] == before[i] for i in after)

    before, after = (texts_of(x) for x in steps["exact_copies"])
    last = {}
    for i in sorted(before):
        last[before[i] or ""] = i
    assert set(after) == set(last.values()) and len(after) < len(before)

    before, after = (texts_of(x) for x in steps["near_copies"])
    ids = sorted(before)
    assert set(after) == {ids[c] for c in {c for _, c in classes_of([before[i] for i in ids])}} and len(after) < len(before)

    before, after = (texts_of(x) for x in steps["benchmark_passages"])
    ids = sorted(before)
    assert set(after) == {i for i, h in zip(ids, hits_of([before[i] for i in ids], list(enumerate(BENCH)))) if not h[3]} and len(after) < len(before)

    mixed = {r.doc_id: r for r in steps["mix"][1].collect()}
    assert {i: r.size for i, r in mixed.items()} == {i: len(words(t)) for i, t in after.items()}
    run = {r.doc_id: r for r in cp.run(spark, folder).collect()}
    assert {i: (r.size, r.taken, tuple(r.shards)) for i, r in run.items()} == {i: (r.size, r.taken, tuple(r.shards)) for i, r in mixed.items()}


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_on_odd_tables(spark, folder, name, stage):
    """Nulls in every column, empty and very long texts, ties and repeated rows, no rows, and columns of clashing names."""
    rows = [(None, None, None, None, None), (1, None, "en", "a", 1), (2, "", "en", None, 0), (3, "x " * 100_000, "en", "a", 1), (4, "tie", "en", "a", 1), (4, "tie", "en", "a", 1), (5, "tie", None, "b", 1), (None, "tie", "en", "a", 1)]
    clash = {"d": F.lit(1), "t": F.lit(2), "k1": F.lit(3), "sig": F.lit(4), "a.b": F.lit(5), "row": F.lit(6), "size": F.lit(7), "score": F.lit(8), "kept": F.lit(9), "items": F.lit(10)}
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(clash)
    out = stage(spark, docs, folder)
    got = out.collect()
    if name == "mix":
        assert sorted(r["size"] for r in got) == [0, 0, 0, 1, 1, 1, 1, 100_000]
    else:
        assert out.columns == docs.columns
        assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()} and all(r["a.b"] == 5 and r["size"] == 7 for r in got)
        if name == "exact_copies":
            assert sorted((str(r.doc_id), r.text and r.text[:3]) for r in got) == [("2", ""), ("3", "x x"), ("5", "tie")]
        if name == "near_copies":
            assert sorted((str(r.doc_id), r.text and r.text[:3]) for r in got) == [("1", None), ("2", ""), ("3", "x x"), ("4", "tie"), ("None", None)]
        if name == "benchmark_passages":
            assert len(got) == len(rows)
    assert stage(spark, docs.where("false"), folder).count() == 0
