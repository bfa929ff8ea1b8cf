"""From raw documents to a mix: quality, exact copies, near copies, benchmark passages, source weights.

Each stage takes all that its predecessor kept and returns the columns of
documents, all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import decontaminate
from lectern.llm.exact_dedup import one_of_each_text
from lectern.llm.mixing import mix_sources
from lectern.llm.ngram_join import one_of_each_class
from lectern.llm.quality import quality_classifier
from lectern.sources.tables import drop_paths, made, materialize, table


def _packed(docs: DataFrame) -> DataFrame:
    """The id, the text and the whole row, so that no added column can clash with one of the row's."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def _rows(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


# Of every stage: nulls may stand in any column, a null text counts as an empty one; very long texts are read whole; repeated
# rows are handled like any equal rows; a table without rows gives none; other columns are kept as they are, whatever their names.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go: those that score below 0.3. Empty texts score as the bias alone; equal texts, and
    so repeated rows, score alike; a score of exactly 0.3 stays; null ids are judged like others. Without rows there is nothing to
    learn from and nothing to judge."""
    return _rows(quality_classifier(_packed(docs), table(spark, sf_dir, "labels"), threshold=0.3).where("predicted = 1"), docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays; null texts are equal to empty ones. Of rows that tie in id and text,
    repeated rows, one stays; a null id loses against any other, and of several null ids one row stays."""
    return one_of_each_text(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a likeness of 0.8 in five-word shingles the row of the least doc_id stays; of repeated
    rows of that id and text one. Null and empty texts are in no class and all stay. A null id stays only if its class has no other."""
    return one_of_each_class(docs, k=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a run of ten words of a benchmark item, or with the whole of a shorter item, go. Null and empty texts have no
    words and stay; repeated rows go or stay together; null items are left out."""
    return _rows(decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), window=10).where("not contaminated"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each row, the shards its copies go to and the keys that shuffle them there, a row for each of docs. Null and empty texts have size 0 and
    give nothing; a null source is a source of its own, the last; draws that tie in hash go by key; of repeated rows each is
    drawn by itself."""
    return mix_sources(docs, weights=(5, 2, 1), share=1.5, stop=2.0).select("doc_id", "size", "source_size", "target", "taken", "shards", "orders")


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("mix", mix),
]

#: Neither the classifier nor the mix's draws can be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again. What a stage has written on its way, and the result
    before it, is dropped once its own result stands."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with made() as paths:
            docs = materialize(stage(spark, docs, sf_dir), name)
        drop_paths(spark, before + paths[:-1])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
