"""Document rules, intermediate tables, verification rows."""

from pyspark.sql import functions as F

from lectern.functions import schemas
from lectern.operators import digest
from lectern.sources.tables import drop_materialized, materialize, shared_dir


def test_closed_documents(spark):
    df = spark.createDataFrame([('{"a":1,"t":2}',), ("{}",), ("no",), (None,)], "j string")
    got = df.select(schemas.unknown_keys(F.col("j"), ("a",)).alias("u"), schemas.missing_keys(F.col("j"), ("a", "b")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(["t"], ["b"]), ([], ["a", "b"]), (None, None), (None, None)]


def test_violations(spark):
    df = spark.createDataFrame([("asr", "asr"), ("captions", "robot"), (None, "auto")], "source string, kind string")
    assert [r.broken for r in schemas.violations(df, "transcript").collect()] == [["kind"], ["source"]]
    assert spark.range(1).select(schemas.as_json(F.struct(F.lit(None).cast("int").alias("x")))).first()[0] == '{"x":null}'


def test_types_are_spark_types(spark):
    for ddl in schemas.TYPES.values():
        assert spark.createDataFrame([], ddl).columns


def test_verification(spark):
    a = spark.createDataFrame([(1, "q", True), (1, "", True), (1, "r", False), (1, None, None)], "talk_id long, quote string, grounded boolean")
    r = spark.createDataFrame([(1, 0.5, ["x"])], "talk_id long, recall double, missing array<string>")
    got = digest.verification(a, r, "talk_id").first()
    assert (got.quotes_total, got.quotes_grounded, got.token_recall, got.weak) == (2, 1, 0.5, True)


def test_materialized_tables_can_be_dropped(spark):
    import os

    df = materialize(spark.range(3).withColumn("x", F.array(F.col("id"))), "three")
    assert df.count() == 3 and dict(df.dtypes)["x"] == "array<bigint>"
    drop_materialized(spark)
    assert not os.path.exists(f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}")
