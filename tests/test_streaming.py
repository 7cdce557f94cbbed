from datetime import datetime, timedelta

from loomgraph.streaming import console

SCHEMA = "ts timestamp, level string, file string, message string"


def rows():
    start = datetime(2024, 1, 1)
    return [(start + timedelta(seconds=20 * i), ("ERROR", "INFO")[i % 2], f"f{i}", "m") for i in range(12)]


def test_level_counts_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    batch = sorted(tuple(r) for r in console.level_counts(df).collect())
    assert sum(r[2] for r in batch) == 12
    df.write.parquet(str(tmp_path / "in"))
    stream = console.level_counts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("levels").collect()) == batch


def test_visible_and_answers(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert console.visible(df, ["ERROR"]).count() == 6 and console.visible(df).count() == 12
    tokens = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "answer int, pos int, token string")
    assert {r.answer: r.text for r in console.answers(tokens).collect()} == {1: "ab", 2: "c"}
