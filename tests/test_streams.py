from pyspark.sql import functions as F

from twinsift.streaming.arrivals import copies_by_window, first_copies, with_digest

SCHEMA = "name string, arrived timestamp, content string"
ROWS = [("a", "2026-01-01 00:00:00", "x"), ("b", "2026-01-01 00:01:00", "x"), ("c", "2026-01-01 00:02:00", "y"), ("d", "2026-01-03 00:00:00", "z")]


def stream(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "name string, arrived string, content string").withColumn("arrived", F.to_timestamp("arrived"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return with_digest(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name)


def test_first_copies(spark, tmp_path):
    out = run(spark, first_copies(stream(spark, tmp_path)), "firsts", "append")
    assert sorted(r["digest"] for r in out.collect()) == sorted({r["digest"] for r in out.collect()}) and out.count() == 3


def test_copies_by_window(spark, tmp_path):
    out = run(spark, copies_by_window(stream(spark, tmp_path)), "copies", "append")
    assert [(r["copies"], r["wasted"]) for r in out.collect()] == [(2, 1)]
