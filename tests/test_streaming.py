import numpy as np
from pyspark.sql import functions as F

from orthant.operators.quantile import exact_tree
from orthant.streaming.leaves import windowed_leaf_counts
from orthant.streaming.moments import median_of, stream_moments


def _run(query_df, mode, name, spark):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_moments_of_a_stream(spark, tmp_path):
    x = np.random.default_rng(0).beta(2, 5, 4000)
    spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    row = _run(stream_moments(stream, "x", 24, 0.0, 1.0), "complete", "moments", spark)[0]
    assert row["count"] == 4000
    assert abs((x <= median_of(row["count"], row["sums"], 0.0, 1.0)).mean() - 0.5) < 0.02


def test_leaf_counts_by_window(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
    df.write.parquet(str(tmp_path / "in"))
    tree = exact_tree(df, ["x"], 2)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    rows = _run(windowed_leaf_counts(stream, tree, "at", "1 hour", "10 minutes"), "complete", "leaves", spark)
    assert sum(r["count"] for r in rows) == 100 and {r["leaf"] for r in rows} == {0, 1, 2, 3}
