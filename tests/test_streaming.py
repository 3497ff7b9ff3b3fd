from pyspark.sql import functions as F

from loomline.plans import views
from loomline.streaming import sessions


def test_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    calls = views.calls(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "tool_name")
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    for name, f in (("facts", sessions.session_facts), ("weeks", sessions.weekly_counts)):
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        got, want = spark.table(name), f(calls)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
