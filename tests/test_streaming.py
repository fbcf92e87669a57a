from __future__ import annotations

from pyspark.sql import functions as F

from lectern.streaming import attempts


def _events(df):
    return df.select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("user"), F.col("event_type").alias("section"), (F.col("value") < 10).alias("wrong"))


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{path}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(path)
    for fn, name in ((attempts.hourly_ledger, "ledger"), (attempts.study_sessions, "sessions")):
        q = fn(_events(stream)).writeStream.outputMode("complete" if name == "ledger" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {tuple(r) for r in spark.table(name).collect()}
        want = {tuple(r) for r in fn(_events(batch)).collect()}
        assert got <= want and got, name
        if name == "ledger":
            assert got == want
