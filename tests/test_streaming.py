"""The audit log as a stream gives the rows of the batch."""

from pyspark.sql import functions as F

from lectern.streaming import audit


def test_stream_counts(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    rows = audit.hourly(audit.stream(spark, str(tmp_path / "in")))
    q = rows.writeStream.outputMode("complete").format("memory").queryName("audit_hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("audit_hours").agg(F.sum("n"), F.sum("errors")).first()
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert tuple(got) == (events.count(), events.where("event_type = 'error'").count())


def test_stream_of_repeated_events(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{sf}/events.parquet")
    for part in ("a", "b"):
        events.write.parquet(str(tmp_path / "in" / part))
    rows = audit.once(audit.stream(spark, str(tmp_path / "in" / "*"), "3650 days"))
    q = rows.writeStream.outputMode("append").format("memory").queryName("audit_once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("audit_once").count() == events.count()
