from pyspark.sql import functions as F

from pagelake.streaming import ingest


def test_sync_twice(spark, tmp_path):
    folder, base = tmp_path / "in", f"file://{tmp_path}"
    schema = "id long, k string, h string"
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], schema).coalesce(1).write.parquet(f"file://{folder}")
    got = []

    def run():
        stream = ingest.source(spark, f"file://{folder}", schema)
        ingest.sync(stream, f"{base}/state", F.col("k"), F.col("h"), "id", lambda rows, n: got.append(sorted(r["id"] for r in rows.collect())), f"{base}/cp").awaitTermination()

    run()
    spark.createDataFrame([(1, "a", "x"), (2, "b", "z"), (3, "c", "w")], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    run()
    assert got == [[1, 2], [2, 3]]


def test_a_batch_run_again_after_its_commit_keeps_its_output(spark, tmp_path):
    folder, base = tmp_path / "in", f"file://{tmp_path}"
    schema = "id long, k string, h string"
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], schema).coalesce(1).write.parquet(f"file://{folder}")
    sink = lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    def run():
        ingest.sync(ingest.source(spark, f"file://{folder}", schema), f"{base}/state", F.col("k"), F.col("h"), "id", sink, f"{base}/cp").awaitTermination()

    run()
    # As if the job had died between the state's commit and the stream's own.
    for name in ("0", ".0.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    run()
    assert spark.read.parquet(f"{base}/out").count() == 2


def test_throttle(spark, tmp_path):
    schema = "domain string, seq long, throttled boolean"
    spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, True)], schema).write.parquet(f"file://{tmp_path}/in")
    rows = ingest.throttle(ingest.source(spark, f"file://{tmp_path}/in", schema))
    q = rows.writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["domain"], r["seq"]): (r["consecutive"], r["delay"]) for r in spark.table("throttled").collect()}
    assert got == {("a", 1): (1, 2.0), ("a", 2): (2, 4.0), ("a", 3): (0, 0.0), ("a", 4): (1, 2.0), ("b", 1): (1, 2.0)}
