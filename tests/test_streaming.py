"""Keyed states, stop signals and failed items of the batch queue."""

from pyspark.sql import functions as F

from docproof import streaming

EVENT = "item_id string, position int, status string, at int"


def run_states(spark, folder, table, checkpoint):
    """All that is new in the folder goes through the kept states; the rows that changed."""
    stream = streaming.track(spark.readStream.schema(EVENT).parquet(folder))
    stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(180)


def test_states_go_on_after_a_restart(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = [("a", 0, "ready", 1), ("a", 0, "processing", 2), ("b", 1, "ready", 1), ("c", 2, "match", 1), ("d", 3, "ready", 2), ("d", 3, "processing", 1), ("e", 4, "invalid", 1)]
    second = [("a", 0, "error", 3), ("b", 1, "cancelled", 2), ("e", 4, "processing", 2), ("c", 2, "ready", 5)]
    third = [("a", 0, "processing", 4), ("a", 0, "match", 5), ("b", 1, "processing", 3), ("a", 0, "review", 6)]
    for rows in (first, second, third):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)
        run_states(spark, folder, table, checkpoint)
    last = spark.read.parquet(table).groupBy("item_id").agg(F.max_by(F.struct("status", "attempts", "refused", "position"), F.struct("attempts", "refused", F.coalesce("at", F.lit(0)))).alias("s"))
    got = {r.item_id: tuple(r.s) for r in last.collect()}
    assert got == {"a": ("match", 2, 1, 0), "b": ("processing", 1, 0, 1), "c": ("ready", 0, 1, 2), "d": ("ready", 0, 1, 3), "e": ("invalid", 0, 1, 4)}


def test_queue_parts_good_and_failed_and_stops(spark, tmp_path):
    def work(payload):
        if payload == "3":
            raise TimeoutError("a submitted value")
        if payload == "4":
            raise ConnectionRefusedError
        return str(10 // (int(payload) - 5))

    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    items = spark.createDataFrame([(k, str(k), str(k)) for k in range(8)], "position int, item_id string, payload string")
    items.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(items.schema).parquet(folder)
    streaming.start_queue(stream, work, out, checkpoint).awaitTermination(180)
    rows = {r.item_id: r for r in streaming.settled(spark, out).collect()}
    assert {k: (r.outcome, r.error) for k, r in rows.items() if r.outcome != "good"} == {"3": ("failed", "timeout"), "4": ("failed", "unavailable"), "5": ("failed", "processing")}
    assert rows["7"].value == "5" and all(r.value is None for r in rows.values() if r.outcome == "failed")
    streaming.start_queue(stream, work, out, str(tmp_path / "again")).awaitTermination(180)
    assert streaming.settled(spark, out).count() == 8  # the same batch once more doubles nothing
    more = spark.createDataFrame([(8, "8", "8"), (9, "9", "9")], "position int, item_id string, payload string")
    more.coalesce(1).write.mode("append").parquet(folder)
    streaming.start_queue(stream, work, out, checkpoint, stop=lambda: True).awaitTermination(180)
    every = streaming.in_order(items.unionByName(more).unionByName(spark.createDataFrame([(10, "10", "x")], items.schema)), streaming.settled(spark, out)).collect()
    assert [r.position for r in every] == list(range(11)) and [r.status for r in every][-4:] == ["fulfilled", "skipped", "skipped", "skipped"]
