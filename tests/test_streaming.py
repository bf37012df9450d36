"""The stream of arrivals gives the batch answer, whatever the order, and ends aborted bursts."""

import datetime as dt
import tempfile

from burstlake.streaming import bursts

SCHEMA = "burst_id long, capture_ts timestamp, status string"


def run(spark, batches, expected=3):
    top = tempfile.mkdtemp(prefix="spark-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{top}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    q = bursts.assemble(stream, expected=expected).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return [(r.burst_id, r.status, r.n) for r in spark.read.schema(bursts.OUT).parquet(f"{top}/out").collect()]


def test_complete_aborted_and_failed(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    first = [(1, t(2), "ok"), (1, t(0), "ok"), (2, t(1), "ok"), (3, t(1), "ok")]
    second = [(1, t(1), "ok"), (2, t(2), "error")]
    got = run(spark, [first, second, [(9, dt.datetime(2024, 1, 2), "ok")], [(9, dt.datetime(2024, 1, 2), "ok")]])
    assert sorted(got) == [(1, "complete", 3), (2, "aborted", 1), (3, "failed", 1)]


def test_a_burst_ends_once(spark):
    """Three good frames come after an error, and two more after completion: neither burst ends again, nor when time is up."""
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    later = [(9, dt.datetime(2024, 1, 2), "ok")]
    got = run(spark, [[(1, t(0), "error"), (2, t(0), "ok"), (2, t(1), "ok"), (2, t(2), "ok")], [(1, t(1), "ok"), (1, t(2), "ok"), (1, t(3), "ok"), (2, t(3), "ok"), (2, t(4), "ok")], later, later])
    assert sorted(got) == [(1, "aborted", 0), (2, "complete", 3)]


def test_late_frames_go_to_the_side(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    top = tempfile.mkdtemp(prefix="spark-")
    for rows in ([(1, t(0), "ok"), (1, t(1), "ok"), (2, t(0), "error")], [(1, t(2), "ok"), (1, t(3), "error"), (2, t(1), "ok")], [(1, t(4), "ok")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{top}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    q = bursts.assemble(stream, expected=2, side=True).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.burst_id, r.status, r.n) for r in spark.read.schema(bursts.OUT).parquet(f"{top}/out").collect())
    assert got == [(1, "complete", 2), (1, "late", 1), (1, "late", 2), (2, "aborted", 0), (2, "late", 1)]


def test_a_failed_batch_is_processed_once(spark):
    """The process fails after it has written; the batch is replayed, and a third run finds all through."""
    top = tempfile.mkdtemp(prefix="spark-")
    shape = "burst_id long, status string"
    spark.createDataFrame([(1, "complete"), (2, "complete"), (3, "failed")], shape).coalesce(1).write.mode("append").parquet(f"{top}/in")
    stream = lambda: spark.readStream.schema(shape).parquet(f"{top}/in")
    calls = []

    def process(ids, fail):
        calls.append(sorted(r.burst_id for r in ids.collect()))
        if fail:
            raise RuntimeError("cut off")

    try:
        bursts.process_completed(stream(), lambda ids: process(ids, True), f"{top}/state", f"{top}/ledger").awaitTermination()
    except Exception as e:
        assert "cut off" in str(e)
    bursts.process_completed(stream(), lambda ids: process(ids, False), f"{top}/state", f"{top}/ledger").awaitTermination()
    assert calls == [[1, 2], [1, 2]]
    bursts.process_completed(stream(), lambda ids: process(ids, False), f"{top}/other", f"{top}/ledger").awaitTermination()  # the whole batch again
    assert calls == [[1, 2], [1, 2]]
