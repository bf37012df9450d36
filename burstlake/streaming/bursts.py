"""Bursts assembled as their frames arrive."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "burst_id long, status string, n int, first_ts timestamp, last_ts timestamp"
STATE = "n int, first_ts timestamp, last_ts timestamp, seen_ts timestamp, closed boolean"


def assemble(frames: DataFrame, expected: int = 8, least: int = 2, late: str = "10 minutes", side: bool = False) -> DataFrame:
    """burst_id, status, n, first_ts, last_ts of a stream frames(burst_id, capture_ts, status), one row for each burst that ends.

    complete: `expected` good frames have come. aborted: a frame came with status "error"; what was held is dropped. failed:
    the watermark passed with fewer than `least` good frames; expired: with fewer than expected. A burst ends once: frames
    that come in a batch after its end are passed over or, with side, told in rows of status "late", one for each batch with
    their number and times. State is bounded by the bursts that have frames within the watermark."""
    zone = frames.sparkSession.conf.get("spark.sql.session.timeZone")

    def step(key, batches, state: GroupState):
        n, first, last, seen, closed = state.get if state.exists else (0, None, None, None, False)
        if state.hasTimedOut:
            state.remove()
            if closed:
                return
            yield pd.DataFrame({"burst_id": [key[0]], "status": ["failed" if n < least else "expired"], "n": [n], "first_ts": [first], "last_ts": [last]})
            return
        status = None
        for b in batches:
            seen = b["capture_ts"].max() if seen is None else max(seen, b["capture_ts"].max())
            if closed:
                if side:
                    yield pd.DataFrame({"burst_id": [key[0]], "status": ["late"], "n": [len(b)], "first_ts": [b["capture_ts"].min()], "last_ts": [b["capture_ts"].max()]})
                continue
            if (b["status"] == "error").any():
                status = "aborted"
            good = b[b["status"] != "error"]
            n += len(good)
            if len(good):
                first = good["capture_ts"].min() if first is None else min(first, good["capture_ts"].min())
                last = good["capture_ts"].max() if last is None else max(last, good["capture_ts"].max())
        if status is None and n >= expected and not closed:
            status = "complete"
        if status is not None:
            yield pd.DataFrame({"burst_id": [key[0]], "status": [status], "n": [n], "first_ts": [first], "last_ts": [last]})
        state.update((n, first, last, seen, closed or status is not None))
        ahead = int(pd.Timestamp(seen).tz_localize(zone, ambiguous=False, nonexistent="shift_forward").timestamp() * 1000)  # naive, in the session's zone
        state.setTimeoutTimestamp(max(ahead, state.getCurrentWatermarkMs()) + 1)

    timed = frames.withColumn("capture_ts", F.col("capture_ts").cast("timestamp")).withWatermark("capture_ts", late)
    return timed.groupBy("burst_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def process_completed(assembled: DataFrame, process: Callable[[DataFrame], None], checkpoint: str, ledger: str):
    """Call process(ids) for the bursts that each micro-batch completes; returns the running query.

    The ledger, a table of (burst_id, batch), says which bursts are through: it is written after process has returned. A batch
    that is replayed passes on only bursts that the ledger lacks, so nothing is
    processed again once it is through, and a batch that failed is processed whole. process itself may be cut off half way
    and called again, so it should write by burst, as StageStore does."""
    spark = assembled.sparkSession
    shape = "burst_id long, batch long"
    spark.createDataFrame([], shape).write.mode("append").parquet(ledger)  # so that there is a table to read

    def each(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        through = own.read.schema(shape).parquet(ledger)
        ids = batch.where("status = 'complete'").select("burst_id").distinct().join(through, "burst_id", "left_anti")
        ids = ids.persist()
        try:
            if ids.take(1):
                process(ids)
                ids.select("burst_id", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(ledger)
        finally:
            ids.unpersist()

    return assembled.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
