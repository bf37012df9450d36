"""The stage store: replaced, lost, empty and stale bursts."""

import glob

import pytest
from pyspark.sql import functions as F

from burstlake.sources import frames, stages


@pytest.fixture
def store(spark, tmp_path):
    return stages.StageStore(spark, f"file://{tmp_path}", 4)


def rows(spark, bursts, v=1.0, frames_=2):
    return spark.createDataFrame([(b, f, v) for b in bursts for f in range(frames_)], "burst_id long, frame_idx int, v double")


def test_last_commit_of_a_burst_counts(spark, store):
    store.write(rows(spark, range(40)), "raw")
    store.write(rows(spark, [3, 50], 2.0, 1), "raw")
    got = {(r.burst_id, r.frame_idx): r.v for r in store.read("raw").collect()}
    assert len(got) == 39 * 2 + 2 and got[3, 0] == got[50, 0] == 2 and (3, 1) not in got and got[4, 1] == 1
    assert store.read("raw", 3).count() == 1 and store.read("raw", 99).count() == 0
    assert [(r.burst_id, r.frames) for r in store.live("raw").where("burst_id in (3, 4)").orderBy("burst_id").collect()] == [(3, 1), (4, 2)]


def test_files_follow_buckets_and_not_bursts(spark, store, tmp_path):
    store.write(rows(spark, range(300)), "raw")
    assert len(glob.glob(f"{tmp_path}/data/raw/*/bucket=*/*.parquet")) <= 4


def test_empty_stages_read_back_with_their_schema(spark, store, tmp_path):
    none = rows(spark, [1]).where("false")
    assert store.write(none, "none").count() == 0 and store.read("none").schema == none.schema and store.read("none").count() == 0
    assert frames.write_stage(none, f"file://{tmp_path}/plain").schema == none.schema
    with pytest.raises(ValueError):
        store.read("unknown")


def test_a_lost_stage_is_made_again_alone(spark, store):
    whole, made = rows(spark, range(6)), []
    store.write(whole.where("burst_id != 2"), "rob")

    def make(lost):
        made.append(sorted(r.burst_id for r in lost.collect()))
        return whole.join(lost, "burst_id", "left_semi").withColumn("v", F.lit(9.0))

    got = {r.burst_id: r.v for r in store.rebuild(whole, "rob", make).collect()}
    assert made == [[2]] and got == {b: 9.0 if b == 2 else 1.0 for b in range(6)}
    store.rebuild(whole, "rob", make)
    assert made == [[2]]


def test_frames_without_a_part_are_left_out(spark, store):
    whole = rows(spark, range(3), frames_=3)
    store.write(whole, "rob")
    store.write(whole.where("not (burst_id = 1 and frame_idx = 2) and not (burst_id = 2 and frame_idx > 0)"), "cov")
    got = sorted(map(tuple, store.complete(whole.select("burst_id", "frame_idx"), "rob", "cov").collect()))
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def test_stale_bursts_go_and_their_data_is_deleted(spark, store, tmp_path):
    store.write(rows(spark, [1, 2]), "raw")
    store.write(rows(spark, [2]), "cov")
    store.purge("2000-01-01", 24)
    assert store.read("raw").count() == 4 and store.vacuum() == 0
    store.purge("2999-01-01", 24)
    assert store.read("raw").count() == store.read("cov").count() == 0 and store.vacuum() == 2
    assert not glob.glob(f"{tmp_path}/data/*/*/bucket=*")
    store.write(rows(spark, [1]), "raw")
    assert store.read("raw").count() == 2


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """What one task holds must not grow with the stage."""
    one, key = stages.StageStore(spark, f"file://{tmp_path}", 1), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    px = spark.range(0, 80000, 1, 8).select((F.col("id") % 50).alias("burst_id"), F.lit(0).alias("frame_idx"), F.rand(1).alias("v"))
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        back = one.write(px, "raw")
    finally:
        spark.conf.set(key, before)
    assert len(glob.glob(f"{tmp_path}/data/raw/*/bucket=0/*.parquet")) > 1 and back.count() == one.read("raw").count() == 80000
    assert one.read("raw", 7).count() == 1600 and one.live("raw").count() == 50
