"""A store of stage tables: what a stage gives for each burst is written to a fixed number of hash buckets, and a manifest says
which commit of it counts.

    store/schemas/       stage, schema, since: one row for each commit
    store/data/<stage>/commit=<id>/bucket=<k>/
    store/manifest/      stage, burst_id, frames, commit, committed_at, gone: appended after the data of a commit

The number of files depends on the buckets and on the bytes, not on the bursts: a task writes about as many bytes as
spark.sql.adaptive.advisoryPartitionSizeInBytes has, so what it holds does not grow with the stage. A burst's rows are those of its last commit: writing a burst
again replaces it, whatever other bursts the commit has, and a job that dies before its manifest rows leaves nothing that
is read. Empty stages keep their schema. What no burst points to any more is deleted by vacuum()."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.settings import complete_analysis

MANIFEST = "stage string, burst_id long, frames long, commit string, committed_at timestamp, gone boolean"
SCHEMAS = "stage string, schema string, commit string, since timestamp"


class StageStore:
    """Stage tables under one path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _append(self, df: DataFrame, name: str) -> None:
        # as few files as their bytes need: one, unless there are very many rows
        df.hint("rebalance").write.mode("append").parquet(f"{self.path}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self._exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _hadoop(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf), at

    def _exists(self, path: str) -> bool:
        fs, at = self._hadoop(path)
        return fs.exists(at)

    def write(self, df: DataFrame, stage: str) -> DataFrame:
        """Commit the bursts of df(burst_id, ...) as rows of a stage and give them as read back; bursts that df lacks stay."""
        commit = uuid.uuid4().hex
        at = f"{self.path}/data/{stage}/commit={commit}"
        bucket = F.pmod(F.xxhash64("burst_id"), F.lit(self.buckets)).cast("int")
        # a bucket that is too large for one task is split among several
        df.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at)
        now = F.current_timestamp()
        self._append(self.spark.range(1).select(F.lit(stage).alias("stage"), F.lit(df.schema.json()).alias("schema"), F.lit(commit).alias("commit"), now.alias("since")), "schemas")
        back = self._read_commit(df.schema, stage, commit)
        frames = F.countDistinct("frame_idx") if "frame_idx" in df.columns else F.lit(1)
        made = back.groupBy(F.col("burst_id").cast("long").alias("burst_id")).agg(frames.cast("long").alias("frames"))
        self._append(made.select(F.lit(stage).alias("stage"), "burst_id", "frames", F.lit(commit).alias("commit"), now.alias("committed_at"), F.lit(False).alias("gone")), "manifest")
        return back

    def _read_commit(self, schema, stage: str, commit: str) -> DataFrame:
        whole = self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0)).schema
        return self.spark.read.schema(whole).parquet(f"{self.path}/data/{stage}/commit={commit}").select(*[f.name for f in schema])

    def live(self, stage: str | None = None) -> DataFrame:
        """stage, burst_id, frames, commit, committed_at: the commit that counts for each stage and burst."""
        m = self._table("manifest", MANIFEST)
        m = m if stage is None else m.where(F.col("stage") == stage)
        last = Window.partitionBy("stage", "burst_id").orderBy(F.desc("committed_at"), F.desc("commit"))
        return m.withColumn("k", F.row_number().over(last)).where("k = 1 and not gone").drop("k", "gone")

    def read(self, stage: str, burst_id: int | None = None) -> DataFrame:
        """All that counts of a stage, or one burst: only commits that a live burst points to are opened, and of these only
        the burst's bucket."""
        known = self._table("schemas", SCHEMAS).where(F.col("stage") == stage).orderBy(F.desc("since")).select("schema").first()
        if known is None:
            raise ValueError(f"no stage {stage}")
        schema, live = StructType.fromJson(json.loads(known[0])), self.live(stage)
        live = live if burst_id is None else live.where(F.col("burst_id") == burst_id)
        commits = sorted(r[0] for r in live.select("commit").distinct().collect())  # one for each writing job that still counts
        none = self.spark.createDataFrame([], schema)
        if not commits:
            return none
        top = f"{self.path}/data/{stage}"
        px = self.spark.read.schema(none.withColumns({"commit": F.lit(""), "bucket": F.lit(0)}).schema).option("basePath", top).parquet(*[f"{top}/commit={c}" for c in commits])
        if burst_id is not None:
            bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(burst_id).cast(schema["burst_id"].dataType)), F.lit(self.buckets))).first()[0]
            px = px.where((F.col("bucket") == bucket) & (F.col("burst_id") == burst_id))
        wanted = live.select(F.col("burst_id").alias("__burst"), F.col("commit").alias("__live"))
        px = px.join(wanted, (px["burst_id"] == F.col("__burst")) & (px["commit"] == F.col("__live")), "left_semi")
        return px.select(*[f.name for f in schema])

    def missing(self, bursts: DataFrame, stage: str) -> DataFrame:
        """burst_id of the bursts that have no committed rows in a stage: what is to be made again after a loss."""
        return bursts.select("burst_id").distinct().join(self.live(stage), "burst_id", "left_anti")

    def rebuild(self, bursts: DataFrame, stage: str, make) -> DataFrame:
        """The stage with make(burst_ids) written for the bursts that lack it, and only these; without any nothing is made."""
        lost = self.missing(bursts, stage)
        if lost.take(1):
            self.write(make(lost), stage)
        return self.read(stage)

    def complete(self, frames: DataFrame, *stages: str) -> DataFrame:
        """frames(burst_id, frame_idx) of which every stage has rows, as operators.settings.complete_analysis has them."""
        return complete_analysis(frames, *[self.read(s) for s in stages])

    def purge(self, now: str, hours: int = 24) -> None:
        """Let go of the bursts that no stage has committed within the last hours; their rows are no longer read."""
        live = self.live()
        fresh = live.groupBy("burst_id").agg(F.max("committed_at").alias("last")).where(F.col("last") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {int(hours)} hours"))
        stale = live.join(fresh, "burst_id", "left_anti")
        self._append(stale.select("stage", "burst_id", "frames", "commit", F.current_timestamp().alias("committed_at"), F.lit(True).alias("gone")), "manifest")

    def vacuum(self) -> int:
        """Delete the data of commits that no burst points to; gives how many went. Not while a stage is being written."""
        known = self._table("schemas", SCHEMAS).select("stage", "commit").distinct()
        dead = known.join(self.live(), ["stage", "commit"], "left_anti").collect()  # one row for each writing job
        gone = 0
        for r in dead:
            fs, at = self._hadoop(f"{self.path}/data/{r['stage']}/commit={r['commit']}")
            gone += bool(fs.delete(at, True))
        return gone
