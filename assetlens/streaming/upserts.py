"""A keyed table in buckets that micro-batches are merged into; only the buckets that a batch touches are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.operators.merge import upsert
from assetlens.scratch import remove


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str, below: int | None = None) -> list[int]:
    """Numbers of the manifests that are complete, those below a number if one is given."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = sorted(int(p.getName()[2:]) for p in done)
    return [n for n in numbers if below is None or n < below]


def manifest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """bucket -> version of its files, as the newest complete manifest (below a number) has it. At most one entry per bucket."""
    numbers = _versions(spark, path, below)
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/v={numbers[-1]}").collect()} if numbers else {}


def _files(path: str, at: dict[int, int]) -> list[str]:
    return [f"{path}/data/v={v}/bucket={b}" for b, v in sorted(at.items())]


def merge_batch(batch: DataFrame, number: int, path: str, key: str, seq: str, latest: list[str], buckets: int = 64) -> None:
    """Merges a batch as version `number`. Data first, the manifest last: a run that is cut off leaves the version before, and a replay writes the same again.

    The touched buckets are at most `buckets` numbers. Bucket files that neither this manifest nor the one before names are removed.
    """
    spark = batch.sparkSession
    if number in _versions(spark, path):
        return  # replayed after its commit
    before = manifest(spark, path, number)
    batch = batch.withColumn("bucket", bucket_of(key, buckets))
    touched = {r["bucket"] for r in batch.select("bucket").distinct().collect()}
    old = {b: v for b, v in before.items() if b in touched}
    rows = batch.drop("bucket")
    current = spark.read.option("mergeSchema", "true").parquet(*_files(path, old)) if old else rows.limit(0)
    merged = upsert(current, rows, key, seq, latest).withColumn("bucket", bucket_of(key, buckets))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={number}")
    now = before | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(now.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={number}")
    older = _versions(spark, path, number)
    if len(older) > 1:  # the manifest two steps back goes, and what only it named
        for f in set(_files(path, manifest(spark, path, older[-1]))) - set(_files(path, before)) - set(_files(path, now)):
            remove(spark, f)
        remove(spark, f"{path}/manifest/v={older[-2]}")


def upsert_stream(stream: DataFrame, path: str, key: str, seq: str, latest: list[str], checkpoint: str, buckets: int = 64, available_now: bool = True):
    """A query that merges each micro-batch into the table at path; see merge_batch() and merge.upsert()."""
    w = stream.writeStream.foreachBatch(lambda b, n: merge_batch(b, n, path, key, seq, latest, buckets)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table as its newest manifest has it; a ValueError if nothing has been merged."""
    at = manifest(spark, path)
    if not at:
        raise ValueError(f"nothing has been merged into {path}")
    return spark.read.option("mergeSchema", "true").parquet(*_files(path, at))
