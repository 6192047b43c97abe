"""Incremental upkeep of fingerprints from a stream of bits.

The batch operators are the body of ``foreachBatch``. The table is cut into
buckets by a hash of the id. A micro-batch rewrites the buckets that its ids
fall into and no other file; a manifest per micro-batch says which files each
bucket has, so a replayed batch starts from the same files and a reader never
sees half a batch. Files that no kept manifest names are removed.

    folder/schema                       the table without rows
    folder/data/batch=N/bucket=B        what micro-batch N wrote
    folder/manifest/version=N           (bucket, batch) of the table after it
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.fingerprints import set_fingerprints
from kinfold.sources.writers import replace_rows

#: Buckets of a table. A bucket is rewritten whole, so there should be enough for a few hundred MB in each.
BUCKETS = 64


def upkeep(bits: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS, keep: int = 2) -> StreamingQuery:
    """Add the bits of each micro-batch of (id, bit) to the fingerprints of its ids.

    ``current`` reads the table. ``buckets`` must stay the same for one folder. The last ``keep``
    versions stay readable, 2 at least, since a replayed batch needs the one before. A batch without
    rows only writes a manifest; an id that is null has a bucket like any other.
    """
    if keep < 2:
        raise ValueError("a replayed batch needs the version before it: keep 2 at least")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        batch = batch.select("id", "bit").persist()
        if number == 0:
            set_fingerprints(batch).limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
        before = _manifest(spark, folder, number - 1) if number > 0 else {}
        touched = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        if touched:
            old = _rows(spark, folder, {b: before[b] for b in touched if b in before})
            known = old.join(batch.select("id").distinct(), "id", "left_semi").select("id", F.explode("ds").alias("bit"))
            new = replace_rows(old, set_fingerprints(batch.unionByName(known).distinct()))
            _write(new, bucket, f"{folder}/data/batch={number}")
        batch.unpersist()
        after = before | dict.fromkeys(touched, number)
        rows = spark.createDataFrame(sorted(after.items()), "bucket int, batch long").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{folder}/manifest/version={number}")
        _expire(spark, folder, number, keep)

    return bits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table after the last micro-batch, or after a kept earlier one."""
    if version is None:
        version = max(_versions(spark, folder))
    return _rows(spark, folder, _manifest(spark, folder, version))


def _write(rows: DataFrame, bucket: Column, path: str) -> None:
    named = rows.withColumn("bucket", bucket)
    named.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _rows(spark: SparkSession, folder: str, manifest: dict[int, int]) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/schema").schema
    paths = [f"{folder}/data/batch={n}/bucket={b}" for b, n in manifest.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """The batch that wrote each bucket: one row a bucket."""
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{folder}/manifest/version={version}").collect()}


def _files(spark: SparkSession, path: str):
    """The file system of a folder, which need not be local, and the folder there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose manifest is complete."""
    fs, at = _files(spark, f"{folder}/manifest")
    found = [s.getPath() for s in fs.listStatus(at)]
    done = [p.getName() for p in found if fs.exists(p.suffix("/_SUCCESS"))]
    return [int(name.removeprefix("version=")) for name in done]


def _expire(spark: SparkSession, folder: str, number: int, keep: int) -> None:
    """Remove manifests older than the last ``keep`` ones, and what only they name."""
    versions = _versions(spark, folder)
    old, kept = [v for v in versions if v <= number - keep], [v for v in versions if v > number - keep]
    if not old:
        return
    needed = {pair for v in kept for pair in _manifest(spark, folder, v).items()}
    gone = {pair for v in old for pair in _manifest(spark, folder, v).items()} - needed
    # the manifest goes last, so that a run that stops in between finds these files again
    for path in [f"{folder}/data/batch={n}/bucket={b}" for b, n in gone] + [f"{folder}/manifest/version={v}" for v in old]:
        fs, at = _files(spark, path)
        fs.delete(at, True)
