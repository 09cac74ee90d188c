"""Streams merged into a keyed table: last writer wins (M1), and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartomill.operators.relational import last_writer_wins


BUCKET = "_bucket"


def upsert_stream(stream: DataFrame, target: str, keys: list[str], stamp: str, checkpoint: str, buckets: int = 64) -> None:
    """Merge all there is of a stream into a parquet table, batch by batch.

    The table is kept in buckets by hash of the key, each a folder of the version that
    wrote it last: a batch reads and writes the buckets it has rows of, and no others. A
    batch that runs again after a failure reads older versions only and writes the same
    again. Of a bucket the version before the last is kept for that, older ones go.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(BUCKET, bucket)
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        before = _versions(spark, target, number)
        paths = [before[b][-1] for b in touched if b in before]
        merged = last_writer_wins(_read(spark, paths, rows.schema), rows, keys, stamp)
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{target}/version={number}")
        for b in touched:
            for old in before.get(b, [])[:-1]:
                _path(spark, old)[1].delete(_path(spark, old)[0], True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, target: str, below: int | None = None) -> dict[int, list[str]]:
    """Folders of each bucket, oldest version first; at most some per bucket, as older ones are removed."""
    path, fs = _path(spark, target)
    out: dict[int, list[tuple[int, str]]] = {}
    for v in fs.listStatus(path) if fs.exists(path) else []:
        name = v.getPath().getName()
        if name.startswith("version=") and (below is None or int(name.split("=")[1]) < below):
            for b in fs.listStatus(v.getPath()):
                if b.getPath().getName().startswith(f"{BUCKET}="):
                    out.setdefault(int(b.getPath().getName().split("=")[1]), []).append((int(name.split("=")[1]), b.getPath().toString()))
    return {b: [p for _, p in sorted(v)] for b, v in out.items()}


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    names = [n for n in schema.names if n != BUCKET]
    if not paths:
        return spark.createDataFrame([], schema)
    # a bucket's number is in its folder's name only
    plain = spark.read.schema(StructType([schema[n] for n in names])).parquet(*paths)
    return plain.withColumn(BUCKET, F.regexp_extract(F.input_file_name(), BUCKET + "=([0-9]+)", 1).cast("int")).select(*schema.names)


def latest(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table after the last batch."""
    paths = [v[-1] for v in _versions(spark, target).values()]
    return spark.read.schema(schema).parquet(*paths).select(*schema.names) if paths else spark.createDataFrame([], schema)


def windowed_counts(stream: DataFrame, stamp: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts by tumbling window; rows later than the watermark allows are dropped by the engine."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width), *keys).count()
