"""Incremental ingest, beyond batch parity: new export files are parsed as they arrive and merged
into the day table by day. A batch that runs again gives the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dayloom.functions.exprs import KEY
from dayloom.operators.features import keep_one_per_day
from dayloom.sources import ingest, sinks


def merge_days(old: DataFrame | None, new: DataFrame, batch: int) -> DataFrame:
    """Rows of the later batch win; columns of both are kept."""
    new = new.withColumn("__batch", F.lit(batch))
    both = new if old is None else old.withColumn("__batch", F.lit(-1)).unionByName(new, allowMissingColumns=True)
    return keep_one_per_day(both, [F.desc("__batch")]).drop("__batch")


def versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Numbers of the table's versions, in order; one listing of the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/v=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(f.getPath().getName().partition("=")[2]) for f in found or ())


def stream_sleep(spark: SparkSession, folder: str, table_dir: str, checkpoint: str) -> StreamingQuery:
    """Watches a folder for sleep exports; version N of the table is table_dir/v=N."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", ingest.SLEEP_FILES).load(folder)
    docs = files.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = [n for n in versions(session, table_dir) if n < number]
        old = session.read.parquet(f"{table_dir}/v={before[-1]}") if before else None
        sinks.write_parquet(merge_days(old, ingest.parse_sleep(batch), number), f"{table_dir}/v={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table_dir: str) -> DataFrame:
    found = versions(spark, table_dir)
    if not found:
        raise FileNotFoundError(table_dir)
    return spark.read.parquet(f"{table_dir}/v={found[-1]}").orderBy(KEY)
