"""A folder of loose blobs as a stream: new files are opened once, whatever their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orelode.operators.extract import decode_textures, unpack, with_flags

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """New files below ``folder``; the same contents within an hour count once."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return rows.withWatermark("modificationTime", "1 hour").withColumn("sha1", F.sha1("content")).dropDuplicatesWithinWatermark(["sha1"])


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str) -> StreamingQuery:
    """Records of all files that are there now and weren't before, appended to ``output`` as Parquet."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        blobs = rows.select(F.lit("stream").alias("rom_id"), F.lit(batch_id).cast("int").alias("file_idx"), F.array().cast("array<int>").alias("seq"), F.col("path").alias("chain"), F.col("content").alias("payload"))
        with_flags(decode_textures(unpack(blobs, "fused"))).drop("seq").write.mode("append").parquet(output)

    return watch(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
