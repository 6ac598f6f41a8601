"""Change feeds over an append-only version log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def changes_since(log: DataFrame, tx: int) -> DataFrame:
    """Versions after ``tx``, deletions among them."""
    return log.where(F.col("tx") > tx)


def subscribe(spark: SparkSession, path: str, schema: StructType, since: int = 0) -> DataFrame:
    """The feed as a stream over a folder of Parquet files; the checkpoint is the cursor."""
    return changes_since(spark.readStream.schema(schema).parquet(path), since)


def follow(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("id", "tx")):
    """Apply a feed to a follower's folder, keeping the leader's transactions; runs until there is no more.

    A batch that comes again after a failure replaces itself, as its folder is named by its number.
    A version that another batch has brought is left out; only the files that can hold the batch's
    transactions are looked into for it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates(list(keys)).persist()
        try:
            new = own
            path = spark._jvm.org.apache.hadoop.fs.Path(target)
            if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
                held = spark.read.schema(StructType([*own.schema.fields, StructField("batch", LongType())])).parquet(target).where(F.col("batch") != number)
                if "tx" in keys:
                    low, high = own.agg(F.min("tx"), F.max("tx")).first()
                    held = held.where(F.col("tx").between(low, high))
                new = own.join(held.select(*keys), list(keys), "left_anti").select(*own.columns)
            new.write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            own.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Tumbling counts by event time with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
