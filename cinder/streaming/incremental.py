"""Structured Streaming jobs.

S1 ``incremental_ingest``: files landing in a folder are picked up by a
file-source stream (``Trigger.AvailableNow`` processes what has landed, then
stops; the checkpoint remembers which files were done).  Each micro-batch is
merged into the (year, month) partitions it touches: existing rows whose key the
batch does not bring stay, of several rows for a key the one of the newest file
counts.  A month may thus arrive in any number of files and runs, and a replayed
batch changes nothing.

S2 ``incremental_annual_mask``: monthly scores -> ``max`` per (pixel, year).  The
batch's maxima are joined with the touched years of the table and the greater
value is kept, so the stream needs no state and no watermark: a month may arrive
at any time, years late or in any order, and replays are idempotent.

Both write the merged rows to the shared folder first, because the partitions
that are read are overwritten; rows are dealt to writers by partition values with
large partitions split (``REBALANCE``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinder.session import materialise
from cinder.schema import PIXEL_KEY
from cinder.sources.files import path_exists

def incremental_ingest(spark: SparkSession, landing: str, target: str, checkpoint: str,
                       schema: T.StructType, partition_cols=("year", "month"), key=PIXEL_KEY) -> None:
    """Ingest every file that has landed since the last run, then stop."""
    src = spark.readStream.schema(schema).parquet(landing).select("*", "_metadata.file_modification_time")
    keys = list(dict.fromkeys([*key, *partition_cols]))
    rest = [c for c in schema.fieldNames() if c not in keys]

    def write(batch: DataFrame, epoch_id: int) -> None:
        new = (batch.groupBy(*keys)
               .agg(F.max_by(F.struct(*rest), F.struct("file_modification_time", F.struct(*rest))).alias("_row"))
               .select(*keys, "_row.*"))
        if path_exists(spark, target):
            touched = new.select(*partition_cols).distinct()
            old = spark.read.parquet(target).join(touched, list(partition_cols), "left_semi")
            new = old.join(new, keys, "left_anti").select(*new.columns).unionByName(new)
        _overwrite_partitions(new, target, partition_cols)

    q = (src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    q.awaitTermination()


def _overwrite_partitions(rows: DataFrame, target: str, partition_cols) -> None:
    (materialise(rows, "stream-merge").hint("rebalance", *partition_cols)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(target))


def incremental_annual_mask(spark: SparkSession, landing: str, target: str, checkpoint: str,
                            schema: T.StructType, value_col: str = "p", threshold: float = 0.5,
                            key=PIXEL_KEY) -> None:
    """Fold newly landed monthly scores into the annual max / mask table."""
    src = spark.readStream.schema(schema).parquet(landing)
    keys = [*key, "year"]

    def merge(batch: DataFrame, epoch_id: int) -> None:
        value = F.col(value_col).cast("double")
        new = batch.groupBy(*keys).agg(F.max(F.when(~F.isnan(value), value)).alias("annual_max"))
        if path_exists(spark, target):
            old = (spark.read.parquet(target).join(new.select("year").distinct(), "year", "left_semi")
                   .select(*keys, F.col("annual_max").alias("_old")))
            new = new.join(old, keys, "full").select(*keys, F.greatest("annual_max", "_old").alias("annual_max"))
        _overwrite_partitions(new.withColumn("burned", (F.col("annual_max") >= threshold).cast("int")), target, ["year"])

    q = (src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    q.awaitTermination()
