"""A first-seen vocabulary that grows while rows arrive.

The table is a folder of versions, one per micro-batch.  A bucket keeps the value
of the first batch that brought one; inside a batch the smallest order wins.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import safe_unions


def first_in_batch(batch: DataFrame, bucket: list[str], value: list[str], order: list[str]) -> DataFrame:
    return batch.groupBy(*bucket).agg(F.min_by(F.struct(*value), F.struct(*order)).alias("__f")).select(*bucket, "__f.*")


def grow(spark: SparkSession, source: DataFrame, bucket: list[str], value: list[str], order: list[str],
         target: str, checkpoint: str) -> None:
    safe_unions(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = first_in_batch(batch, bucket, value, order)
        if batch_id > 0:  # earlier versions only, so that a replayed batch gives the same rows
            known = batch.sparkSession.read.parquet(target).where(F.col("batch") < batch_id)
            fresh = fresh.join(known.select(*bucket), bucket, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
