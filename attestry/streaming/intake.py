"""Batch and stream intake: row isolation, resume, and a file stream that runs
the same transforms as a batch job."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import safe_unions


def isolate(df: DataFrame, result: Column, problem: Column) -> DataFrame:
    """Add `result` and a row state.  A row with a problem text, or whose result is NULL,
    fails alone; expressions should be of the try_ kind so that no row ends the job."""
    r = df.withColumn("result", result).withColumn("__p", problem)
    bad = F.col("__p").isNotNull() | F.col("result").isNull()
    return r.select(*df.columns, F.when(~bad, F.col("result")).alias("result"),
                    F.when(bad, "failed").otherwise("completed").alias("state"),
                    F.when(bad, "processing_error").alias("error_code"),
                    F.when(bad, F.coalesce("__p", F.lit("no result"))).alias("error"))


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where("state = 'failed'")


def pending(rows: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Rows that have not been completed by an earlier run."""
    return rows.join(finished.where("state = 'completed'").select(key), key, "left_anti")


def run_stream(spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame],
               target: str, checkpoint: str) -> None:
    """Drive a streaming source through a batch transform into Parquet until the input
    is exhausted.  Each micro-batch owns one folder, so a replay after a failure
    replaces its own output; the checkpoint makes finished files stay finished."""
    safe_unions(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def file_source(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
