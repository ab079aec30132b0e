"""Small helpers shared by the text operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import scratch_path

#: columns of the documents table; pipeline stages return exactly these
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a (narrow) table to the shared folder and read it back: a lineage cut that lost executors can't undo."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows to a batch between Spark and Python: whole texts are long, and workers keep what their largest batch took."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_out(doc_id):
    """True for a quarter of the ids, never used to learn; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def first_by_hash(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """A bounded sample: the n rows whose keyed hash is smallest (ties by key), the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def by_runs(df: DataFrame, keys: list[str], answer, schema: str) -> DataFrame:
    """Apply `answer(table) -> table or None` to the rows of each key, many keys per Arrow batch.

    For large numbers of small groups whose size is bounded: rows are dealt and
    sorted by the (non-null, numeric) keys, and a task holds one batch and the
    run it cuts.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            changed = np.zeros(max(t.num_rows - 1, 0), bool)
            for k in keys:
                v = t.column(k).to_numpy()
                changed |= v[1:] != v[:-1]
            edges = [0, *(np.nonzero(changed)[0] + 1).tolist()]
            out = [x for a, b in zip(edges, edges[1:]) if (x := answer(t.slice(a, b - a))) is not None]
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
            held = t.slice(edges[-1]).combine_chunks()
        if held is not None and (x := answer(held)) is not None:
            yield from x.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
