"""File streams: what is written already is passed over, as in a resumed batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def resumable(spark: SparkSession, source: str, schema: str, out: str, key: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run `work` over new parquet files in `source` and append to `out`; keys that `out` has are left as they are. Ends when no file is left."""

    def batch(df: DataFrame, number: int) -> None:
        todo = df.dropDuplicates([key])
        try:
            todo = todo.join(df.sparkSession.read.parquet(out).select(key).distinct(), key, "left_anti")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(todo).write.mode("append").parquet(out)

    s = spark.readStream.schema(schema).parquet(source)
    return s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
