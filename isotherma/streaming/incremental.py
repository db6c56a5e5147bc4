"""Incremental append (S6) as a file stream that processes what is new and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.writers import append_new


def append_stream(spark: SparkSession, source: str, schema: StructType, key: str, target: str, state: str) -> StreamingQuery:
    """Run once over the files not seen before and append the rows whose key the target lacks.

    ``state`` remembers the files; the keys are those of the target itself, so the state does not grow with them, a batch reads the keys of
    its own buckets only, and one that is repeated after a failure adds nothing.
    """

    def append(batch: DataFrame, _: int) -> None:
        append_new(batch, target, key)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
