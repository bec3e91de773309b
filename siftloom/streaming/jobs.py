"""Streaming forms of the chunked jobs: running name counts, append-only filters, state across runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import codes
from siftloom.sources import files


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream over the Parquet files of `table` in a folder."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def stream_counts(source: DataFrame, column: str, path: str, checkpoint: str) -> None:
    """Counts per value over all that has arrived; each trigger replaces the table at `path`."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    counts = source.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("name")).groupBy("name").count()
    counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_filter(source: DataFrame, cell: Column, path: str, checkpoint: str) -> None:
    """Rows whose cell holds a wanted code, appended once each however often the job is restarted."""
    source.where(codes.comma_cell_matches(cell)).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def stored_constraints(spark: SparkSession, store: str) -> DataFrame:
    """(kind, a, b) of all that `stream_constraints` has put into the store, each pair once; empty where there is no store yet."""
    from siftloom.operators.feedback import union_constraints

    empty = spark.createDataFrame([], "kind string, a string, b string")
    return union_constraints(empty, spark.read.parquet(store).select("kind", "a", "b")) if files.exists(spark, store) else empty


def stream_constraints(source: DataFrame, store: str, checkpoint: str) -> None:
    """Add arriving constraints (kind, a, b) to the store; `stored_constraints` reads it, each pair once.

    A batch is a folder of its own, which only the same batch replaces when it is replayed: no failed read or write can harm what is there.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.select("kind", "a", "b").distinct().write.mode("overwrite").parquet(f"{store}/batch={number}")

    source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
