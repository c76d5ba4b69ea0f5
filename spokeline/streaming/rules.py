"""Rule programs over streams. A compiled program is a projection, so it runs on a stream as on a table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeline.rules import Program, apply
from spokeline.session import Scratch


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def decide_stream(stream: DataFrame, program: Program, variables: Mapping[str, Any] | None = None) -> DataFrame:
    return apply(stream, program, variables)


def windowed_counts(stream: DataFrame, at: str, by: list[str], size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by window and group; windows close when the watermark has passed them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there now and give back what it wrote: one table in the shared folder."""
    scratch = Scratch(stream.sparkSession)
    place = f"{scratch.folder}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(place)
