"""Scoring of records as they arrive: a stream of JSON lines or Parquet files, appended once a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import anls


def predictions(spark: SparkSession, folder: str, schema: T.StructType, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(form).load(folder)


def scored(stream: DataFrame) -> DataFrame:
    """pred_id, source, score of every answered record."""
    return stream.where("answer is not null and size(annotation) > 0").select("pred_id", "source", anls(F.col("annotation"), F.col("answer")).alias("score"))


def resume_into(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Appends rows whose key the output doesn't have; a batch that is run again writes nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        from tesserae.sources.sinks import append_and_resume

        append_and_resume(batch.sparkSession, batch.dropDuplicates([key]), path, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
