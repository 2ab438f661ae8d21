"""Sinks. Large results stay in parts; only summaries become one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def keyed_map(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value a key, the last by `order`."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def append_summary(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def by_shard(df: DataFrame, path: str, shard: str = "shard") -> None:
    """A folder a shard."""
    df.repartition(shard).write.mode("overwrite").partitionBy(shard).parquet(path)


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not in an output that an earlier run left."""
    return df.join(done.select(key), key, "left_anti")


def written(spark: SparkSession, path: str) -> bool:
    """Whether there is an output with rows at the path; any error but its absence is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(at))


def append_and_resume(spark: SparkSession, df: DataFrame, path: str, key: str) -> None:
    """Writes what an earlier run hasn't; of the output only the keys are read."""
    rest = remaining(df, spark.read.parquet(path), key) if written(spark, path) else df
    rest.write.mode("append").parquet(path)


def blanks_last(df: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """The value of an earlier output where it has one, else the new one."""
    kept = old.where(F.col(value).isNotNull() & (F.trim(value) != "")).select(key, F.col(value).alias("_old"))
    return df.join(kept, key, "left").withColumn(value, F.coalesce("_old", value)).drop("_old")


def json_array(df: DataFrame, path: str) -> None:
    """One JSON array a file, its rows in the order of the partition; a small result is one partition."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(_as_array, "value string").write.mode("overwrite").text(path)


def _as_array(batches):
    import pyarrow as pa

    before = None
    yield pa.record_batch([pa.array(["["])], ["value"])
    for batch in batches:
        for row in batch.column(0).to_pylist():
            if before is not None:
                yield pa.record_batch([pa.array([before + ","])], ["value"])
            before = row
    yield pa.record_batch([pa.array([before] * (before is not None) + ["]"], pa.string())], ["value"])


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the new result that the old one doesn't have."""
    return new.exceptAll(old)
