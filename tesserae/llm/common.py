"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.lineage import checkpoint_folder, cut

__all__ = ["UNKNOWN", "checkpoint_folder", "cut", "language", "load", "map_arrow", "source_key", "spread"]

#: Labels of the slices that have no usable language, domain or source.
UNKNOWN = "unknown"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Give Python work enough tasks: shuffle only when a scan has fewer splits than the cluster has cores.

    Only for scans with narrow steps on them: the count of partitions of anything behind an exchange would run it. At scale
    a scan has far more splits than cores and the plan stays without an exchange.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores * 2)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def language(col):
    """`en_x`, ` en`, `EN` and `en-US` are `en`; what is left empty is null."""
    code = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def source_key(col):
    """Spellings of a source differ in case, blanks and separators."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), r"[\s\-./]+", "_"), r"^_+|_+$", "")
    return F.when(key != "", key)
