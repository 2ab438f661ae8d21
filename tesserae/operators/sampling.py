"""Shards, batches, replication and seeded sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.sources.lineage import cut


def ranged(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """A number from 0 in a total order, without one task for all rows: range partitions, sorted, and offsets of their counts.

    The sorted partitions are written once. Range bounds are drawn anew whenever an exchange is planned and AQE may merge
    its partitions differently, so counts and rows must come from the same run. Equal keys are numbered in any order; nulls
    come first; an empty frame has no numbers.
    """
    parts = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    here = F.spark_partition_id()
    placed = cut(parts.withColumn("_p", here).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(here.cast("long"), 33)))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def contiguous_shards(df: DataFrame, order: list[str], world: int) -> DataFrame:
    """Shards of neighbours whose sizes differ by one at most, the larger ones first."""
    n = df.count()
    size, more = divmod(n, world)
    at = F.col("row")
    large = more * (size + 1)
    shard = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / max(size, 1)))
    return ranged(df, order).withColumn("shard", shard.cast("int"))


def rank_cache(df: DataFrame, order: list[str], world: int) -> DataFrame:
    """As many rows for each rank as all ranks can have; the remainder is dropped."""
    per = max(1, df.count() // world)
    return ranged(df, order).withColumn("rank", F.floor(F.col("row") / per).cast("int")).where(F.col("rank") < world)


def repeated(df: DataFrame, times: Column, place: Column, size: Column) -> DataFrame:
    """Below 1 a prefix of that share, from 1 on that many copies; more than one and not a whole number is an error."""
    times = F.when((times > 1) & (times != F.floor(times)), F.raise_error(F.lit("a repetition above 1 must be a whole number"))).otherwise(times)
    copies = F.when(times < 1, F.when(place < F.floor(size * times), 1).otherwise(0)).otherwise(F.floor(times))
    return df.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("bigint"), copies.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))


def seeded_order(*keys: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def sqrt_weights(sizes: DataFrame, n: str = "n") -> DataFrame:
    """Weights by the root of the size, adding up to 1; a row a data set."""
    total = sizes.agg(F.sum(F.sqrt(n)).alias("_t"))
    return sizes.join(F.broadcast(total)).withColumn("weight", F.sqrt(n) / F.col("_t")).drop("_t")


def weighted_draws(sizes: DataFrame, name: str, draws: int, seed: int = 0) -> DataFrame:
    """With replacement: a data set by its weight, then a row of it; `sizes` has name, n and weight, a row a data set."""
    w = W.orderBy(name)
    edges = sizes.withColumn("hi", F.sum("weight").over(w)).withColumn("lo", F.col("hi") - F.col("weight")).select(name, "n", "lo", "hi")
    spark = sizes.sparkSession
    u = spark.range(draws).select(F.col("id").alias("draw"), ((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("u"), F.xxhash64(F.lit(seed + 1), "id").alias("h"))
    return u.join(F.broadcast(edges), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", name, F.pmod("h", F.col("n")).alias("at"))


def megabatches(df: DataFrame, key: str, length: str, size: int, seed: int = 0) -> DataFrame:
    """A seeded order in chunks of `size`, each sorted from long to short."""
    shuffled = ranged(df.withColumn("_h", seeded_order(F.col(key), seed=seed)), ["_h", key], "_r").drop("_h")
    chunk = shuffled.withColumn("megabatch", F.floor(F.col("_r") / size))
    return chunk.withColumn("place", F.row_number().over(W.partitionBy("megabatch").orderBy(F.desc(length), key)) - 1).drop("_r")


def balanced(lengths: list[int], chunks: int) -> list[int]:
    """The chunk of each item: each goes to the least loaded one that isn't full; round robin if they can't be of one size."""
    n = len(lengths)
    if n % chunks:
        return [i % chunks for i in range(n)]
    load, room = [0] * chunks, [n // chunks] * chunks
    out = []
    for length in lengths:
        to = min((c for c in range(chunks) if room[c]), key=lambda c: load[c])
        out.append(to)
        load[to] += length
        room[to] -= 1
    return out


def balanced_chunks(df: DataFrame, length: str, key: str, chunks: int) -> DataFrame:
    """Balanced chunks within every megabatch, whose size is a parameter."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        return group.assign(chunk=balanced(group[length].astype(int).tolist(), chunks))[["megabatch", key, "chunk"]]

    return df.select("megabatch", "place", key, length).groupBy("megabatch").applyInPandas(run, f"megabatch long, {key} long, chunk int")


def full_batches(df: DataFrame, bucket: str, order: list[str], size: int) -> DataFrame:
    """Batches within a bucket; only full ones."""
    numbered = df.withColumn("_r", F.row_number().over(W.partitionBy(bucket).orderBy(*order)) - 1).withColumn("batch", F.floor(F.col("_r") / size))
    return numbered.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(bucket, "batch"))).where(F.col("_n") == size).drop("_r", "_n")


def turn_batches(rows: Iterator[tuple[str, int, object]], names: list[str], size: int) -> Iterator[tuple[int, str, object]]:
    """Batches of one data set and bucket, the data sets taking turns; a row that meets a full bucket out of turn is lost, as the sampler has it."""
    buckets: dict[tuple[str, int], list] = {}
    turn = batch = 0
    for name, bucket, row in rows:
        held = buckets.setdefault((name, bucket), [])
        if len(held) < size:
            held.append(row)
        if len(held) == size and names[turn % len(names)] == name:
            for r in held:
                yield batch, name, r
            held.clear()
            batch += 1
            turn += 1


def newest_first(df: DataFrame, conversation: str, turn: str, size: Column, limit: int) -> DataFrame:
    """The latest turns whose sizes together stay below the limit; sizes only add up, so a filter is the loop's break."""
    cum = F.sum(size).over(W.partitionBy(conversation).orderBy(F.desc(turn)).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("so_far", cum).where(F.col("so_far") < limit)


def k_shots(queries: DataFrame, pool: DataFrame, by: str, k: int) -> DataFrame:
    """The first k of the pool in a seeded order, by group, for every query of the group."""
    first = pool.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy("shot_order"))).where(F.col("_r") <= k)
    shots = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("shot_order", "shot"))).alias("shots"))
    return queries.join(shots, by, "left")
