"""Filling fixed-capacity training sequences with records (minimum bin slack).

Lengths are whole tokens of at most the capacity, so the records are first counted by length: a histogram whose
size is bounded by the capacity, whatever the number of records. On it the longest remaining length anchors a
sequence, a bitset of reachable sums over the remaining lengths (bounded multiples, by binary splitting) gives the
sum closest to the capacity, and the counts of that sum are backtracked. The multiset found is used as often as the
counts allow before the next one is sought. Records are then numbered within their length, in hash buckets with
offsets so that a length shared by a third of all records is no one task's work (there are more buckets the more
records there are), and take their places by number.

A record longer than the capacity, and only such a one, is divided: pieces of full capacity and a rest that is
packed like any other. A length that is null, not positive or below what the text alone must have is replaced by an
estimate from the text and its images, and marked; there is no upper bound, as neither data nor reference have one.

Defined cases: null or empty conversations have the estimate of their images, at least one token; repeated rows are
packed each; ties between sums cannot occur and between lengths the longer comes first; an empty table gives no
rows; every record is in the result for every budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import cut

#: Tokens of one image tile, of the marks of a turn, and characters a token.
TILE, TURN, LATIN, CJK = 256, 4, 3.6, 1.1
#: Records a hash bucket of a length holds at most, about, if all have that length; and buckets at least.
BUCKET_ROWS, BUCKETS = 1_000_000, 64


def reach(counts: dict[int, int], target: int) -> tuple[int, dict[int, int]]:
    """The sum closest to `target` from below that the lengths can make, and how many of each make it."""
    mask = (1 << (target + 1)) - 1
    bits = 1
    steps: list[tuple[int, int, int]] = []  # length, multiple, sums reachable before
    for length in sorted((x for x in counts if x <= target and counts[x] > 0), reverse=True):
        left, chunk = min(counts[length], target // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & mask
            left -= take
            chunk *= 2
        if bits >> target & 1:
            break
    best = bits.bit_length() - 1
    uses: dict[int, int] = {}
    at = best
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            uses[length] = uses.get(length, 0) + take
    return best, uses


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Sequences to make: how many, their fill, and their lengths with multiples."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    made: list[tuple[int, int, dict[int, int]]] = []
    while counts:
        anchor = max(counts)
        counts[anchor] -= 1
        best, uses = reach(counts, capacity - anchor)
        counts[anchor] += 1
        uses[anchor] = uses.get(anchor, 0) + 1
        times = min(counts[length] // n for length, n in uses.items())
        for length, n in uses.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        made.append((times, best + anchor, uses))
    return made


def usable_lengths(df: DataFrame) -> DataFrame:
    """row_id, n_tokens, estimated: the length as given where it can be, else an estimate."""
    texts = F.filter(F.transform("conversations", lambda t: t["value"]), lambda v: v.isNotNull())
    # one token a few letters, about one a CJK character
    size = F.aggregate(texts, F.lit(0.0), lambda a, v: a + (F.length(v) - F.length(wide := F.regexp_replace(v, r"[^぀-ヿ㐀-鿿]+", ""))) / LATIN + F.length(wide) * CJK)
    words = F.coalesce(size, F.lit(0.0))
    turns = F.coalesce(F.greatest(F.size("conversations"), F.lit(0)), F.lit(0))
    images = F.coalesce(F.greatest(F.size("image"), F.lit(0)), F.lit(0)) + F.col("video").isNotNull().cast("int")
    guess = F.greatest(F.lit(1), F.ceil(words).cast("int") + turns * TURN + images * TILE)
    good = F.col("length").isNotNull() & (F.col("length") >= 1) & (F.col("length") >= words * 0.5)
    return df.select(F.col("row_id").cast("long").alias("row_id"), F.when(good, F.col("length")).otherwise(guess).cast("int").alias("n_tokens"), (~good).alias("estimated"))


def pieces(lengths: DataFrame, budgets: DataFrame) -> DataFrame:
    """Every record for every budget, divided only where it is longer than the capacity. The budgets are a fixed table."""
    each = lengths.join(F.broadcast(budgets.select("budget_name", F.col("capacity").cast("int").alias("capacity")).where("capacity > 0")))
    last = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1
    return each.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "size", F.when(F.col("piece") < last, F.col("capacity")).otherwise(F.col("n_tokens") - F.col("capacity") * last).cast("int")
    )


def buckets(rows: int) -> int:
    """Hash buckets within a length: as many as keep even a length that all records have from being one task's work."""
    return max(BUCKETS, 1 << (max(rows, 1) // BUCKET_ROWS).bit_length())


def sequences(conversation: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_name, seq_id, row_id, piece, n_tokens (of the piece), estimated, fill (of the sequence), capacity."""
    spark = conversation.sparkSession
    many = buckets(conversation.count())
    items = pieces(usable_lengths(conversation), budgets).withColumn("bucket", F.pmod(F.xxhash64("row_id", "piece"), F.lit(many)).cast("int"))
    sizes = cut(items.groupBy("budget_name", "capacity", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))  # used twice
    before = W.partitionBy("budget_name", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("budget_name", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    # at most capacity rows a budget, however many records there are
    histogram: dict[tuple[str, int], dict[int, int]] = {}
    for r in sizes.groupBy("budget_name", "capacity", "size").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault((r["budget_name"], r["capacity"]), {})[r["size"]] = r["n"]
    names = sorted(histogram)
    span = max((c for _, c in names), default=0) + 1
    keys, starts, uses, bases, fills = [], [], [], [], []
    for k, (name, capacity) in enumerate(names):
        taken: dict[int, int] = {}
        base = 0
        for times, fill, parts in plan(histogram[name, capacity], capacity):
            for size, n in parts.items():
                keys.append(k * span + size)
                starts.append(taken.get(size, 0))
                uses.append(n)
                bases.append(base)
                fills.append(fill)
                taken[size] = taken.get(size, 0) + n * times
            base += times
    order = np.lexsort((np.array(starts, np.int64), np.array(keys, np.int64))) if keys else np.zeros(0, np.int64)
    room = 1 << 40
    table = spark.sparkContext.broadcast(  # as long as the plan, which the capacity bounds
        (
            {n: k for k, (n, _) in enumerate(names)},
            span,
            room,
            np.array(keys, np.int64)[order] * room + np.array(starts, np.int64)[order],
            np.array(starts, np.int64)[order],
            np.array(uses, np.int64)[order],
            np.array(bases, np.int64)[order],
            np.array(fills, np.int64)[order],
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, span, room, edges, starts, uses, bases, fills = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            budget = np.array([index[n] for n in batch.column(0).to_pylist()], np.int64)
            size, rank = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(6).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(edges, (budget * span + size) * room + rank, "right") - 1
            seq = bases[at] + (rank - starts[at]) // uses[at]
            yield pa.record_batch(
                [batch.column(0), pa.array(seq), batch.column(2), batch.column(3), batch.column(4), batch.column(5), pa.array(fills[at].astype(np.int32)), batch.column(1)],
                ["budget_name", "seq_id", "row_id", "piece", "n_tokens", "estimated", "fill", "capacity"],
            )

    inside = W.partitionBy("budget_name", "size", "bucket").orderBy("row_id", "piece")
    ranked = (
        items.withColumn("own", F.row_number().over(inside) - 1)
        .join(offsets, ["budget_name", "size", "bucket"])
        .select("budget_name", "capacity", "row_id", "piece", "size", "estimated", (F.col("own") + F.col("offset")).cast("long").alias("rank"))
    )
    return ranked.mapInArrow(place, "budget_name string, seq_id long, row_id long, piece int, n_tokens int, estimated boolean, fill int, capacity int")


def fill_report(conversation: DataFrame, budgets: DataFrame) -> DataFrame:
    """Sequences and unused tokens of every budget."""
    packed = sequences(conversation, budgets)
    each = packed.groupBy("budget_name", "capacity", "seq_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return each.groupBy("budget_name", "capacity").agg(F.count(F.lit(1)).alias("sequences"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("fill_share"))
