"""Mixing sources to target weights.

The tokens of every document of a source with a target are counted and added up by source and block, a block being a
hash bucket of the source's documents. From the sums of the sources the largest mixture follows in which every source with
documents has its target share and no document is used more than its cap: the size at which the first source reaches its
cap. A `total` asks for another size instead; a source that its cap does not let come to its share then gives what it can,
and the report shows it. A source's quota is whole passes over its blocks and, for the rest, blocks in a seeded order; the
last of them is used up to the quota, by parts and then document by document. A splitting tree deals the block uses out:
at every node the counts of the sources are divided among two halves of the shards by a multivariate hypergeometric draw,
so that the quotas are kept exactly and every shard has a fair part of every source. Every shard is then shuffled locally.

There are about as many blocks of a source as documents in a block, and as many shards as hold SHARD_TOKENS each. The
driver sees sums of at most MOST_BLOCKS blocks a target and the parts of one block of each, never documents.

Defined cases: documents without text or tokens, or of a source without a target, are not used; target shares are
scaled to the sources that have tokens; a null or missing cap is 1; repeated documents are documents of their own;
an empty table gives no rows; a quota is met but for half the size of one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import cut, source_key, spread
from tesserae.llm.encoding import pattern, read_ranks, vocabulary_path

#: Blocks of a source at least and at most, and parts of a block.
LEAST_BLOCKS, MOST_BLOCKS, PARTS = 16, 4096, 1024
#: Tokens of a shard, and shards at least and at most.
SHARD_TOKENS, LEAST_SHARDS, MOST_SHARDS = 1 << 20, 8, 1 << 16
#: So many block uses are sent to every task; more are joined by a shuffle.
FEW = 200_000

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SEED = 20

_COUNTERS: dict = {}


def _tokenizer(path: str):
    if path not in _COUNTERS:
        import tiktoken

        _COUNTERS[path] = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=read_ranks(path), special_tokens={})
    return _COUNTERS[path]


def measured(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of the documents with text."""
    path = path or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                encode = _tokenizer(path).encode_ordinary
                sizes = pa.array([len(encode(t)) for t in batch.column(2).to_pylist()], pa.int64())
                yield pa.record_batch([batch.column(0), batch.column(1), sizes], ["doc_id", "source", "n_tokens"])

    rows = documents.where(F.col("text").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    return spread(rows).mapInArrow(run, "doc_id long, source string, n_tokens long")


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens each source is to give: of `total`, or of the largest mixture with the target shares under the caps."""
    present = {s: (share, max(cap or 1, 1)) for s, (share, cap) in targets.items() if share and share > 0 and tokens.get(s, 0) > 0}
    whole = sum(share for share, _ in present.values())
    if not present:
        return {}
    size = min(cap * tokens[s] / (share / whole) for s, (share, cap) in present.items()) if total is None else total
    return {s: min(round(size * share / whole), cap * tokens[s]) for s, (share, cap) in present.items()}


def blocks_of(documents: int) -> int:
    """About as many blocks as documents in a block."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (int(max(documents, 1) ** 0.5) - 1).bit_length()))


def shards_of(tokens: int) -> int:
    return min(MOST_SHARDS, max(LEAST_SHARDS, -(-tokens // SHARD_TOKENS)))


def deal(uses: dict[str, int], shards: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """Block uses of each source in each shard, by the splitting tree."""
    names = sorted(uses)
    out = np.zeros((len(names), shards), np.int64)
    rng = np.random.default_rng(seed)

    def split(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1 or not counts.sum():
            out[:, first] = counts
            return
        middle = (first + last) // 2
        share = int(counts.sum()) * (middle - first) // (last - first)
        left = rng.multivariate_hypergeometric(counts, share, method="marginals")
        split(left, first, middle)
        split(counts - left, middle, last)

    if names:
        split(np.array([uses[n] for n in names], np.int64), 0, shards)
    return {n: out[i] for i, n in enumerate(names)}


def mixture(documents: DataFrame, targets: DataFrame, path: str | None = None, shards: int | None = None, seed: int = SEED, total: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copy_no (from 0), shard, place (in the shuffled shard, from 0): one row a use."""
    spark = documents.sparkSession
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeat").cast("int").alias("cap")).where("source is not null")
    asked = {r["source"]: (r["share"], r["cap"]) for r in wanted.collect()}  # a row a target
    sized = cut(measured(documents.where(source_key(F.col("source")).isin(list(asked))), path).where("n_tokens > 0"))
    many = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a target
    count = F.lit(LEAST_BLOCKS)
    for source, n in many.items():
        count = F.when(F.col("source") == source, F.lit(blocks_of(n))).otherwise(count)
    docs = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), count.cast("long")).cast("int"))
    part = F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id"), F.lit(PARTS)).cast("int")
    sums: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():  # MOST_BLOCKS a target at most
        sums.setdefault(r["source"], {})[r["block"]] = r["n"]
    quota = quotas({s: sum(b.values()) for s, b in sums.items()}, asked, total)

    whole: list[tuple[str, int, int]] = []  # source, block, copy
    ends: dict[tuple[str, int], tuple[int, int]] = {}  # source, block: copy and tokens to take
    rng = np.random.default_rng(seed)
    for source in sorted(quota):
        own = sums[source]
        passes, rest = divmod(quota[source], sum(own.values()))
        order = [sorted(own)[i] for i in rng.permutation(len(own))]
        whole += [(source, b, c) for c in range(passes) for b in order]
        for b in order:
            if rest >= own[b]:
                whole.append((source, b, passes))
                rest -= own[b]
            else:
                if rest:
                    ends[source, b] = (passes, rest)
                break
    counts: dict[str, int] = {}
    for source, *_ in [*whole, *ends]:
        counts[source] = counts.get(source, 0) + 1
    dealt = deal(counts, shards or shards_of(sum(quota.values())), seed)
    turn: dict[str, list[int]] = {}
    for source, n in dealt.items():  # disjoint draws of permuted blocks
        own_turns = np.repeat(np.arange(len(n)), n)
        turn[source] = [int(own_turns[i]) for i in rng.permutation(len(own_turns))]
    dealing = spark.createDataFrame([(s, b, c, turn[s].pop()) for s, b, c in whole], "source string, block int, copy_no int, shard int")
    uses = dealing.groupBy("source", "block").agg(F.collect_list(F.struct("copy_no", "shard")).alias("uses"))  # so that a document meets its block's once
    columns = ["doc_id", "source", "n_tokens", "copy_no", "shard"]
    full = docs.join(F.broadcast(uses) if len(whole) <= FEW else uses, ["source", "block"]).withColumn("use", F.explode("uses")).select("doc_id", "source", "n_tokens", "use.*")

    # the last block of a source: whole parts of it, then documents of one part
    last = spark.createDataFrame([(s, b, c, turn[s].pop()) for (s, b), (c, _) in ends.items()], "source string, block int, copy_no int, shard int")
    some = docs.withColumn("part", part).join(F.broadcast(last), ["source", "block"])  # a block a target
    parts: dict[str, dict[int, int]] = {}
    for r in some.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).collect():  # PARTS a target at most
        parts.setdefault(r["source"], {})[r["part"]] = r["n"]
    edges = []
    for (source, _), (_, rest) in ends.items():
        for p in sorted(parts.get(source, {})):
            if rest < parts[source][p]:
                edges.append((source, p, rest))
                break
            rest -= parts[source][p]
    edge = spark.createDataFrame(edges, "source string, edge int, take long")
    near = some.join(F.broadcast(edge), "source")
    first = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    cutoff = near.where(F.col("part") == F.col("edge")).withColumn("so_far", F.sum("n_tokens").over(first)).where(F.col("so_far") - F.col("n_tokens") / 2 <= F.col("take"))
    used = full.select(columns).unionByName(near.where(F.col("part") < F.col("edge")).select(columns)).unionByName(cutoff.select(columns))
    local = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy_no"), "doc_id", "copy_no")
    return used.withColumn("place", F.row_number().over(local) - 1)


def repeats(documents: DataFrame, targets: DataFrame, path: str | None = None, total: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats, shards, places: every document of the mixture once, with where its uses stand."""
    uses = mixture(documents, targets, path, total=total).groupBy("doc_id", "source", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("shard", "place"))).alias("u"))
    return uses.select("doc_id", "source", "n_tokens", F.size("u").alias("repeats"), F.col("u.shard").alias("shards"), F.col("u.place").alias("places"))


def shares(documents: DataFrame, targets: DataFrame, path: str | None = None, total: int | None = None) -> DataFrame:
    """The shares really reached, of every source with a target."""
    used = mixture(documents, targets, path, total=total).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), (F.max("copy_no") + 1).alias("most_repeats"))
    total_ = used.agg(F.sum("tokens").alias("total"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeat")
    return (
        wanted.join(used, "source", "left")
        .join(F.broadcast(total_))
        .select("source", "target_share", "max_repeat", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_repeats")), F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("share"))
    )
