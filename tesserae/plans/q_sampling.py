"""Shards, batches, replication and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import sampling as S
from tesserae.sources.readers import joined_path, stem, table


def contiguous_shards(s: SparkSession, d: str) -> DataFrame:
    return S.contiguous_shards(table(s, d, "documents").select("doc_id"), ["doc_id"], 7).select("doc_id", "shard")


def rank_cache(s: SparkSession, d: str) -> DataFrame:
    return S.rank_cache(table(s, d, "documents").select("doc_id"), ["doc_id"], 7).select("doc_id", "rank")


def repeat_time(s: SparkSession, d: str) -> DataFrame:
    """Records of each source by the repeat_time of its manifest entry."""
    c = table(s, d, "conversation").select("row_id", "source")
    m = table(s, d, "manifest").where("repeat_time is not null").select(F.col("ds_name").alias("source"), "repeat_time")
    n = c.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("source").orderBy("row_id")
    x = c.withColumn("place", F.row_number().over(w) - 1).join(n, "source").join(m, "source")
    return S.repeated(x, F.col("repeat_time"), F.col("place"), F.col("n")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("records"))


def sqrt_mixture_weights(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "conversation").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.sqrt_weights(n).select("source", "n", F.round("weight", 6).alias("weight"))


def weighted_draws(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "conversation").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.weighted_draws(S.sqrt_weights(n), "source", 10_000).groupBy("source").agg(F.count(F.lit(1)).alias("draws"), F.countDistinct("at").alias("rows"))


def ratio_weights(s: SparkSession, d: str) -> DataFrame:
    """Weight of a row of each data set when data sets are drawn by ratio, whatever their size."""
    n = table(s, d, "conversation").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    t = table(s, d, "mix_target").select("source", "target_share")
    x = n.join(t, "source")
    tot = x.agg(F.sum("target_share").alias("r"), F.max("n").alias("m"))
    return x.join(F.broadcast(tot)).select("source", F.round(F.col("m") / F.col("n") * F.col("target_share") / F.col("r"), 6).alias("row_weight"))


def megabatches(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversation").select("row_id", F.coalesce("length", F.lit(0)).alias("length"))
    return S.megabatches(c, "row_id", "length", 64).select("row_id", "megabatch", "place")


def balanced_chunks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversation").select("row_id", F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).alias("length"))
    return S.balanced_chunks(S.megabatches(c, "row_id", "length", 64), "length", "row_id", 8)


def aspect_batches(s: SparkSession, d: str) -> DataFrame:
    """Full batches of wide and of tall pictures; sizes derived from part."""
    p = table(s, d, "part").select("p_partkey", (100 + F.col("p_size") * 37).alias("w"), (100 + F.col("p_partkey") % 41 * 23).alias("h"))
    x = p.select("p_partkey", F.when(F.col("w") > F.col("h"), 0).otherwise(1).alias("bucket"))
    return S.full_batches(x, "bucket", ["p_partkey"], 16).select("p_partkey", "bucket", "batch")


def turn_batches(s: SparkSession, d: str) -> DataFrame:
    """Batches of all data sets in turn. A stream by nature: one ordered pass, a bounded buffer.

    A data set without a row has no turn, as it would keep it for ever. Rows are lost only where the sampler loses them: to
    a full bucket out of turn, and in batches that are open at the end.
    """
    import pyarrow as pa

    filled = table(s, d, "conversation").select(F.col("source").alias("ds_name")).distinct()
    names = [r["ds_name"] for r in table(s, d, "manifest").select("ds_name").join(filled, "ds_name", "left_semi").orderBy("ds_name").collect()]
    c = table(s, d, "conversation").where(F.col("source").isin(names)).select("source", F.col("image").isNull().cast("int").alias("bucket"), "row_id")

    def run(batches):
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = []
        for n, name, row in S.turn_batches(rows, names, 8):
            held.append((n, name, row))
            if len(held) > 10_000:
                yield pa.RecordBatch.from_pylist([{"batch": a, "source": b, "row_id": c} for a, b, c in held])
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([{"batch": a, "source": b, "row_id": c} for a, b, c in held])

    return c.coalesce(1).sortWithinPartitions("row_id").mapInArrow(run, "batch long, source string, row_id long")


def history_truncation(s: SparkSession, d: str) -> DataFrame:
    """The latest turns of each conversation that stay below 200 characters."""
    t = table(s, d, "conversation").select("row_id", F.posexplode("conversations").alias("turn", "t")).where("t.from_role <> 'system'").select("row_id", "turn", F.coalesce(F.length("t.value"), F.lit(0)).alias("size"))
    return S.newest_first(t, "row_id", "turn", F.col("size"), 200).select("row_id", "turn", "so_far")


def renumbered(s: SparkSession, d: str) -> DataFrame:
    return S.ranged(table(s, d, "prediction").select("pred_id"), ["pred_id"], "id").select("pred_id", "id")


def first_rows(s: SparkSession, d: str) -> DataFrame:
    """A limit that is the feature: the first 50 records by key."""
    return table(s, d, "vqa_question").select("record_id", "source", "split").orderBy("record_id").limit(50)


def k_shots(s: SparkSession, d: str) -> DataFrame:
    """Three training questions of the same source before every validation question."""
    q = table(s, d, "vqa_question").select("record_id", "source", "split", (F.col("record_id") * 7919 % 10007).alias("shot_order"), F.col("record_id").alias("shot"))
    pool = q.where("split = 'train'").withColumn("shot_order", F.col("shot_order") * 1_000_000_000 + F.col("shot"))
    x = S.k_shots(q.where("split = 'val'").select("record_id", "source"), pool.select("source", "shot_order", "shot"), "source", 3)
    return x.select("record_id", "source", F.array_join(F.transform("shots", lambda r: r["shot"].cast("string")), ",").alias("shots"))


def picture_stems(s: SparkSession, d: str) -> DataFrame:
    """File stem, task (the second-last part of a path) and the path under another root."""
    q = table(s, d, "vqa_question").where("image_path is not null").select("record_id", F.replace("image_path", F.lit("\\"), F.lit("/")).alias("p"))
    parts = F.split("p", "/")
    return q.select("record_id", stem(F.col("p")).alias("stem"), F.when(F.size(parts) >= 2, F.element_at(parts, -2)).alias("task"), joined_path(F.lit("s3://store/"), F.col("p")).alias("far"), joined_path(F.lit("/data/"), F.col("p")).alias("near"))


QUERIES = {f.__name__: f for f in (contiguous_shards, rank_cache, repeat_time, sqrt_mixture_weights, weighted_draws, ratio_weights, megabatches, balanced_chunks, aspect_batches, turn_batches, history_truncation, renumbered, first_rows, k_shots, picture_stems)}

SQL = {
    "contiguous_shards": "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INT) AS shard FROM documents",
    "rank_cache": "SELECT doc_id, CAST(r AS INT) AS rank FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // greatest(1, (SELECT count(*) FROM documents) // 7) AS r FROM documents) WHERE r < 7",
    "repeat_time": """WITH c AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM conversation),
      x AS (SELECT c.*, CASE WHEN repeat_time < 1 THEN CASE WHEN place < floor(n * repeat_time) THEN 1 ELSE 0 END ELSE floor(repeat_time) END AS k FROM c JOIN manifest ON ds_name = source WHERE repeat_time IS NOT NULL)
      SELECT source, CAST(sum(k) AS BIGINT) AS rows, count(*) AS records FROM x WHERE k > 0 GROUP BY 1""",
    "sqrt_mixture_weights": "WITH n AS (SELECT source, count(*) AS n FROM conversation GROUP BY 1) SELECT source, n, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM n), 6) AS weight FROM n",
    "ratio_weights": "WITH x AS (SELECT c.source, n, target_share FROM (SELECT source, count(*) AS n FROM conversation GROUP BY 1) c JOIN mix_target t ON t.source = c.source) SELECT source, round((SELECT max(n) FROM x) / n * target_share / (SELECT sum(target_share) FROM x), 6) AS row_weight FROM x",
    "aspect_batches": """WITH p AS (SELECT p_partkey, CASE WHEN 100 + p_size * 37 > 100 + p_partkey % 41 * 23 THEN 0 ELSE 1 END AS bucket FROM part), r AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY p_partkey) - 1) // 16 AS batch FROM p)
      SELECT p_partkey, bucket, batch FROM (SELECT *, count(*) OVER (PARTITION BY bucket, batch) AS n FROM r) WHERE n = 16""",
    "history_truncation": """WITH t AS (SELECT row_id, unnest(conversations) AS t, generate_subscripts(conversations, 1) - 1 AS turn FROM conversation), z AS (SELECT row_id, CAST(turn AS INT) AS turn, coalesce(length(t.value), 0) AS size FROM t WHERE t.from_role <> 'system')
      SELECT row_id, turn, so_far FROM (SELECT row_id, turn, CAST(sum(size) OVER (PARTITION BY row_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM z) WHERE so_far < 200""",
    "renumbered": "SELECT pred_id, row_number() OVER (ORDER BY pred_id) - 1 AS id FROM prediction",
    "first_rows": "SELECT record_id, source, split FROM vqa_question ORDER BY record_id LIMIT 50",
    "k_shots": """WITH q AS (SELECT record_id, source, split, record_id * 7919 % 10007 * 1000000000 + record_id AS o FROM vqa_question), p AS (SELECT source, record_id, o, row_number() OVER (PARTITION BY source ORDER BY o) AS r FROM q WHERE split = 'train'),
      g AS (SELECT source, string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY o) AS shots FROM p WHERE r <= 3 GROUP BY 1) SELECT q.record_id, q.source, g.shots FROM q LEFT JOIN g USING (source) WHERE q.split = 'val'""",
    "picture_stems": """WITH q AS (SELECT record_id, replace(image_path, '\\', '/') AS p FROM vqa_question WHERE image_path IS NOT NULL)
      SELECT record_id, regexp_replace(split_part(p, '/', -1), '\\.[^.]*$', '') AS stem, CASE WHEN len(string_split(p, '/')) >= 2 THEN split_part(p, '/', -2) END AS task, 's3://store/' || p AS far, '/data/' || p AS near FROM q""",
}
