"""Filters, derived ids, rule extraction and prompts over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import records as R
from tesserae.sources.readers import table


def typed_events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", (F.col("user_id") % 12 + 1).alias("type_id"))
    parts = [R.of_type(e, "type_id", k).select("event_id", F.lit(k).alias("kind")) for k in ("image", "video", "all", "3")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def question_subjects(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "vqa_question").where("question_id is not null")
    return q.select("record_id", R.subject(F.concat(F.lit("v_"), "source", F.lit("_"), "question_id")).alias("subject"), R.image_number(F.concat(F.lit("x_"), "question_id")).alias("number"))


def option_columns(s: SparkSession, d: str) -> DataFrame:
    """Options that are there as letter: text lines; of the columns of a wide item."""
    p = table(s, d, "manifest").select("ds_name", "root", "annotation", "domain")
    return p.select("ds_name", F.array_join(F.transform(R.options(["root", "annotation", "domain"]), lambda o: F.concat(o["key"], F.lit(". "), o["text"])), "\n").alias("lines"))


def rule_extraction(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prediction").where("answer is not null and annotation is not null")
    return p.select("pred_id", R.extracted_answer(F.trim("answer"), F.col("annotation"), F.lit("integer")).alias("extraction"))


def length_estimates(s: SparkSession, d: str) -> DataFrame:
    """Lengths by string length, over the distinct lengths a small table; rows join it."""
    c = table(s, d, "vqa_question").where("question is not null").select("record_id", "question")
    return R.estimated_lengths(c, "record_id", "question", F.size(X.words(F.col("question"))), 256).select("record_id", "estimate")


def instruction_counts(s: SparkSession, d: str) -> DataFrame:
    p = [f"Read all text in the picture, wording {i}." for i in range(21)]
    return table(s, d, "documents").select(R.instruction(p, F.col("doc_id")).alias("prompt")).groupBy("prompt").agg(F.count(F.lit(1)).alias("n"))


def substituted(s: SparkSession, d: str) -> DataFrame:
    """Records without turns replaced by others."""
    c = table(s, d, "conversation").select("row_id", "source", F.coalesce(F.size("conversations"), F.lit(0)).alias("turns"))
    _, whole = R.quarantined(c, F.col("turns") > 0, "row_id")
    return whole.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("turns").alias("least"))


def caption_tokens(s: SparkSession, d: str) -> DataFrame:
    from tesserae.operators.training import word_ids

    x = table(s, d, "documents").where("text is not null").select("doc_id", R.captioned(word_ids(F.col("text")), 101, 102, 40).alias("c"))
    return x.select("doc_id", F.size("c.tokens").alias("size"), F.aggregate("c.predict", F.lit(0), lambda a, b: a + b).alias("predicted"))


def crop_coordinates(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 41).cast("double").alias("y"))
    f = p.withColumn("f", R.affine(F.col("x"), F.col("y"), F.lit(1.5), F.lit(3.0), F.lit(4.0)))
    b = f.withColumn("b", R.affine_back(F.col("f")[0], F.col("f")[1], F.lit(1.5), F.lit(3.0), F.lit(4.0)))
    return b.select("p_partkey", F.col("f")[0].alias("fx"), F.col("f")[1].alias("fy"), F.round(F.col("b")[0], 6).alias("bx"))


def pairwise_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Overlap of every two regions of one image."""
    from tesserae.operators.regions import most_overlap
    from tesserae.plans.q_regions import lines

    return most_overlap(lines(s, d), "img", "pos", "box")


QUERIES = {f.__name__: f for f in (typed_events, question_subjects, option_columns, rule_extraction, length_estimates, instruction_counts, substituted, caption_tokens, crop_coordinates, pairwise_overlaps)}

_W = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_LINES = """lines AS (SELECT l_orderkey AS img, (l_partkey % 50) / 100.0 AS x1, (l_suppkey % 50) / 100.0 AS y1, ((l_partkey % 50) + l_quantity) / 100 AS x2, ((l_suppkey % 50) + l_quantity) / 100 AS y2,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos FROM lineitem)"""
_I = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"

SQL = {
    "typed_events": """WITH e AS (SELECT event_id, user_id % 12 + 1 AS k FROM events), x AS (SELECT event_id, unnest(['all', CASE WHEN k <= 9 THEN 'image' ELSE 'video' END, CASE WHEN k = 3 THEN '3' END]) AS kind FROM e)
      SELECT kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM x WHERE kind IS NOT NULL GROUP BY 1""",
    "question_subjects": """WITH q AS (SELECT record_id, string_split('v_' || source || '_' || question_id, '_') AS p, regexp_extract('x_' || question_id, '_(\\d+)(?:\\.[a-z]+)?$', 1) AS n FROM vqa_question WHERE question_id IS NOT NULL)
      SELECT record_id, array_to_string(p[2:len(p) - 1], '_') AS subject, TRY_CAST(nullif(n, '') AS BIGINT) AS number FROM q""",
    "option_columns": "SELECT ds_name, array_to_string(list_filter(['A. ' || root, 'B. ' || annotation, 'C. ' || domain], lambda x: x IS NOT NULL), chr(10)) AS lines FROM manifest",
    "length_estimates": f"""WITH q AS (SELECT record_id, length(question) AS l, {_W.format('question')} AS w FROM vqa_question WHERE question IS NOT NULL)
      SELECT record_id, CAST(first_value(w) OVER x + CASE WHEN row_number() OVER x = 1 THEN 0 ELSE 256 END AS INT) AS estimate FROM q WINDOW x AS (PARTITION BY l ORDER BY record_id)""",
    "caption_tokens": f"SELECT doc_id, CAST(least({_W.format('text')}, 38) + 2 AS INT) AS size, CAST(least({_W.format('text')}, 38) + 1 AS INT) AS predicted FROM documents WHERE text IS NOT NULL",
    "crop_coordinates": "SELECT p_partkey, p_size * CAST(1.5 AS DOUBLE) - 3 AS fx, (p_partkey % 41) * CAST(1.5 AS DOUBLE) - 4 AS fy, round((p_size * CAST(1.5 AS DOUBLE) - 3 + 3) / 1.5, 6) AS bx FROM part",
    "pairwise_overlaps": f"WITH {_LINES} SELECT a.img, count(*) AS pairs, round(max({_I} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_I})), 6) AS most FROM lines a JOIN lines b ON b.img = a.img AND a.pos < b.pos GROUP BY 1",
}
