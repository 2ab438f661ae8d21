"""Parsers, lookups and joins by key over questions, predictions and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import parsing as P
from tesserae.functions import text as X
from tesserae.operators import models as M
from tesserae.plans.q_scoring import STRIP, distance_sql
from tesserae.sources.readers import table


def _answered(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prediction").where("answer is not null and annotation is not null and size(annotation) > 0")


def multi_choice_parse(s: SparkSession, d: str) -> DataFrame:
    o = F.transform("annotation", lambda t, i: F.struct(F.char(i + 65).alias("key"), t.alias("text")))
    return _answered(s, d).select("pred_id", P.multi_choice(F.col("answer"), o, F.col("pred_id")).alias("choice"))


def open_answer_accuracy(s: SparkSession, d: str) -> DataFrame:
    return _answered(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(P.open_correct(F.col("answer"), F.col("annotation")).cast("double")), 6).alias("accuracy"))


def nearest_choices(s: SparkSession, d: str) -> DataFrame:
    return _answered(s, d).select("pred_id", P.nearest_choice(F.col("answer"), F.col("annotation")).alias("choice"))


def answer_predicates(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "vqa_question").where("question is not null")
    return q.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in P.predicates(F.col("question")).items()))


def tagged_segments(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "vqa_question").where("image_path is not null and question is not null")
    x = q.select("record_id", P.segments(F.concat(F.lit("<img>"), "image_path", F.lit("</img>"), "question")).alias("p"))
    return x.select("record_id", F.size("p").alias("parts"), P.joined_segments(F.col("p")).alias("text"))


def chat_pages(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "conversation").select("row_id", F.posexplode("conversations").alias("turn", "t")).where("t.value is not null")
    return t.select("row_id", "turn", P.chat_html(F.col("t.value")).alias("page"))


def stopped_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length(P.cut_at_stop(F.col("text"), ["<|endoftext|>", "[PAD]"])).alias("size"))


def question_filters(s: SparkSession, d: str) -> DataFrame:
    """Filters that hold together; an empty list is no filter."""
    q = table(s, d, "vqa_question")
    for column, wanted in (("split", ["val", "test"]), ("source", []), ("lang", ["en", "de"])):
        if wanted:
            q = q.where(F.col(column).isin(wanted))
    return q.select("record_id", "split", "lang")


def update_by_key(s: SparkSession, d: str) -> DataFrame:
    """Predictions of one run written into the table of questions; what has none stays null."""
    p = table(s, d, "prediction").where("question_id is not null").groupBy("source", "split", "question_id").agg(F.max_by("answer", "pred_id").alias("prediction"))
    return table(s, d, "vqa_question").where("split <> 'train'").join(p, ["source", "split", "question_id"], "left").select("record_id", "prediction")


def image_index(s: SparkSession, d: str) -> DataFrame:
    """Questions by picture; of a picture that many share the numbers only."""
    q = table(s, d, "vqa_question").where("image_path is not null")
    return q.groupBy("image_path").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"), F.max("record_id").alias("last"))


def positional_zip(s: SparkSession, d: str) -> DataFrame:
    """Rows of two tables with the same number, as long as the shorter."""
    a = table(s, d, "prediction").select(F.col("pred_id").alias("row"), F.col("answer").alias("left"))
    return a.join(table(s, d, "vqa_question").select(F.col("record_id").alias("row"), F.col("question").alias("right")), "row")


def source_rules(s: SparkSession, d: str) -> DataFrame:
    """The manifest entry of every source, and which have none."""
    m = table(s, d, "manifest").select(F.col("ds_name").alias("source"), "domain", "max_dynamic_patch")
    return table(s, d, "documents").select("source").distinct().join(m, "source", "left").select("source", "domain", F.coalesce("max_dynamic_patch", F.lit(12)).alias("tiles"))


def membership_violations(s: SparkSession, d: str) -> DataFrame:
    """Answers that no annotator gave."""
    return _answered(s, d).where(~F.array_contains("annotation", F.col("answer"))).groupBy("run_name").agg(F.count(F.lit(1)).alias("n"))


def model_captions(s: SparkSession, d: str) -> DataFrame:
    return M.captions(table(s, d, "conversation").where("img_id is not null").select("img_id").distinct())


QUERIES = {f.__name__: f for f in (multi_choice_parse, open_answer_accuracy, nearest_choices, answer_predicates, tagged_segments, chat_pages, stopped_texts, question_filters, update_by_key, image_index, positional_zip, source_rules, membership_violations, model_captions)}

_A = "answer IS NOT NULL AND annotation IS NOT NULL AND len(annotation) > 0"
_S = STRIP


def _has(words: list[str], text: str = "question") -> str:
    return f"list_has_any(regexp_extract_all({text}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), [" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "])"


#: Words of quantity as the list has them, two of them joined into one.
_QUANTITY = "most least fewestmore less fewer largest smallest greatest larger smaller greater highest lowest higher lower increase decrease minimum maximum max min mean average median total sum add subtract difference quotient gap half double twice triple square cube root approximate approximation triangle rectangle circle sphere cylinder cone pyramid multiply divide percentage percent ratio proportion fraction rate".split()

SQL = {
    "nearest_choices": f"""WITH x AS (SELECT pred_id, answer AS a, unnest(annotation) AS c, generate_subscripts(annotation, 1) AS i FROM prediction WHERE {_A}), y AS (SELECT *, {distance_sql('a', 'c')} AS d FROM x)
      SELECT pred_id, c AS choice FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY d, i) AS r FROM y) WHERE r = 1""",
    "answer_predicates": f"""SELECT split, count(*) AS n, count(*) FILTER (regexp_matches(question, '\\d')) AS digit, count(*) FILTER ({_has(X.WORD_NUMBERS, 'lower(question)')}) AS number_word, count(*) FILTER ({_has(_QUANTITY)}) AS quantity_word,
      count(*) FILTER (lower({_S.format('question')}) IN ('yes', 'no', 'true', 'false')) AS truth, count(*) FILTER (regexp_matches({_S.format('question')}, '^\\d+$')) AS whole, count(*) FILTER (regexp_matches({_S.format('question')}, '^\\d+\\.\\d+$')) AS decimal FROM vqa_question WHERE question IS NOT NULL GROUP BY 1""",
    "stopped_texts": "SELECT doc_id, CAST(length(split_part(split_part(text, '<|endoftext|>', 1), '[PAD]', 1)) AS INT) AS size FROM documents WHERE text IS NOT NULL",
    "question_filters": "SELECT record_id, split, lang FROM vqa_question WHERE split IN ('val', 'test') AND lang IN ('en', 'de')",
    "update_by_key": """WITH p AS (SELECT source, split, question_id, arg_max_null(answer, pred_id) AS prediction FROM prediction WHERE question_id IS NOT NULL GROUP BY ALL)
      SELECT record_id, prediction FROM vqa_question LEFT JOIN p USING (source, split, question_id) WHERE split <> 'train'""",
    "image_index": "SELECT image_path, count(*) AS n, min(record_id) AS first, max(record_id) AS last FROM vqa_question WHERE image_path IS NOT NULL GROUP BY 1",
    "positional_zip": 'SELECT pred_id AS "row", prediction.answer AS "left", question AS "right" FROM prediction JOIN vqa_question ON record_id = pred_id',
    "source_rules": "SELECT d.source, domain, coalesce(max_dynamic_patch, 12) AS tiles FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN manifest ON ds_name = d.source",
    "membership_violations": f"SELECT run_name, count(*) AS n FROM prediction WHERE {_A} AND NOT list_contains(annotation, answer) GROUP BY 1",
}
