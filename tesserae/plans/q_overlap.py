"""N-gram overlap of answers with their gold answers, and prompt assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.overlap import bleu
from tesserae.sources.readers import table

#: Tiles at most by benchmark; a small fixed table.
TILE_LIMITS = {"chart": 12, "document": 24, "scene_text": 12, "maths": 6}


def bleu_by_run(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prediction").where("answer is not null and annotation is not null and size(annotation) > 0")
    return bleu(p, "answer", "annotation", "run_name")


def tile_limits(s: SparkSession, d: str) -> DataFrame:
    """The limit of every data set: its manifest entry's, else its domain's, else 6."""
    limits = F.create_map(*[F.lit(x) for kv in TILE_LIMITS.items() for x in kv])
    return table(s, d, "manifest").select("ds_name", F.coalesce("max_dynamic_patch", limits[F.coalesce("domain", F.lit(""))], F.lit(6)).alias("tiles"))


def judge_prompts(s: SparkSession, d: str) -> DataFrame:
    """Question, gold answers and answer as the text a judge reads."""
    key = ["source", "split", "question_id"]
    q = table(s, d, "vqa_question").where("question_id is not null").groupBy(*key).agg(F.min_by("question", "record_id").alias("question"))
    p = table(s, d, "prediction").where("question_id is not null and answer is not null and annotation is not null")
    text = F.concat(F.lit("[Question]\n"), "question", F.lit("\n\n[Reference]\n"), F.array_join("annotation", "; "), F.lit("\n\n[Answer]\n"), "answer", F.lit("\n\n[End]"))
    return p.join(q, key).select("pred_id", text.alias("prompt"))


QUERIES = {f.__name__: f for f in (bleu_by_run, tile_limits, judge_prompts)}

SQL = {
    "tile_limits": "SELECT ds_name, coalesce(max_dynamic_patch, CASE domain WHEN 'chart' THEN 12 WHEN 'document' THEN 24 WHEN 'scene_text' THEN 12 WHEN 'maths' THEN 6 END, 6) AS tiles FROM manifest",
    "judge_prompts": """WITH q AS (SELECT source, split, question_id, arg_min_null(question, record_id) AS question FROM vqa_question WHERE question_id IS NOT NULL GROUP BY ALL)
      SELECT pred_id, '[Question]' || chr(10) || q.question || chr(10) || chr(10) || '[Reference]' || chr(10) || array_to_string(annotation, '; ') || chr(10) || chr(10) || '[Answer]' || chr(10) || p.answer || chr(10) || chr(10) || '[End]' AS prompt
      FROM prediction p JOIN q USING (source, split, question_id) WHERE p.answer IS NOT NULL AND annotation IS NOT NULL""",
}
