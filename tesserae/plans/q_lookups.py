"""Lookups, parses of boxes and choices, prompts, grids and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import geometry as G
from tesserae.functions import numeric as N
from tesserae.functions import parsing as P
from tesserae.functions import text as X
from tesserae.operators import models as M
from tesserae.operators import records as R
from tesserae.plans.q_scoring import STRIP, distance_sql
from tesserae.sources.readers import table

FIRST, SECOND = G.grids(1, 6), G.grids(3, 6)


def _answered(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prediction").where("answer is not null and annotation is not null and size(annotation) > 0")


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", (100 + F.col("p_size") * 37).cast("int").alias("w"), (100 + F.col("p_partkey") % 41 * 23).cast("int").alias("h"))


def _text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def category_names(s: SparkSession, d: str) -> DataFrame:
    """Customers with the name of their category, which is region/nation."""
    c = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws("/", "r_name", "n_name").alias("name"))
    return R.category_names(table(s, d, "customer").select("c_custkey", "c_nationkey"), c, "c_nationkey", "name").select("c_custkey", "name")


def known_classes(s: SparkSession, d: str) -> DataFrame:
    """Lines of two known flags, with the flag's number; the third is unknown and dropped."""
    x = R.of_known_classes(table(s, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity"), "l_returnflag", ["R", "A"])
    return x.groupBy("l_orderkey", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def joined_attribute(s: SparkSession, d: str) -> DataFrame:
    """Answers to questions of one language: a filter by what only the joined question has."""
    key = ["source", "split", "question_id"]
    q = table(s, d, "vqa_question").where("question_id is not null and lang = 'de'").select(*key).distinct()
    return table(s, d, "prediction").join(q, key, "left_semi").select("pred_id", "source")


def edited_columns(s: SparkSession, d: str) -> DataFrame:
    """A table with a prediction put in as its third column and two columns left out."""
    t = table(s, d, "customer")
    return R.with_column_at(t, "prediction", F.concat(F.lit("tier "), (F.col("c_custkey") % 4).cast("string")), 2, ("c_acctbal", "c_mktsegment"))


def text_key_join(s: SparkSession, d: str) -> DataFrame:
    """Orders, whose key is a number, with lines, whose key came as text."""
    a = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    b = table(s, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("lines"))
    return R.joined_as_text(a, b, "key").select("key", "o_orderstatus", "lines")


def context_lookup(s: SparkSession, d: str) -> DataFrame:
    """The captions of a context as one text of lines, for every row of it; contexts are a small table."""
    lines = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("context"))
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("k"))
    return table(s, d, "customer").join(n, "c_nationkey").join(lines, "k").select("c_custkey", "context")


def index_zip(s: SparkSession, d: str) -> DataFrame:
    """Answers and questions by their place, as long as the shorter."""
    a = table(s, d, "prediction").select("pred_id", F.col("answer").alias("left"))
    b = table(s, d, "vqa_question").select("record_id", F.col("question").alias("right"))
    return R.zipped([a, b], [["pred_id"], ["record_id"]]).select("row", "left", "right")


def choice_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Whether the option that an answer names is a gold one; gold are the options whose text is the first gold answer's."""
    options = F.transform("annotation", lambda t, i: F.struct(F.char(i + 65).alias("key"), t.alias("text")))
    gold = F.transform(F.filter(options, lambda o: o["text"] == F.element_at("annotation", 1)), lambda o: o["key"])
    p = _answered(s, d).where(F.length(X.strip(F.col("answer"))) > 0)
    return p.select("source", P.choice_correct(gold, X.option_post_process(F.col("answer"), options)).alias("h")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("h").alias("correct"))


def normalised_extractions(s: SparkSession, d: str) -> DataFrame:
    """Extractions in the form of their kind, here by the number of the row."""
    kind = F.when(F.col("pred_id") % 3 == 0, "multi_choice").otherwise("free_form")
    number = F.when(F.col("pred_id") % 2 == 0, "integer").otherwise("float")
    return _answered(s, d).select("pred_id", P.normalised_extraction(F.col("answer"), F.col("annotation"), kind, number).alias("extraction"))


def safe_equality(s: SparkSession, d: str) -> DataFrame:
    """Equality of texts and numbers as written; a missing one equals a missing one only."""
    p = table(s, d, "prediction").select("source", F.col("answer").eqNullSafe(F.try_element_at("annotation", F.lit(1))).alias("same"))
    return p.groupBy("source").agg(F.count_if("same").alias("same"), F.count(F.lit(1)).alias("n"), N.two_places(F.count_if("same") * 100.0 / F.count(F.lit(1))).alias("percent"))


def parsed_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes written in one or two brackets, among words, or not as boxes at all."""
    a, b = (F.col("p_size") * 11).cast("string"), (F.col("p_partkey") % 97).cast("string")
    four = F.concat_ws(", ", b, a, F.lit("500.5"), F.lit("700"))
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("["), four, F.lit("]"))).when(k == 1, F.concat(F.lit("at [["), four, F.lit("]] and [[1,2,3,4]]"))).when(k == 2, F.concat(F.lit("["), four)).when(k == 3, F.concat(F.lit("[x, "), four, F.lit("]"))).otherwise("none")
    box = P.first_box(F.col("text"))
    p = _sizes(s, d).join(table(s, d, "part").select("p_partkey", text.alias("text")), "p_partkey")
    scaled = G.rescaled(box, F.col("w"), F.col("h"))
    return p.select("p_partkey", *(F.round(scaled[i], 6).alias(f"b{i}") for i in range(4)))


def box_scales(s: SparkSession, d: str) -> DataFrame:
    """A box of a grid of 1000 in pixels, and of a picture whose longer side is 720."""
    p = _sizes(s, d)
    b = F.array(F.lit(100), F.lit(250), F.lit(333), F.lit(999))
    x, y = G.grid_to_pixels(b, F.col("w"), F.col("h")), G.longest_side(F.array(F.lit(1.0), F.lit(2.0), F.lit(30.0), F.lit(40.0)), F.col("w"), F.col("h"))
    return p.select("p_partkey", _text(x).alias("pixels"), *(F.round(y[i], 6).alias(f"s{i}") for i in range(4)))


def referred_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes of the turns with what they were said to be, and the latest picture of the conversation."""
    c = table(s, d, "conversation").where(F.size("conversations") > 0)
    names = F.coalesce("image", F.array().cast("array<string>"))
    texts = F.transform("conversations", lambda t, i: F.concat(F.when(i == 0, F.array_join(F.transform(names, lambda n: F.concat(F.lit("<img>"), n, F.lit("</img>"))), "")).otherwise(""), F.coalesce(t["value"], F.lit(""))))
    parts = c.select("row_id", F.posexplode(texts).alias("turn", "text")).select("row_id", "turn", P.segments(F.col("text")).alias("p"))
    return parts.select("row_id", "turn", F.explode(P.boxes_with_ref(F.col("p"))).alias("b")).select("row_id", "turn", _text(F.col("b.box")).alias("box"), F.col("b.ref").alias("ref"))


def latest_pictures(s: SparkSession, d: str) -> DataFrame:
    """The last picture that a conversation names; a turn's pictures stand before its text."""
    c = table(s, d, "conversation").where(F.size("image") > 0)
    marked = F.array_join(F.transform("image", lambda n: F.concat(F.lit("<img>"), n, F.lit("</img>"))), "and ")
    return c.select("row_id", P.segments(marked).alias("p")).select("row_id", P.latest_picture(F.array("p")).alias("picture"))


def subject_prompts(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "vqa_question").where("question is not null and answer is not null")
    return q.select("record_id", R.subject_prompt(F.col("question"), F.col("answer"), lead="Read the picture first.").alias("prompt"), F.element_at("answer", 1).alias("gold"))


def letter_options(s: SparkSession, d: str) -> DataFrame:
    """Two options written as (a) and (b), and an answer that names one."""
    p = _answered(s, d).where(F.size("annotation") > 1).select("pred_id", F.concat(F.lit("(a) "), F.col("annotation")[0], F.lit(" (b) "), F.col("annotation")[1]).alias("o"))
    named = F.concat(F.lit("("), F.when(F.col("pred_id") % 2 == 0, "a").otherwise("b"), F.lit(")"))
    o = P.letter_options(F.col("o"))
    return p.select("pred_id", o[0].alias("a"), o[1].alias("b"), P.letters(named).alias("answer"))


def extraction_prompts(s: SparkSession, d: str) -> DataFrame:
    key = ["source", "split", "question_id"]
    q = table(s, d, "vqa_question").where("question_id is not null").groupBy(*key).agg(F.min_by("question", "record_id").alias("question"))
    p = table(s, d, "prediction").where("answer is not null and question_id is not null")
    return p.join(q, key).where("question is not null").select("pred_id", R.extraction_prompt(" Read the answer out of the response.\n", F.col("question"), F.col("answer")).alias("prompt"))


def ratio_draws(s: SparkSession, d: str) -> DataFrame:
    """Draws by ratio with replacement, as many as there are rows."""
    c = table(s, d, "conversation")
    n = c.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    x = n.join(table(s, d, "mix_target").select("source", F.col("target_share").alias("ratio")), "source")
    return R.ratio_draws(x, "source", c.count()).groupBy("source").agg(F.count(F.lit(1)).alias("draws"), F.countDistinct("at").alias("rows"))


def second_grids(s: SparkSession, d: str) -> DataFrame:
    """The first grid, and the second one by the rule of training and by the rule of use."""
    w, h = F.col("w"), F.col("h")
    p = _sizes(s, d).withColumn("g", G.closest_grid(w, h, FIRST))
    show = lambda g: F.concat_ws("x", g["columns"].cast("string"), g["rows"].cast("string"))
    return p.select("p_partkey", show(F.col("g")).alias("first"), show(G.second_grid(w, h, F.col("g"), SECOND)).alias("strict"), show(G.second_grid(w, h, F.col("g"), SECOND, both=False)).alias("loose"))


def tiles_with_thumbnail(s: SparkSession, d: str) -> DataFrame:
    p = _sizes(s, d).withColumn("g", G.closest_grid(F.col("w"), F.col("h"), FIRST))
    x = p.select("p_partkey", F.posexplode(G.with_thumbnail(G.tile_boxes(F.col("g.columns"), F.col("g.rows")), F.col("w"), F.col("h"))).alias("tile", "b"))
    return x.select("p_partkey", "tile", *(F.col("b")[i].cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


def sliding_windows(s: SparkSession, d: str) -> DataFrame:
    """Origins of the whole windows and of those with partial ones, and the windows put together in rows again."""
    p = _sizes(s, d).select("p_partkey", "w", G.windows(F.col("w"), F.col("h"), 448, 448).alias("whole"), G.windows(F.col("w"), F.col("h"), 448, 448, partial=True).alias("all"))
    show = lambda c: F.array_join(F.transform(c, lambda o: F.concat_ws(",", o["left"].cast("string"), o["top"].cast("string"))), " ")
    rows = G.reassembled(F.col("all"), F.ceil(F.col("w") / 448).cast("int"))
    return p.select("p_partkey", show(F.col("whole")).alias("whole"), show(F.col("all")).alias("partial"), F.size(rows).alias("rows"), F.array_max(F.transform(rows, lambda r: F.size(F.array_distinct(F.transform(r, lambda o: o["top"]))))).alias("tops"))


def frame_choices(s: SparkSession, d: str) -> DataFrame:
    """Frames of 8 intervals: in the middle, at their beginning; and at half a frame a second."""
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") + 3).alias("f"))
    f = F.col("f")
    return p.select("p_partkey", _text(N.frame_indices(f, 8)).alias("middle"), _text(N.frame_indices(f, 8, start=0)).alias("fixed"), _text(N.frames_per_second(f, F.lit(4.0), 0.5)).alias("fps"), _text(N.frames_per_second(f, F.lit(4.0), 2.0, 5)).alias("most"))


def random_frames(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") + 3).alias("f"))
    return p.select("p_partkey", "f", N.frame_indices(F.col("f"), 8, "rand", seed=F.col("p_partkey")).alias("frames"))


def fused_scores(s: SparkSession, d: str) -> DataFrame:
    """Softmax of two scores and a log-probability over its length."""
    p = table(s, d, "part").select("p_partkey", ((F.col("p_size") % 7) / 2.0).alias("a"), ((F.col("p_partkey") % 11) / 3.0).alias("b"), (F.col("p_partkey") % 4).alias("n"))
    return p.select("p_partkey", N.softmax_pair(F.col("a"), F.col("b")).alias("share"), F.round(N.length_normalised(-F.col("b"), F.col("n")), 6).alias("logprob"))


def model_lines(s: SparkSession, d: str) -> DataFrame:
    """Text lines and masks of every picture, by the stand-ins of the models; counted."""
    i = table(s, d, "conversation").where("img_id is not null").select("img_id").distinct()
    a = M.text_lines(i).groupBy("img_id").agg(F.count(F.lit(1)).alias("lines"))
    return a.join(M.masks(i).groupBy("img_id").agg(F.count(F.lit(1)).alias("masks")), "img_id", "full")


QUERIES = {f.__name__: f for f in (category_names, known_classes, joined_attribute, edited_columns, text_key_join, context_lookup, index_zip, choice_accuracy, normalised_extractions, safe_equality, parsed_boxes, box_scales, referred_boxes, latest_pictures, subject_prompts, letter_options, extraction_prompts, ratio_draws, second_grids, tiles_with_thumbnail, sliding_windows, frame_choices, random_frames, fused_scores, model_lines)}

_A = "answer IS NOT NULL AND annotation IS NOT NULL AND len(annotation) > 0"
_P = "p AS (SELECT p_partkey, p_size, CAST(100 + p_size * 37 AS INT) AS w, CAST(100 + p_partkey % 41 * 23 AS INT) AS h FROM part)"
_NUM = "'^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$'"


def _grid(candidates: str) -> str:
    """The fold over candidates {'i', 'j', 'd'}; what comes first in the list is taken first."""
    d = "abs(CAST(w AS DOUBLE) / h - CAST(y.i AS DOUBLE) / y.j)"
    take = f"{d} < x.d OR ({d} = x.d AND w * h > 0.5 * 448 * 448 * y.i * y.j)"
    return f"list_reduce(list_prepend({{'i': 1, 'j': 1, 'd': CAST('inf' AS DOUBLE)}}, {candidates}), lambda x, y: CASE WHEN {take} THEN {{'i': y.i, 'j': y.j, 'd': {d}}} ELSE x END)"


def _listed(grids: list[tuple[int, int]]) -> str:
    return "[" + ", ".join(f"{{'i': {i}, 'j': {j}, 'd': CAST(0 AS DOUBLE)}}" for i, j in grids) + "]"


_N = "least(8, f)"
SQL = {
    "category_names": "SELECT c_custkey, r_name || ' ' || n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "known_classes": "SELECT l_orderkey, CAST(CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS INT) AS class_id, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2",
    "joined_attribute": "SELECT pred_id, source FROM prediction p WHERE EXISTS (SELECT 1 FROM vqa_question q WHERE q.lang = 'de' AND q.source = p.source AND q.split = p.split AND q.question_id = p.question_id)",
    "edited_columns": "SELECT c_custkey, c_name, 'tier ' || (c_custkey % 4) AS prediction, c_nationkey FROM customer",
    "text_key_join": "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus, count(*) AS lines FROM orders JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = CAST(o_orderkey AS VARCHAR) GROUP BY o_orderkey, o_orderstatus",
    "context_lookup": "WITH l AS (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) AS context FROM nation GROUP BY 1) SELECT c_custkey, context FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN l ON l.n_regionkey = n.n_regionkey",
    "index_zip": """WITH a AS (SELECT row_number() OVER (ORDER BY pred_id) - 1 AS r, answer AS x FROM prediction), b AS (SELECT row_number() OVER (ORDER BY record_id) - 1 AS r, question AS y FROM vqa_question)
      SELECT a.r AS "row", x AS "left", y AS "right" FROM a JOIN b ON a.r = b.r""",
    "choice_accuracy": f"""WITH p AS (SELECT source, {STRIP.format('answer')} AS a, annotation AS o FROM prediction WHERE {_A} AND length({STRIP.format('answer')}) > 0),
      h AS (SELECT *, list_filter(list_transform(o, lambda t, i: CASE WHEN contains(a, t) THEN chr(CAST(i + 64 AS INT)) END), lambda k: k IS NOT NULL)[1] AS k, list_filter(list_transform(o, lambda t, i: CASE WHEN t = o[1] THEN chr(CAST(i + 64 AS INT)) END), lambda k: k IS NOT NULL) AS gold FROM p),
      c AS (SELECT source, gold, CASE WHEN length(a) = 1 THEN a WHEN ascii(substr(a, 1, 1)) - 64 BETWEEN 1 AND len(o) THEN substr(a, 1, 1) ELSE coalesce(k, a) END AS said FROM h)
      SELECT source, count(*) AS n, count(*) FILTER (list_contains(gold, said)) AS correct FROM c GROUP BY 1""",
    "normalised_extractions": f"""WITH p AS (SELECT pred_id, answer, annotation AS o, {STRIP.format('answer')} AS t, pred_id % 3 = 0 AS multi, pred_id % 2 = 0 AS whole FROM prediction WHERE {_A}),
      l AS (SELECT *, CASE WHEN regexp_extract(t, '\\(([a-zA-Z])\\)', 1) <> '' THEN upper(regexp_extract(t, '\\(([a-zA-Z])\\)', 1)) ELSE t END AS e FROM p),
      n AS (SELECT pred_id, c, row_number() OVER (PARTITION BY pred_id ORDER BY {distance_sql('e', 'c')}, i) AS r FROM (SELECT pred_id, e, unnest(o) AS c, generate_subscripts(o, 1) AS i FROM l WHERE multi)),
      v AS (SELECT l.*, n.c, CASE WHEN regexp_matches(answer, {_NUM}) THEN TRY_CAST(trim(answer) AS DOUBLE) END AS v FROM l LEFT JOIN n ON n.pred_id = l.pred_id AND n.r = 1)
      SELECT pred_id, CASE WHEN multi THEN CASE WHEN length(e) = 1 AND ascii(e) - 64 BETWEEN 1 AND len(o) THEN o[ascii(e) - 64] ELSE c END WHEN whole THEN CAST(CAST(trunc(v) AS BIGINT) AS VARCHAR) ELSE CAST(round_even(v, 2) AS VARCHAR) END AS extraction FROM v""",
    "safe_equality": "SELECT source, count(*) FILTER (answer IS NOT DISTINCT FROM annotation[1]) AS same, count(*) AS n, printf('%.2f', 100.0 * count(*) FILTER (answer IS NOT DISTINCT FROM annotation[1]) / count(*)) AS percent FROM prediction GROUP BY 1",
    "parsed_boxes": f"""WITH {_P}, b AS (SELECT *, CASE WHEN p_partkey % 5 IN (0, 1) THEN [CAST(p_partkey % 97 AS DOUBLE), CAST(p_size * 11 AS DOUBLE), 500.5, 700.0] ELSE [0.0, 0.0, 0.0, 0.0] END AS b FROM p), g AS (SELECT *, CASE WHEN list_sum(b) >= 4 THEN 1000.0 ELSE 1.0 END AS g FROM b)
      SELECT p_partkey, round(b[1] / CAST(g AS DOUBLE) * w, 6) AS b0, round(b[2] / CAST(g AS DOUBLE) * h, 6) AS b1, round(b[3] / CAST(g AS DOUBLE) * w, 6) AS b2, round(b[4] / CAST(g AS DOUBLE) * h, 6) AS b3 FROM g""",
    "box_scales": f"""WITH {_P} SELECT p_partkey, array_to_string([CAST(floor(CAST(100 AS DOUBLE) / 1000 * w) AS INT), CAST(floor(CAST(250 AS DOUBLE) / 1000 * h) AS INT), CAST(floor(CAST(333 AS DOUBLE) / 1000 * w) AS INT), CAST(floor(CAST(999 AS DOUBLE) / 1000 * h) AS INT)], ',') AS pixels,
      round(720.0 / greatest(w, h), 6) AS s0, round(2 * 720.0 / greatest(w, h), 6) AS s1, round(30 * 720.0 / greatest(w, h), 6) AS s2, round(40 * 720.0 / greatest(w, h), 6) AS s3 FROM p""",
    "latest_pictures": "SELECT row_id, image[-1] AS picture FROM conversation WHERE len(image) > 0",
    "subject_prompts": "SELECT record_id, 'Read the picture first.' || chr(10) || chr(10) || question || chr(10) || chr(10) || array_to_string(list_transform(answer, lambda o, i: '(' || chr(CAST(i + 64 AS INT)) || ') ' || o || chr(10)), '') || chr(10) || 'Answer with the option''s letter from the given choices directly.' AS prompt, answer[1] AS gold FROM vqa_question WHERE question IS NOT NULL AND answer IS NOT NULL",
    "letter_options": f"SELECT pred_id, {STRIP.format('annotation[1]')} AS a, {STRIP.format('annotation[2]')} AS b, CASE WHEN pred_id % 2 = 0 THEN 'A' ELSE 'B' END AS answer FROM prediction WHERE {_A} AND len(annotation) > 1",
    "extraction_prompts": """WITH q AS (SELECT source, split, question_id, arg_min_null(question, record_id) AS question FROM vqa_question WHERE question_id IS NOT NULL GROUP BY ALL)
      SELECT pred_id, 'Read the answer out of the response.' || chr(10) || chr(10) || q.question || chr(10) || chr(10) || p.answer || chr(10) || chr(10) || 'Extracted answer: ' AS prompt FROM prediction p JOIN q USING (source, split, question_id) WHERE p.answer IS NOT NULL AND q.question IS NOT NULL""",
    "second_grids": f"""WITH {_P}, f AS (SELECT *, {_grid(_listed(FIRST))} AS g FROM p), a AS (SELECT *, list_filter({_listed(SECOND)}, lambda c: g.i % c.i <> 0 AND g.j % c.j <> 0) AS st, list_filter({_listed(SECOND)}, lambda c: g.i % c.i <> 0 OR g.j % c.j <> 0) AS lo FROM f),
      b AS (SELECT p_partkey, g AS f, {_grid('st')} AS s, {_grid('lo')} AS l FROM a) SELECT p_partkey, f.i || 'x' || f.j AS "first", s.i || 'x' || s.j AS strict, l.i || 'x' || l.j AS loose FROM b""",
    "tile_grid": f"WITH {_P}, f AS (SELECT *, {_grid(_listed(FIRST))} AS g FROM p) SELECT p_partkey, g.i AS columns, g.j AS rows, g.i * g.j AS tiles FROM f",
    "tile_boxes": f"""WITH {_P}, f AS (SELECT *, {_grid(_listed(FIRST))} AS g FROM p), t AS (SELECT g.i AS i, unnest(range(g.i * g.j)) AS k FROM f)
      SELECT CAST(k AS INT) AS tile, count(*) AS n, CAST(sum((k % i + 1) * 448) AS BIGINT) AS "right", CAST(sum((k // i + 1) * 448) AS BIGINT) AS bottom FROM t GROUP BY 1""",
    "second_scale": f"""WITH {_P}, f AS (SELECT *, {_grid(_listed(FIRST))} AS g FROM p) SELECT g.i AS columns, g.j AS rows, count(*) AS n, CAST(max(len(list_filter({_listed(SECOND)}, lambda c: g.i % c.i <> 0 AND g.j % c.j <> 0))) AS INT) AS strict,
      CAST(max(len(list_filter({_listed(SECOND)}, lambda c: g.i % c.i <> 0 OR g.j % c.j <> 0))) AS INT) AS loose FROM f GROUP BY 1, 2""",
    "tiles_with_thumbnail": f"""WITH {_P}, f AS (SELECT *, {_grid(_listed(FIRST))} AS g FROM p), t AS (SELECT p_partkey, w, h, g.i AS i, g.i * g.j AS n, unnest(range(g.i * g.j + CASE WHEN g.i * g.j > 1 THEN 1 ELSE 0 END)) AS k FROM f)
      SELECT p_partkey, CAST(k AS INT) AS tile, CAST(CASE WHEN k = n THEN 0 ELSE k % i * 448 END AS INT) AS x1, CAST(CASE WHEN k = n THEN 0 ELSE k // i * 448 END AS INT) AS y1, CAST(CASE WHEN k = n THEN w ELSE (k % i + 1) * 448 END AS INT) AS x2, CAST(CASE WHEN k = n THEN h ELSE (k // i + 1) * 448 END AS INT) AS y2 FROM t""",
    "sliding_windows": f"""WITH {_P}, n AS (SELECT *, CASE WHEN w >= 448 THEN (w - 448) // 448 + 1 ELSE 0 END AS nx, CASE WHEN h >= 448 THEN (h - 448) // 448 + 1 ELSE 0 END AS ny, CAST(ceil(w / 448.0) AS INT) AS cx, CAST(ceil(h / 448.0) AS INT) AS cy FROM p)
      SELECT p_partkey, array_to_string(list_transform(range(nx * ny), lambda k: (k % nx * 448) || ',' || (k // nx * 448)), ' ') AS whole, array_to_string(list_transform(range(cx * cy), lambda k: (k % cx * 448) || ',' || (k // cx * 448)), ' ') AS partial, cy AS rows, CAST(1 AS INT) AS tops FROM n""",
    "frame_choices": f"""WITH p AS (SELECT p_partkey, p_size + 3 AS f FROM part), m AS (SELECT *, list_transform(range({_N}), lambda i: ((f * i // {_N}) + (f * (i + 1) // {_N}) - 1) // 2) AS m, list_transform(range({_N}), lambda i: f * i // {_N}) AS s,
      list_filter(list_transform(range(CAST(ceil(f / 4.0 / 2.0) AS INT)), lambda i: CAST(round_even((1.0 + i * 2.0) * 4, 0) AS INT)), lambda x: x < f) AS a, list_filter(list_transform(range(CAST(ceil(f / 4.0 / 0.5) AS INT)), lambda i: CAST(round_even((0.25 + i * 0.5) * 4, 0) AS INT)), lambda x: x < f) AS b FROM p)
      SELECT p_partkey, array_to_string(list_concat(m, list_transform(range(8 - len(m)), lambda i: m[-1])), ',') AS middle, array_to_string(list_concat(s, list_transform(range(8 - len(s)), lambda i: s[-1])), ',') AS fixed, array_to_string(a, ',') AS fps, array_to_string(b[1:5], ',') AS most FROM m""",
    "fused_scores": """SELECT p_partkey, round(exp((p_partkey % 11) / 3.0) / (exp((p_size % 7) / 2.0) + exp((p_partkey % 11) / 3.0)), 3) AS share, round(0.0 - (p_partkey % 11) / 3.0 / greatest(p_partkey % 4, 1), 6) AS logprob FROM part""",
}
