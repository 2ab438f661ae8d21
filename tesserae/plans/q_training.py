"""Training samples from conversations, prompts, tile grids and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import geometry as G
from tesserae.functions import numeric as N
from tesserae.functions import text as X
from tesserae.operators import training as T
from tesserae.plans.q_scoring import STRIP
from tesserae.sources.readers import table


def conversations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversation").where(F.size("conversations") > 0)


def without_system(s: SparkSession, d: str) -> DataFrame:
    c = conversations(s, d).select("row_id", T.from_first_human(F.col("conversations")).alias("t"))
    return c.select("row_id", F.size("t").alias("turns"), F.coalesce(T.alternates(F.col("t")), F.lit(False)).alias("alternates"))


def rendered_chats(s: SparkSession, d: str) -> DataFrame:
    return conversations(s, d).select("row_id", T.rendered(F.col("conversations"), "im").alias("im"))


def message_roles(s: SparkSession, d: str) -> DataFrame:
    m = conversations(s, d).select(F.explode(T.messages(F.col("conversations"))).alias("m"))
    return m.groupBy(F.col("m.role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("m.content")).alias("chars"))


def image_placeholders(s: SparkSession, d: str) -> DataFrame:
    c = conversations(s, d).where("image is not null").select("row_id", F.element_at("conversations", 1)["value"].alias("v")).where("v is not null")
    return c.select("row_id", T.expand_images(T.with_image_mark(F.col("v")), F.lit(4)).alias("prompt"))


def _ids(c):
    """Lengths of the words, which SQL can tell as well."""
    return F.transform(X.words(F.coalesce(c, F.lit(""))), lambda w: F.length(w))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def pair_samples(s: SparkSession, d: str) -> DataFrame:
    """Ids, labels and mask of every answered question."""
    key = ["source", "split", "question_id"]
    q = table(s, d, "vqa_question").where("question_id is not null").groupBy(*key).agg(F.min_by("question", "record_id").alias("question"))
    p = table(s, d, "prediction").where("answer is not null and question_id is not null").join(q, key).select("pred_id", T.pair_sample(_ids(F.col("question")), _ids(F.col("answer")), -2, 0, 16).alias("s"))
    return p.select("pred_id", _joined("s.ids").alias("ids"), _joined("s.labels").alias("labels"), _joined(F.transform("s.mask", lambda x: x.cast("int"))).alias("mask"))


def dialogue_labels(s: SparkSession, d: str) -> DataFrame:
    return conversations(s, d).select("row_id", _joined(T.dialogue_labels(F.col("conversations"), _ids)).alias("labels"))


def padded_batches(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prediction").where("answer is not null").select("pred_id", F.floor(F.col("pred_id") / 8).alias("batch"), _ids(F.col("answer")).alias("ids"))
    return T.padded(p, "batch", "ids").select("pred_id", "batch", _joined("ids").alias("ids"), F.size(F.filter("mask", lambda x: x)).alias("used"))


def reset_positions(s: SparkSession, d: str) -> DataFrame:
    """Positions of the turns' words; the word that ends a turn ends a document."""
    c = conversations(s, d).select("row_id", F.flatten(F.transform("conversations", lambda t: F.concat(F.transform(X.words(F.coalesce(t["value"], F.lit(""))), lambda w: F.lit(1)), F.array(F.lit(0))))).alias("ids"))
    return c.select("row_id", _joined(T.positions(F.col("ids"), 0)).alias("positions"))


def least_redundant(s: SparkSession, d: str) -> DataFrame:
    return T.least_redundant(table(s, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 20).select("label", "vec_id", F.round("likeness", 5).alias("likeness"))


def top_tokens(s: SparkSession, d: str) -> DataFrame:
    """The better half of each group by the mean of its components, back in order."""
    mean = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / F.size("embedding"))
    e = table(s, d, "embeddings").select("label", "vec_id", F.round(mean, 9).alias("x"))
    w = W.partitionBy("label")
    r = e.withColumn("r", F.row_number().over(w.orderBy(F.desc("x"), "vec_id"))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("r") <= F.floor(F.col("n") * 0.5))
    return r.select("label", "vec_id", F.row_number().over(w.orderBy("vec_id")).alias("place"))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", (100 + F.col("p_size") * 37).alias("w"), (100 + F.col("p_partkey") % 41 * 23).cast("int").alias("h"))


def tile_grid(s: SparkSession, d: str) -> DataFrame:
    p = _sizes(s, d).withColumn("g", G.closest_grid(F.col("w"), F.col("h"), G.grids(1, 6)))
    return p.select("p_partkey", F.col("g.columns").alias("columns"), F.col("g.rows").alias("rows"), F.size(G.tile_boxes(F.col("g.columns"), F.col("g.rows"))).alias("tiles"))


def tile_boxes(s: SparkSession, d: str) -> DataFrame:
    p = _sizes(s, d).withColumn("g", G.closest_grid(F.col("w"), F.col("h"), G.grids(1, 6)))
    x = p.select("p_partkey", F.posexplode(G.tile_boxes(F.col("g.columns"), F.col("g.rows"))).alias("tile", "b"))
    return x.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b")[2]).alias("right"), F.sum(F.col("b")[3]).alias("bottom"))


def second_scale(s: SparkSession, d: str) -> DataFrame:
    """A second grid that doesn't divide the first: neither side, as in training, or not both, as in evaluation."""
    p = _sizes(s, d).withColumn("g", G.closest_grid(F.col("w"), F.col("h"), G.grids(1, 6)))
    other = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in G.grids(3, 6)])
    i, j = F.col("g.columns"), F.col("g.rows")
    strict = F.filter(other, lambda c: (i % c["i"] != 0) & (j % c["j"] != 0))
    loose = F.filter(other, lambda c: (i % c["i"] != 0) | (j % c["j"] != 0))
    return p.groupBy(i.alias("columns"), j.alias("rows")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(strict)).alias("strict"), F.max(F.size(loose)).alias("loose"))


def fit_in_square(s: SparkSession, d: str) -> DataFrame:
    p = _sizes(s, d).withColumn("f", G.fit_in_square(F.col("w"), F.col("h"), 448))
    side = F.greatest("w", "h")
    return p.select("p_partkey", F.col("f")[0].alias("fw"), F.col("f")[1].alias("fh"), F.floor((side - F.col("w")) / 2).cast("int").alias("left"), F.floor((side - F.col("h")) / 2).cast("int").alias("top"), N.image_tokens(side).alias("tokens"))


def window_origins(s: SparkSession, d: str) -> DataFrame:
    """Origins of sliding windows of 448 with a step of 448, whole ones and with the last partial one."""
    whole = lambda c: F.greatest(F.floor(F.col(c) / 448), F.lit(1))
    p = _sizes(s, d).select("p_partkey", whole("w").cast("int").alias("nx"), whole("h").cast("int").alias("ny"), F.ceil(F.col("w") / 448).cast("int").alias("cx"), F.ceil(F.col("h") / 448).cast("int").alias("cy"))
    return p.select("p_partkey", (F.col("nx") * F.col("ny")).alias("floor_windows"), (F.col("cx") * F.col("cy")).alias("ceil_windows"))


def frame_samples(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") + 5).alias("frames"))
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return p.select("p_partkey", j(N.segment_centres(F.lit(0), F.col("frames"), 8)).alias("centres"), j(N.middle_frames(F.col("frames"), 4)).alias("middle"))


def option_answers(s: SparkSession, d: str) -> DataFrame:
    """The option that an answer names; the options are the gold answers in order."""
    p = table(s, d, "prediction").where("answer is not null and annotation is not null").where(F.length(X.strip(F.col("answer"))) > 0)
    o = F.transform("annotation", lambda t, i: F.struct(F.char(i + 65).alias("key"), t.alias("text")))
    return p.select("pred_id", X.option_post_process(F.col("answer"), o).alias("choice"))


def choice_prompts(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "vqa_question").where("question is not null and answer is not null")
    return q.select("record_id", T.choice_prompt(F.col("question"), F.col("answer")).alias("prompt"))


def vqa_prompts(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "vqa_question").where("question is not null and image_path is not null")
    return q.select("record_id", F.concat(F.lit("<img>"), "image_path", F.lit("</img>"), "question", F.lit(" Answer:")).alias("prompt"))


def marked_boxes(s: SparkSession, d: str) -> DataFrame:
    """Middles of the boxes that turns carry."""
    c = conversations(s, d).select("row_id", F.posexplode("conversations").alias("turn", "t")).where("t.value is not null")
    x = c.select("row_id", "turn", F.explode(X.tagged(F.col("t.value"), "box")).alias("box"))
    m = X.box_midpoint(F.col("box"))
    return x.select("row_id", "turn", "box", m[0].alias("x"), m[1].alias("y"))


def prompt_tails(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vqa_question").where("question is not null").select("record_id", X.tail(F.col("question")).alias("tail"), X.remove_special_chars(F.col("question")).alias("plain"))


def gqa_clean_answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prediction").where("answer is not null").select("pred_id", X.gqa_clean(F.col("answer")).alias("clean"))


def bilingual_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prediction").where("answer is not null").select("pred_id", X.bilingual_yes_no(F.col("answer")).alias("label"))


def reciprocal_ranks(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "prediction").where("answer is not null and annotation is not null and size(annotation) > 0")
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(X.reciprocal_rank(F.col("answer"), F.col("annotation"))), 6).alias("mrr"))


def judge_scores(s: SparkSession, d: str) -> DataFrame:
    """Two scores a line, failures as -1; means by category and over all; the relative score."""
    o = table(s, d, "orders").select("o_orderpriority", F.concat((F.col("o_custkey") % 11).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(", ")).otherwise(F.lit(",")), (1 + F.col("o_orderkey") % 10).cast("string"), F.lit("\nnotes")).alias("content"))
    x = o.select(F.explode(F.array("o_orderpriority", F.lit("all"))).alias("category"), X.judge_scores(F.col("content")).alias("t"))
    g = x.groupBy("category").agg(F.avg(F.col("t")[0]).alias("a"), F.avg(F.col("t")[1]).alias("b"))
    return g.select("category", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), F.round(F.col("b") / F.col("a") * 100, 1).alias("relative"))


def paired_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Share of right answers and of pairs with both right; pairs of neighbouring events."""
    e = table(s, d, "events").select("event_type", F.floor(F.col("event_id") / 2).alias("pair"), (F.col("value") > 10).alias("right"))
    by = e.groupBy("event_type", "pair").agg(F.avg(F.col("right").cast("double")).alias("acc"), F.bool_and("right").alias("both"))
    g = by.groupBy("event_type").agg(F.count(F.lit(1)).alias("pairs"), F.avg("acc").alias("a"), F.avg(F.col("both").cast("double")).alias("p"))
    return g.select("event_type", "pairs", F.round(100 * F.col("a"), 4).alias("acc"), F.round(100 * F.col("p"), 4).alias("acc_plus"), F.round(100 * F.col("a") + 100 * F.col("p"), 4).alias("score"))


def consecutive_pairs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.floor(F.col("event_id") / 2).alias("pair"), (F.col("value") > 10).alias("right"))
    full = e.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.bool_and("right").alias("both")).where("n = 2")
    return full.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("both").cast("double")), 6).alias("accuracy"))


def type_rollup(s: SparkSession, d: str) -> DataFrame:
    """Accuracy by type and for image types, video types and all."""
    e = table(s, d, "events").select("event_type", (F.col("user_id") % 12 + 1).alias("type_id"), (F.col("value") > 10).cast("double").alias("h"))
    kinds = F.array(F.concat(F.lit("type "), F.col("type_id").cast("string")), F.when(F.col("type_id") <= 9, "image").otherwise("video"), F.lit("total"))
    return e.select(F.explode(kinds).alias("kind"), "h").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h"), 6).alias("accuracy"))


QUERIES = {f.__name__: f for f in (without_system, rendered_chats, message_roles, image_placeholders, pair_samples, dialogue_labels, padded_batches, reset_positions, least_redundant, top_tokens, tile_grid, tile_boxes, second_scale, fit_in_square, window_origins, frame_samples, option_answers, choice_prompts, vqa_prompts, marked_boxes, prompt_tails, gqa_clean_answers, bilingual_labels, reciprocal_ranks, judge_scores, paired_accuracy, consecutive_pairs, type_rollup)}

_W = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
_LEN = "list_transform(" + _W + ", lambda w: length(w))"
_C = "c AS (SELECT row_id, conversations AS t FROM conversation WHERE len(conversations) > 0)"
_HEAD = "CASE x.from_role WHEN 'human' THEN '{}' WHEN 'gpt' THEN '{}' ELSE '{}' END"
_R = "array_to_string(list_transform(t, lambda x: " + _HEAD + " || coalesce(x.value, '') || '{}'), '')"
_NL = "' || chr(10) || '"
_IM = _R.format(f"<|im_start|>user{_NL}", f"<|im_start|>assistant{_NL}", f"<|im_start|>system{_NL}", f"<|im_end|>{_NL}").replace("THEN '<|im_start|>user' || chr(10) || ''", "THEN '<|im_start|>user' || chr(10)")
_P = "p AS (SELECT p_partkey, 100 + p_size * 37 AS w, 100 + p_partkey % 41 * 23 AS h FROM part)"

SQL = {
    "without_system": f"""WITH {_C}, a AS (SELECT row_id, CASE WHEN t[1].from_role = 'system' THEN t[2:] ELSE t END AS t FROM c), b AS (SELECT row_id, CASE WHEN t[1].from_role <> 'human' THEN t[2:] ELSE t END AS t FROM a)
      SELECT row_id, CAST(len(t) AS INT) AS turns, len(list_filter(t, lambda x, i: x.from_role <> CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END)) = 0 AS alternates FROM b""",
    "rendered_chats": f"WITH {_C} SELECT row_id, {_IM} AS im FROM c",
    "message_roles": "SELECT CASE m.from_role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE 'system' END AS role, count(*) AS n, CAST(sum(length(m.value)) AS BIGINT) AS chars FROM (SELECT unnest(conversations) AS m FROM conversation) GROUP BY 1",
    "image_placeholders": """WITH v AS (SELECT row_id, conversations[1].value AS v FROM conversation WHERE len(conversations) > 0 AND image IS NOT NULL), w AS (SELECT row_id, CASE WHEN contains(v, '<image>') THEN v ELSE '<image>' || chr(10) || v END AS v FROM v WHERE v IS NOT NULL)
      SELECT row_id, substr(v, 1, strpos(v, '<image>') - 1) || '<img>' || repeat('<ctx>', 4) || '</img>' || substr(v, strpos(v, '<image>') + 7) AS prompt FROM w""",
    "pair_samples": f"""WITH q AS (SELECT source, split, question_id, arg_min_null(question, record_id) AS question FROM vqa_question WHERE question_id IS NOT NULL GROUP BY ALL),
      p AS (SELECT pred_id, {_LEN.format("coalesce(q.question, '')")} AS q, {_LEN.format('p.answer')} AS a FROM prediction p JOIN q USING (source, split, question_id) WHERE p.answer IS NOT NULL), f AS (SELECT *, greatest(16 - len(q) - len(a) - 1, 0) AS room FROM p)
      SELECT pred_id, array_to_string(list_concat(q, a, [-2], list_transform(range(room), lambda i: 0))[1:16], ',') AS ids, array_to_string(list_concat(list_transform(q, lambda x: -100), a, [-2], list_transform(range(room), lambda i: -100))[1:16], ',') AS labels,
      array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN i <= len(q) + len(a) + 1 THEN 1 ELSE 0 END), ',') AS mask FROM f""",
    "dialogue_labels": f"""WITH {_C} SELECT row_id, array_to_string(flatten(list_transform(t, lambda x: list_concat(CASE WHEN x.from_role = 'gpt' THEN {_LEN.format("coalesce(x.value, '')")} ELSE list_transform({_LEN.format("coalesce(x.value, '')")}, lambda y: -100) END, [-1]))), ',') AS labels FROM c""",
    "padded_batches": f"""WITH p AS (SELECT pred_id, pred_id // 8 AS batch, {_LEN.format('answer')} AS ids FROM prediction WHERE answer IS NOT NULL), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM p)
      SELECT pred_id, batch, array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda i: 0)), ',') AS ids, CAST(len(ids) AS INT) AS used FROM m""",
    "reset_positions": f"WITH {_C} SELECT row_id, array_to_string(flatten(list_transform(t, lambda x: range(len({_W.format("coalesce(x.value, '')")}) + 1))), ',') AS positions FROM c",
    "least_redundant": """WITH s AS (SELECT a.label, a.vec_id, coalesce(max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), -1.0) AS likeness FROM embeddings a LEFT JOIN embeddings b ON b.label = a.label AND b.vec_id > a.vec_id GROUP BY 1, 2)
      SELECT label, vec_id, round(likeness, 5) AS likeness FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY likeness, vec_id) AS r FROM s) WHERE r <= 20""",
    "top_tokens": """WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(list_sum(CAST(embedding AS DOUBLE[])) / len(embedding), 9) DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
      SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) AS place FROM r WHERE r <= floor(n * 0.5)""",
    "fit_in_square": f"""WITH {_P} SELECT p_partkey, CAST(floor(w * least(CAST(448 AS DOUBLE) / w, CAST(448 AS DOUBLE) / h)) AS INT) AS fw, CAST(floor(h * least(CAST(448 AS DOUBLE) / w, CAST(448 AS DOUBLE) / h)) AS INT) AS fh, CAST((greatest(w, h) - w) // 2 AS INT) AS "left", CAST((greatest(w, h) - h) // 2 AS INT) AS top,
      CAST(floor((greatest(w, h) // 14) * (greatest(w, h) // 14) * 0.25) AS INT) AS tokens FROM p""",
    "window_origins": f"WITH {_P} SELECT p_partkey, CAST(greatest(w // 448, 1) * greatest(h // 448, 1) AS INT) AS floor_windows, CAST(ceil(w / 448.0) * ceil(h / 448.0) AS INT) AS ceil_windows FROM p",
    "option_answers": f"""WITH p AS (SELECT pred_id, {STRIP.format('answer')} AS a, annotation AS o FROM prediction WHERE answer IS NOT NULL AND annotation IS NOT NULL AND length({STRIP.format('answer')}) > 0),
      h AS (SELECT *, list_filter(list_transform(o, lambda t, i: CASE WHEN contains(a, t) THEN chr(CAST(i + 64 AS INT)) END), lambda k: k IS NOT NULL)[1] AS k FROM p)
      SELECT pred_id, CASE WHEN length(a) = 1 THEN a WHEN ascii(substr(a, 1, 1)) - 64 BETWEEN 1 AND len(o) THEN substr(a, 1, 1) ELSE coalesce(k, a) END AS choice FROM h""",
    "choice_prompts": "SELECT record_id, question || chr(10) || array_to_string(list_transform(answer, lambda o, i: chr(CAST(i + 64 AS INT)) || '. ' || o), chr(10)) || chr(10) || 'Answer with the option''s letter from the given choices directly.' AS prompt FROM vqa_question WHERE question IS NOT NULL AND answer IS NOT NULL",
    "vqa_prompts": "SELECT record_id, '<img>' || image_path || '</img>' || question || ' Answer:' AS prompt FROM vqa_question WHERE question IS NOT NULL AND image_path IS NOT NULL",
    "marked_boxes": """WITH t AS (SELECT row_id, CAST(generate_subscripts(conversations, 1) - 1 AS INT) AS turn, unnest(conversations) AS t FROM conversation), b AS (SELECT row_id, turn, unnest(regexp_extract_all(t.value, '<box>(.*?)</box>', 1)) AS box FROM t WHERE t.value IS NOT NULL),
      n AS (SELECT *, list_transform(regexp_extract_all(box, '[0-9]+'), lambda x: CAST(x AS INT)) AS n FROM b)
      SELECT row_id, turn, box, CASE WHEN len(n) >= 4 THEN CAST((n[1] + n[3]) // 2 AS INT) END AS x, CASE WHEN len(n) >= 4 THEN CAST((n[2] + n[4]) // 2 AS INT) END AS y FROM n""",
    "prompt_tails": "SELECT record_id, right(question, CAST(floor(length(question) * 0.9) AS INT)) AS tail, regexp_replace(question, '[^a-zA-Z0-9\\s]', '', 'g') AS plain FROM vqa_question WHERE question IS NOT NULL",
    "bilingual_labels": "SELECT pred_id, regexp_replace(replace(replace(lower(replace(replace(replace(replace(answer, chr(10), ''), '不是', 'No'), '是', 'Yes'), '否', 'No')), 'true', 'yes'), 'false', 'no'), '[一-龥]', '', 'g') AS label FROM prediction WHERE answer IS NOT NULL",
    "judge_scores": """WITH o AS (SELECT o_orderpriority AS p, string_split(replace(CAST(o_custkey % 11 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ', ' ELSE ',' END || CAST(1 + o_orderkey % 10 AS VARCHAR), ',', ' '), ' ') AS t FROM orders),
      x AS (SELECT unnest([p, 'all']) AS category, CASE WHEN len(t) = 2 THEN TRY_CAST(t[1] AS DOUBLE) ELSE -1 END AS a, CASE WHEN len(t) = 2 THEN TRY_CAST(t[2] AS DOUBLE) ELSE -1 END AS b FROM o)
      SELECT category, round(avg(a), 3) AS a, round(avg(b), 3) AS b, round(avg(b) / avg(a) * 100, 1) AS relative FROM x GROUP BY 1""",
    "paired_accuracy": """WITH p AS (SELECT event_type, event_id // 2 AS pair, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS acc, bool_and(value > 10) AS both_right FROM events GROUP BY 1, 2)
      SELECT event_type, count(*) AS pairs, round(100 * avg(acc), 4) AS acc, round(100 * avg(CASE WHEN both_right THEN 1.0 ELSE 0.0 END), 4) AS acc_plus, round(100 * avg(acc) + 100 * avg(CASE WHEN both_right THEN 1.0 ELSE 0.0 END), 4) AS score FROM p GROUP BY 1""",
    "consecutive_pairs": "SELECT count(*) AS pairs, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT event_id // 2 AS pair, count(*) AS n, bool_and(value > 10) AS b FROM events GROUP BY 1) WHERE n = 2",
    "type_rollup": """WITH e AS (SELECT user_id % 12 + 1 AS k, CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END AS h FROM events) SELECT kind, count(*) AS n, round(avg(h), 6) AS accuracy FROM (SELECT unnest(['type ' || k, CASE WHEN k <= 9 THEN 'image' ELSE 'video' END, 'total']) AS kind, h FROM e) GROUP BY 1""",
}
