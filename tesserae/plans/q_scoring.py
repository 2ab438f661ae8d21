"""Answer scoring over predictions, their gold answers and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import numeric as N
from tesserae.functions import text as X
from tesserae.operators import records as R
from tesserae.sources.readers import table

#: Rows with an answer and at least one gold answer.
SCORED = "answer IS NOT NULL AND annotation IS NOT NULL AND len(annotation) > 0"
BLANK = "[\\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
STRIP = f"regexp_replace({{}}, '^{BLANK}+|{BLANK}+$', '', 'g')"



def scored(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prediction").where("answer is not null and annotation is not null and size(annotation) > 0")


def _mean(c: Column, name: str) -> Column:
    return F.round(F.avg(c.cast("double")), 6).alias(name)


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def distance_sql(a: str, b: str) -> str:
    """Edit distance by code points. DuckDB counts bytes, so every character both texts have becomes a byte of its own, and any other one of two that never meet."""
    chars = lambda x: f"list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1))"
    told = f"list_intersect(list_distinct({chars('p.d1')}), list_distinct({chars('p.d2')}))"
    byte = lambda x, other: f"array_to_string(list_transform({chars(x)}, lambda c: chr(CAST(CASE WHEN list_position(q.ds, c) > 0 THEN list_position(q.ds, c) + 2 ELSE {other} END AS INT))), '')"
    return f"(SELECT levenshtein({byte('q.d1', 1)}, {byte('q.d2', 2)}) FROM (SELECT p.d1, p.d2, {told} AS ds FROM (SELECT {a} AS d1, {b} AS d2) p) q)"


def anls_by_source(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).groupBy("source").agg(_n(), _mean(X.anls(F.col("annotation"), F.col("answer")), "anls"))


def anls_by_tag(s: SparkSession, d: str) -> DataFrame:
    """A row counts for every tag it carries."""
    squeeze = lambda c: F.regexp_replace(X.strip(F.lower(c)), r"\s+", " ")
    p = scored(s, d).select("source", "split", X.let(squeeze(F.col("answer")), lambda a: X.anls(F.transform("annotation", squeeze), a)).alias("anls"))
    tags = F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("split:"), "split"), F.lit("all"))
    return p.select(F.explode(tags).alias("tag"), "anls").groupBy("tag").agg(_n(), _mean(F.col("anls"), "anls"))


def anls_scene_text(s: SparkSession, d: str) -> DataFrame:
    """The largest similarity over the gold answers, lengths after normalising."""
    flat = lambda c: X.strip(F.lower(c))

    def best(a: Column) -> Column:
        longest = lambda g: F.greatest(F.length(g), F.length(a), F.lit(1))
        return F.array_max(F.transform(F.transform("annotation", flat), lambda g: 1.0 - X.near_distance(g, a, longest(g)) / longest(g)))

    p = scored(s, d).select("run_name", X.let(flat(F.col("answer")), best).alias("best"))
    return p.groupBy("run_name").agg(_n(), _mean(F.when(F.col("best") >= 0.5, F.col("best")).otherwise(0.0), "anls"))


def relaxed_accuracy(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).groupBy("source").agg(_n(), _mean(F.exists("annotation", lambda g: N.relaxed_correct(g, F.col("answer"))), "accuracy"))


def substring_accuracy(s: SparkSession, d: str) -> DataFrame:
    a = X.strip(F.lower(F.replace("answer", F.lit("."), F.lit(""))))
    return scored(s, d).groupBy("source").agg(_n(), _mean(F.exists("annotation", lambda g: F.contains(a, X.strip(F.lower(g)))), "accuracy"))


def tagged_accuracy(s: SparkSession, d: str) -> DataFrame:
    a = X.strip(F.lower(X.strip_tags(F.col("answer"))))
    return scored(s, d).groupBy("source").agg(_n(), _mean(F.exists("annotation", lambda g: F.contains(a, X.strip(F.lower(g)))), "accuracy"))


def exact_accuracy(s: SparkSession, d: str) -> DataFrame:
    a = X.strip(F.lower("answer"))
    return scored(s, d).groupBy("source").agg(_n(), _mean(F.exists("annotation", lambda g: X.strip(F.lower(g)) == a), "accuracy"))


def consensus_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Leave-one-out consensus, overall, by source and by split; gold answers that differ lose their marks first, the answer always."""
    said = X.consensus_form(F.col("answer"))
    golds = F.when(F.size(F.array_distinct("annotation")) > 1, F.transform("annotation", X.process_punctuation)).otherwise(F.col("annotation"))
    m = X.let(said, lambda a: F.size(F.filter(golds, lambda g: g == a)))
    p = scored(s, d).select("source", "split", N.leave_one_out(m, F.size("annotation")).alias("acc"))
    each = p.select(F.explode(F.array(F.struct(F.lit("*").alias("source"), F.lit("*").alias("split")), F.struct("source", F.lit("*").alias("split")), F.struct(F.lit("*").alias("source"), "split"))).alias("k"), "acc")
    return each.groupBy("k.source", "k.split").agg(_n(), F.round(F.avg("acc") * 100, 2).alias("accuracy"))


def ten_answer_consensus(s: SparkSession, d: str) -> DataFrame:
    """Of questions with ten annotators: the score of the answer's normal form, 0 if nobody gave it."""
    p = scored(s, d).where(F.size("annotation") == 10)
    m = X.let(X.answer_processor(F.col("answer")), lambda a: F.size(F.filter("annotation", lambda g: X.answer_processor(g) == a)))
    return p.select("source", m.alias("m")).groupBy("source").agg(_n(), F.round(F.avg(F.when(F.col("m") > 0, N.leave_one_out(F.col("m"), F.lit(10))).otherwise(0.0)), 6).alias("accuracy"))


def processed_exact(s: SparkSession, d: str) -> DataFrame:
    """Equality of the normal forms."""
    hit = X.let(X.answer_processor(F.col("answer")), lambda a: F.exists(F.array_distinct("annotation"), lambda g: X.answer_processor(g) == a))
    return scored(s, d).groupBy("source").agg(_n(), _mean(hit, "accuracy"))


def _yes_no_rows(s: SparkSession, d: str) -> DataFrame:
    p = scored(s, d).where(F.lower(F.element_at("annotation", 1)).isin("yes", "no"))
    return p.select("source", F.lower(F.element_at("annotation", 1)).alias("label"), X.yes_no(F.col("answer")).alias("said"), X.yes_no_other(F.col("answer")).alias("said3"))


def yes_no_confusion(s: SparkSession, d: str) -> DataFrame:
    c = lambda label, said, name: F.count_if((F.col("label") == label) & (F.col("said") == said)).alias(name)
    g = _yes_no_rows(s, d).agg(c("yes", "yes", "tp"), c("no", "yes", "fp"), c("no", "no", "tn"), c("yes", "no", "fn"))
    r = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return g.select("tp", "fp", "tn", "fn", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"), r(tp + tn, tp + fp + tn + fn).alias("accuracy"), r(tp + fp, tp + fp + tn + fn).alias("yes_ratio"))


def ternary_metrics(s: SparkSession, d: str) -> DataFrame:
    """Accuracy counts other as wrong; precision and recall leave it out."""
    r = _yes_no_rows(s, d)
    known = F.col("said3") != "other"
    tp = F.count_if((F.col("label") == "yes") & (F.col("said3") == "yes"))
    return r.groupBy("source").agg(
        _n(),
        F.count_if(~known).alias("other_num"),
        F.round(F.count_if(F.col("label") == F.col("said3")) / F.count(F.lit(1)), 6).alias("accuracy"),
        F.round(tp / F.nullif(F.count_if(known & (F.col("said3") == "yes")), F.lit(0)), 6).alias("precision"),
        F.round(tp / F.nullif(F.count_if(known & (F.col("label") == "yes")), F.lit(0)), 6).alias("recall"),
    )


def mean_caption_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prediction").where("answer is not null").groupBy("run_name").agg(_n(), _mean(F.size(X.words(F.col("answer"))), "mean_words"))


def dataset_sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vqa_question").groupBy("source", "split").agg(_n())


def task_sum_overall(s: SparkSession, d: str) -> DataFrame:
    """Accuracy by task and, as Overall, their sum."""
    hit = F.exists("annotation", lambda g: F.contains(F.lower("answer"), F.lower(g)))
    by = scored(s, d).select(F.col("source").alias("task"), hit.cast("double").alias("h")).groupBy("task").agg(F.avg("h").alias("a"))
    return by.unionByName(by.agg(F.sum("a").alias("a")).select(F.lit("Overall").alias("task"), "a")).select("task", F.round("a", 6).alias("accuracy"))


#: The keys of the accuracy report; the last one holds a list, of which every member counts.
KEYS = ("question_type", "answer_type", "language", "source", "category", "task", "context", "grade", "skills")


def keyed_accuracy(s: SparkSession, d: str) -> DataFrame:
    """One row for all predictions and one for every value of nine keys: right ones, all, accuracy in percent."""
    a = F.col("answer")
    first = F.element_at("annotation", 1)
    kind = F.when(first.rlike(r"^[+-]?\d+$"), "integer").when(first.rlike(r"^[+-]?\d*\.\d+$"), "float").otherwise("text")
    values = {
        "question_type": F.when(F.size("annotation") > 1, "multi_choice").otherwise("free_form"),
        "answer_type": kind,
        "language": F.when(first.rlike("[一-龥]"), "chinese").otherwise("english"),
        "source": F.col("source"),
        "category": F.col("split"),
        "task": F.col("run_name"),
        "context": F.when(F.col("image_path").isNull(), "none").otherwise("picture"),
        "grade": F.when(F.length(first) < 4, "short").otherwise("long"),
    }
    hit = F.exists("annotation", lambda g: X.strip(F.lower(g)) == X.strip(F.lower(a)))
    skills = F.array_compact(F.array(F.when(kind != "text", "numbers"), F.when(first.contains(" "), "phrases"), F.when(F.length(first) > 0, "reading")))
    rows = scored(s, d).select(hit.cast("int").alias("h"), *(F.coalesce(v, F.lit("none")).alias(k) for k, v in values.items()), skills.alias("skills"))
    return R.accuracy_by_keys(rows, "h", [*values], "skills")


def accuracy_by_keys(s: SparkSession, d: str) -> DataFrame:
    return keyed_accuracy(s, d).select("key", "value", "correct", "total", "accuracy", "place")


def accuracy_gain(s: SparkSession, d: str) -> DataFrame:
    """The gain of every figure over another run's, here one that answers `yes` to everything."""
    chance = scored(s, d).withColumn("answer", F.lit("yes"))
    hit = F.exists("annotation", lambda g: X.strip(F.lower(g)) == "yes").cast("int")
    rows = lambda df, h: df.select(h.alias("h"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("split", F.lit("none")).alias("split"), F.array(F.coalesce("run_name", F.lit("none"))).alias("skills"))
    own = F.exists("annotation", lambda g: X.strip(F.lower(g)) == X.strip(F.lower("answer"))).cast("int")
    a, b = (R.accuracy_by_keys(rows(df, h), "h", ["source", "split"], "skills") for df, h in ((scored(s, d), own), (chance, hit)))
    return R.gains(a, b).select("key", "value", "accuracy", "gain")


def answer_lookup(s: SparkSession, d: str) -> DataFrame:
    """Gold answers of all redelivered rows of a question as one list."""
    q = table(s, d, "vqa_question").where("question_id is not null and answer is not null")
    return q.select("source", "split", "question_id", F.explode("answer").alias("a")).groupBy("source", "split", "question_id").agg(F.array_join(F.array_sort(F.collect_list("a")), "|").alias("answers"), F.count(F.lit(1)).alias("n"))


def key_set_differences(s: SparkSession, d: str) -> DataFrame:
    """Keys of predictions without question and of evaluation questions without prediction."""
    key = ["source", "split", "question_id"]
    p = table(s, d, "prediction").where("question_id is not null").select(*key).distinct()
    q = table(s, d, "vqa_question").where("question_id is not null and split <> 'train'").select(*key).distinct()
    a = p.join(q, key, "left_anti").groupBy("source").agg(_n()).withColumn("side", F.lit("prediction"))
    b = q.join(p, key, "left_anti").groupBy("source").agg(_n()).withColumn("side", F.lit("question"))
    return a.unionByName(b)


def last_wins(s: SparkSession, d: str) -> DataFrame:
    """Of repeated keys the last row."""
    return table(s, d, "prediction").where("question_id is not null").groupBy("run_name", "source", "split", "question_id").agg(F.max_by("answer", "pred_id").alias("answer"), F.max("pred_id").alias("pred_id"))


def question_images(s: SparkSession, d: str) -> DataFrame:
    """Images of the questions that a run has answered."""
    key = ["source", "split", "question_id"]
    q = table(s, d, "vqa_question").where("image_path is not null")
    return q.join(table(s, d, "prediction").where("answer is not null").select(*key), key, "left_semi").groupBy("source").agg(F.countDistinct("image_path").alias("images"))


def gqa_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers as submitted: no closing periods, lower case."""
    return table(s, d, "prediction").where("answer is not null").select("pred_id", F.lower(F.regexp_replace("answer", r"\.+$", "")).alias("prediction"))


def number_lists(s: SparkSession, d: str) -> DataFrame:
    """Numbers in the answers: with commas, in scientific form, plain."""
    return table(s, d, "prediction").where("answer is not null").select("pred_id", F.posexplode(X.extract_numbers(F.col("answer"))).alias("place", "number"))


def domain_weighted_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Accuracy by source, then by domain weighted with the number of examples."""
    hit = F.exists("annotation", lambda g: X.strip(F.lower(g)) == X.strip(F.lower("answer"))).cast("double")
    by = scored(s, d).groupBy("source").agg(F.avg(hit).alias("acc"), _n())
    m = table(s, d, "manifest").select(F.col("ds_name").alias("source"), F.coalesce("domain", F.lit("none")).alias("domain"))
    return by.join(m, "source").groupBy("domain").agg(F.sum("n").alias("num_example"), F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 3).alias("accuracy"))


QUERIES = {f.__name__: f for f in (anls_by_source, anls_by_tag, anls_scene_text, relaxed_accuracy, substring_accuracy, tagged_accuracy, exact_accuracy, consensus_accuracy, ten_answer_consensus, processed_exact, yes_no_confusion, ternary_metrics, mean_caption_words, dataset_sizes, task_sum_overall, accuracy_by_keys, accuracy_gain, answer_lookup, key_set_differences, last_wins, question_images, gqa_answers, number_lists, domain_weighted_accuracy)}

_G = "list_transform(annotation, lambda g: {})"
_EX = "CAST(avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END) AS DOUBLE)"
_HIT = f"list_contains({_G.format(STRIP.format('lower(g)'))}, {STRIP.format('lower(answer)')})"
_SUB = "len(list_filter(annotation, lambda g: contains({a}, " + STRIP.format("lower(g)") + "))) > 0"
_NUM = "'^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$'"


def _number(c: str) -> str:
    v = f"CASE WHEN regexp_matches(regexp_replace({c}, '%$', ''), {_NUM}) THEN TRY_CAST(trim(regexp_replace({c}, '%$', '')) AS DOUBLE) END"
    return f"(CASE WHEN ends_with({c}, '%') THEN ({v}) / 100.0 ELSE ({v}) END)"


_REL = f"CASE WHEN {_number('answer')} IS NOT NULL AND {_number('g')} IS NOT NULL AND {_number('g')} <> 0 THEN abs({_number('answer')} - {_number('g')}) / abs({_number('g')}) <= 0.05 ELSE lower(answer) = lower(g) END"
_SQ = "regexp_replace(" + STRIP.format("lower({})") + ", '\\s+', ' ', 'g')"
_FL = STRIP.format("lower({})")


def _low(x: str) -> str:
    return STRIP.format(f"lower({x})")


def _anls(golds: str, keys: str, where: str = SCORED) -> str:
    """The rows with their best similarity; a gold answer a row first, as a query stands for the distance."""
    pairs = f"(SELECT pred_id, {keys}, g, a FROM (SELECT pred_id, {keys}, a, unnest(golds) AS g FROM {golds}))"
    share = f"CASE WHEN greatest(length(g), length(a)) = 0 THEN 0.0 ELSE {distance_sql(_low('g'), _low('a'))} / greatest(length(g), length(a)) END"
    return f"(SELECT pred_id, any_value(STRUCT_PACK({', '.join(f'{k} := {k}' for k in keys.split(', '))})) AS k, 1.0 - min(CAST({share} AS DOUBLE)) AS s FROM {pairs} GROUP BY pred_id)"


def _marks(c: str) -> str:
    out = c
    for p in X.PUNCTUATION:
        q = p.replace("'", "''")
        out = f"replace({out}, '{q}', CASE WHEN contains({c}, '{q} ') OR contains({c}, ' {q}') OR regexp_matches({c}, '\\d,\\d') THEN '' ELSE ' ' END)"
    parts = f"string_split({out}, '.')"
    return f"list_reduce(list_transform({parts}, lambda x: x), lambda x, y: CASE WHEN regexp_matches(y, '^\\d') THEN x || '.' || y ELSE x || y END)"


def _map(t: dict[str, str]) -> str:
    return "MAP {" + ", ".join("'{}': '{}'".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in t.items()) + "}"


def _form(c: str) -> str:
    """Macros would be shorter; a view per step keeps every text worked out once."""
    said = f"list_transform(list_filter(regexp_split_to_array(lower({c}), '{BLANK}+'), lambda w: w <> ''), lambda w: coalesce({_map(X.NUMBER_WORDS)}[w], w))"
    return f"array_to_string(list_transform(list_filter({said}, lambda w: w NOT IN ('a', 'an', 'the')), lambda w: coalesce({_map(X.CONTRACTIONS)}[w], w)), ' ')"


_FLAT = STRIP.format("replace(replace({}, chr(10), ' '), chr(9), ' ')")
_FIRST = STRIP.format("replace(replace(replace(lower({}), ',', ''), '?', ''), chr(39) || 's', ' ' || chr(39) || 's')")


def _processed(where: str = SCORED) -> str:
    """pred_id, source, x (the answer's form), g (a gold answer's form): a row a gold answer."""
    rows = f"SELECT pred_id, source, 0 AS gold, answer AS t FROM prediction WHERE {where} UNION ALL SELECT pred_id, source, 1, unnest(annotation) FROM prediction WHERE {where}"
    flat = f"SELECT pred_id, source, gold, {_FLAT.format(_FIRST.format('t'))} AS t FROM ({rows})"
    bare = f"SELECT pred_id, source, gold, {_marks('t')} AS t FROM ({flat})"
    return f"f AS (SELECT pred_id, source, gold, {_form('t')} AS t FROM ({bare})), w AS (SELECT a.pred_id, a.source, a.t AS x, list(g.t) AS g FROM f a JOIN f g ON g.pred_id = a.pred_id AND g.gold = 1 WHERE a.gold = 0 GROUP BY ALL)"


_KEYED = f"""r AS (SELECT CASE WHEN {_HIT} THEN 1 ELSE 0 END AS h, coalesce(source, 'none') AS source, coalesce(split, 'none') AS category, coalesce(run_name, 'none') AS task, CASE WHEN image_path IS NULL THEN 'none' ELSE 'picture' END AS context,
  CASE WHEN len(annotation) > 1 THEN 'multi_choice' ELSE 'free_form' END AS question_type, annotation[1] AS f FROM prediction WHERE {SCORED}),
  t AS (SELECT *, CASE WHEN regexp_matches(f, '^[+-]?\\d+$') THEN 'integer' WHEN regexp_matches(f, '^[+-]?\\d*\\.\\d+$') THEN 'float' ELSE 'text' END AS answer_type, CASE WHEN regexp_matches(f, '[一-龥]') THEN 'chinese' ELSE 'english' END AS language, CASE WHEN length(f) < 4 THEN 'short' ELSE 'long' END AS grade FROM r),
  k AS (SELECT h, unnest([{{'key': 'average', 'value': 'all'}}, """ + ", ".join(f"{{'key': '{k}', 'value': {k}}}" for k in KEYS[:-1]) + """]) AS k FROM t
    UNION ALL SELECT h, {'key': 'skills', 'value': unnest([x for x in [CASE WHEN answer_type <> 'text' THEN 'numbers' END, CASE WHEN contains(f, ' ') THEN 'phrases' END, CASE WHEN length(f) > 0 THEN 'reading' END] if x IS NOT NULL])} FROM t),
  g AS (SELECT k.key AS key, k.value AS value, CAST(sum(h) AS BIGINT) AS correct, count(*) AS total, round(100.0 * sum(h) / count(*), 2) AS accuracy FROM k GROUP BY 1, 2)"""
_LOO = "({m} * least(1.0, ({m} - 1) / 3.0) + ({n} - {m}) * least(1.0, {m} / 3.0)) / {n}"
_YN = f"""yn AS (SELECT source, lower(annotation[1]) AS label, lower(answer) AS low, substr(lower(answer), 1, 4) AS head,
  CASE WHEN len(list_filter(string_split(replace(split_part(answer, '.', 1), ',', ''), ' '), lambda w: w IN ('No', 'not', 'no'))) > 0 THEN 'no' ELSE 'yes' END AS said
  FROM prediction WHERE {SCORED} AND lower(annotation[1]) IN ('yes', 'no'))"""

SQL = {
    "anls_by_source": f"SELECT k.source AS source, count(*) AS n, round(avg(CASE WHEN s < 0.5 THEN 0.0 ELSE s END), 6) AS anls FROM {_anls(f'(SELECT pred_id, source, answer AS a, annotation AS golds FROM prediction WHERE {SCORED})', 'source')} GROUP BY 1",
    "anls_by_tag": f"""WITH r AS {_anls(f"(SELECT pred_id, source, split, {_SQ.format('answer')} AS a, {_G.format(_SQ.format('g'))} AS golds FROM prediction WHERE {SCORED})", 'source, split')}
      SELECT tag, count(*) AS n, round(avg(CASE WHEN s < 0.5 THEN 0.0 ELSE s END), 6) AS anls FROM (SELECT unnest(['source:' || k.source, 'split:' || k.split, 'all']) AS tag, s FROM r) GROUP BY 1""",
    "anls_scene_text": f"""SELECT k.run_name AS run_name, count(*) AS n, round(avg(CASE WHEN s >= 0.5 THEN s ELSE 0.0 END), 6) AS anls FROM {_anls(f"(SELECT pred_id, run_name, {_FL.format('answer')} AS a, {_G.format(_FL.format('g'))} AS golds FROM prediction WHERE {SCORED})", 'run_name')} GROUP BY 1""",
    "processed_exact": f"WITH {_processed()} SELECT source, count(*) AS n, round(avg(CASE WHEN list_contains(g, x) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM w GROUP BY 1",
    "relaxed_accuracy": f"SELECT source, count(*) AS n, round({_EX.format(f'len(list_filter(annotation, lambda g: {_REL})) > 0')}, 6) AS accuracy FROM prediction WHERE {SCORED} GROUP BY 1",
    "substring_accuracy": f"SELECT source, count(*) AS n, round({_EX.format(_SUB.replace('{a}', STRIP.format("lower(replace(answer, '.', ''))")))}, 6) AS accuracy FROM prediction WHERE {SCORED} GROUP BY 1",
    "tagged_accuracy": "SELECT source, count(*) AS n, round("
    + _EX.format(_SUB.replace("{a}", STRIP.format("lower(regexp_replace(answer, '<(box|point|quad)>.*?</(box|point|quad)>|</?(ref|box|point|quad)>', '', 'g'))")))
    + f", 6) AS accuracy FROM prediction WHERE {SCORED} GROUP BY 1",
    "exact_accuracy": f"SELECT source, count(*) AS n, round({_EX.format(_HIT)}, 6) AS accuracy FROM prediction WHERE {SCORED} GROUP BY 1",
    "consensus_accuracy": f"""WITH q AS (SELECT pred_id, source, split, annotation, {_FLAT.format('answer')} AS t FROM prediction WHERE {SCORED}), b AS (SELECT *, {_marks('t')} AS u FROM q), c AS (SELECT *, {_form('u')} AS x FROM b),
      g AS (SELECT pred_id, {_marks('t')} AS t FROM (SELECT pred_id, unnest(annotation) AS t FROM q WHERE len(list_distinct(annotation)) > 1) UNION ALL SELECT pred_id, unnest(annotation) FROM q WHERE len(list_distinct(annotation)) <= 1),
      m AS (SELECT c.pred_id, source, split, len(annotation) AS n, CAST(count(*) FILTER (g.t = x) AS DOUBLE) AS m FROM c JOIN g ON g.pred_id = c.pred_id GROUP BY ALL)
      SELECT coalesce(source, '*') AS source, coalesce(split, '*') AS split, count(*) AS n, round(avg({_LOO.format(m='m', n='n')}) * 100, 2) AS accuracy FROM m GROUP BY GROUPING SETS ((), (source), (split))""",
    "ten_answer_consensus": f"""WITH {_processed(f'{SCORED} AND len(annotation) = 10')}, m AS (SELECT source, CAST(len(list_filter(g, lambda y: y = x)) AS DOUBLE) AS m FROM w)
      SELECT source, count(*) AS n, round(avg(CASE WHEN m > 0 THEN {_LOO.format(m='m', n='10.0')} ELSE 0.0 END), 6) AS accuracy FROM m GROUP BY 1""",
    "yes_no_confusion": f"""WITH {_YN}, c AS (SELECT count(*) FILTER (label = 'yes' AND said = 'yes') AS tp, count(*) FILTER (label = 'no' AND said = 'yes') AS fp, count(*) FILTER (label = 'no' AND said = 'no') AS tn, count(*) FILTER (label = 'yes' AND said = 'no') AS fn FROM yn)
      SELECT tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round((tp + fp) / nullif(tp + fp + tn + fn, 0), 6) AS yes_ratio FROM c""",
    "ternary_metrics": f"""WITH {_YN}, t AS (SELECT source, label, CASE WHEN low IN ('yes', 'no') THEN low WHEN contains(head, 'yes') THEN 'yes' WHEN contains(head, 'no') THEN 'no' ELSE 'other' END AS s3 FROM yn)
      SELECT source, count(*) AS n, count(*) FILTER (s3 = 'other') AS other_num, round(count(*) FILTER (label = s3) / count(*), 6) AS accuracy,
      round(count(*) FILTER (label = 'yes' AND s3 = 'yes') / nullif(count(*) FILTER (s3 = 'yes'), 0), 6) AS precision, round(count(*) FILTER (label = 'yes' AND s3 = 'yes') / nullif(count(*) FILTER (label = 'yes' AND s3 <> 'other'), 0), 6) AS recall FROM t GROUP BY 1""",
    "mean_caption_words": "SELECT run_name, count(*) AS n, round(avg(len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> ''))), 6) AS mean_words FROM prediction WHERE answer IS NOT NULL GROUP BY 1",
    "dataset_sizes": "SELECT source, split, count(*) AS n FROM vqa_question GROUP BY 1, 2",
    "task_sum_overall": f"""WITH t AS (SELECT source AS task, {_EX.format('len(list_filter(annotation, lambda g: contains(lower(answer), lower(g)))) > 0')} AS a FROM prediction WHERE {SCORED} GROUP BY 1)
      SELECT task, round(a, 6) AS accuracy FROM (SELECT * FROM t UNION ALL SELECT 'Overall', sum(a) FROM t)""",
    "accuracy_by_keys": f"WITH {_KEYED} SELECT key, value, correct, total, accuracy, CAST(row_number() OVER (PARTITION BY key ORDER BY accuracy DESC, value) AS INT) AS place FROM g",
    "accuracy_gain": f"""WITH r AS (SELECT CASE WHEN {_HIT} THEN 1 ELSE 0 END AS h, CASE WHEN list_contains({_G.format(STRIP.format('lower(g)'))}, 'yes') THEN 1 ELSE 0 END AS y, coalesce(source, 'none') AS source, coalesce(split, 'none') AS split, coalesce(run_name, 'none') AS skills FROM prediction WHERE {SCORED}),
      k AS (SELECT h, y, unnest([{{'key': 'average', 'value': 'all'}}, {{'key': 'source', 'value': source}}, {{'key': 'split', 'value': split}}, {{'key': 'skills', 'value': skills}}]) AS k FROM r), g AS (SELECT k.key AS key, k.value AS value, round(100.0 * sum(h) / count(*), 2) AS accuracy, round(100.0 * sum(y) / count(*), 2) AS chance FROM k GROUP BY 1, 2)
      SELECT key, value, accuracy, round(accuracy - chance, 2) AS gain FROM g""",
    "answer_lookup": "SELECT source, split, question_id, list_aggregate(list_sort(list(a)), 'string_agg', '|') AS answers, count(*) AS n FROM (SELECT source, split, question_id, unnest(answer) AS a FROM vqa_question WHERE question_id IS NOT NULL AND answer IS NOT NULL) GROUP BY 1, 2, 3",
    "key_set_differences": """WITH p AS (SELECT DISTINCT source, split, question_id FROM prediction WHERE question_id IS NOT NULL), q AS (SELECT DISTINCT source, split, question_id FROM vqa_question WHERE question_id IS NOT NULL AND split <> 'train')
      SELECT source, count(*) AS n, 'prediction' AS side FROM (SELECT * FROM p EXCEPT SELECT * FROM q) GROUP BY 1 UNION ALL SELECT source, count(*), 'question' FROM (SELECT * FROM q EXCEPT SELECT * FROM p) GROUP BY 1""",
    "last_wins": "SELECT run_name, source, split, question_id, answer, pred_id FROM (SELECT run_name, source, split, question_id, arg_max_null(answer, pred_id) AS answer, max(pred_id) AS pred_id FROM prediction WHERE question_id IS NOT NULL GROUP BY ALL)",
    "question_images": "SELECT q.source, count(DISTINCT image_path) AS images FROM vqa_question q WHERE image_path IS NOT NULL AND EXISTS (SELECT 1 FROM prediction p WHERE p.answer IS NOT NULL AND p.source = q.source AND p.split = q.split AND p.question_id = q.question_id) GROUP BY 1",
    "gqa_answers": "SELECT pred_id, lower(regexp_replace(answer, '\\.+$', '')) AS prediction FROM prediction WHERE answer IS NOT NULL",
    "domain_weighted_accuracy": f"""WITH b AS (SELECT source, {_EX.format(_HIT)} AS acc, count(*) AS n FROM prediction WHERE {SCORED} GROUP BY 1)
      SELECT coalesce(domain, 'none') AS domain, CAST(sum(n) AS BIGINT) AS num_example, round(sum(acc * n) / sum(n), 3) AS accuracy FROM b JOIN manifest ON ds_name = source GROUP BY 1""",
}
