"""Parsers and record operators on small rows."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import parsing as P
from tesserae.operators import models as M
from tesserae.operators import records as R
from tesserae.operators import training as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def opts(*texts):
    return F.array(*[F.struct(F.lit(chr(65 + i)).alias("key"), F.lit(t).alias("text")) for i, t in enumerate(texts)])


@pytest.mark.parametrize(("answer", "want"), [("The answer is (B).", "B"), ("Either A or C", "C"), ("(A) and then (C)!", "C"), ("I would say that it is a cat here", "A"), ("B", "B")])
def test_multi_choice(spark, answer, want):
    assert value(spark, P.multi_choice(F.lit(answer), opts("cat", "dog", "cow"), F.lit(1))) == want


def test_multi_choice_without_any_is_the_same_every_time(spark):
    a = [value(spark, P.multi_choice(F.lit("none"), opts("x1", "x2", "x3"), F.lit(i))) for i in range(6)]
    assert set(a) <= {"A", "B", "C"} and len(set(a)) > 1
    assert a == [value(spark, P.multi_choice(F.lit("none"), opts("x1", "x2", "x3"), F.lit(i))) for i in range(6)]


def test_open_answers(spark):
    assert "42.5" in value(spark, P.open_answer(F.lit("So the final answer is 42.5")))
    assert value(spark, P.open_correct(F.lit("the result is 1,200"), F.array(F.lit("1200")))) is True
    assert value(spark, P.open_correct(F.lit("It is a red kettle"), F.array(F.lit("Kettle")))) is True
    assert value(spark, P.open_correct(F.lit("7"), F.array(F.lit("8")))) is False


def test_segments(spark):
    s = value(spark, P.segments(F.lit("a<img>p</img>b<ref>c</ref><box>d")))
    assert [(x["kind"], x["value"]) for x in s] == [("text", "a"), ("image", "p"), ("text", "b"), ("ref", "c"), ("text", "<box>d")]
    parts = spark.range(1).select(P.segments(F.lit("<img>p</img>b<ref>c</ref>")).alias("p"))
    assert parts.select(P.joined_segments(F.col("p")).alias("x")).first()["x"] == "Picture 1: <img>p</img>\nb<ref>c</ref>"
    assert value(spark, P.chat_html(F.lit("a<b\n```py\nx<1\n```"))) == 'a&lt;b<br>\n<pre><code class="language-py">\nx&lt;1\n</code></pre>'


def test_rules_and_lookups(spark):
    c = F.array(F.lit("red"), F.lit("blue"))
    rule = lambda t, k: value(spark, R.extracted_answer(F.lit(t), c, F.lit(k)))
    assert (rule("red", "text"), rule("it is (b)", "text"), rule("7.4", "integer"), rule("7.456", "float"), rule('The answer is "x y".', "text"), rule("hm", "text")) == ("red", "blue", "7", "7.46", "x y", None)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert R.by_ids(df, "k", [1, 2]).count() == 2
    with pytest.raises(KeyError):
        R.by_ids(df, "k", [1, 9])
    with pytest.raises(R.InvalidSubmission):
        R.validated(df.select("k"), df, "k", "v")
    with pytest.raises(R.InvalidSubmission):
        R.validated(df.select("k"), df.where("k = 1"), "k", "v")
    assert R.validated(df.where("k < 3").select("k"), df.where("k < 3"), "k", "v").count() == 2
    bad, whole = R.quarantined(df, F.col("v").isNotNull(), "k")
    assert bad.count() == 1 and whole.count() == 3 and whole.where("v is null").count() == 0


def test_samples(spark):
    s = value(spark, T.pair_sample(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7)), 2, 0, 6))
    assert (s["ids"], s["labels"], s["mask"]) == ([5, 6, 7, 2, 0, 0], [-100, -100, 7, 2, -100, -100], [True, True, True, True, False, False])
    assert value(spark, T.positions(F.array(*[F.lit(x) for x in (3, 9, 3, 3, 9, 3)]), 9)) == [0, 1, 0, 1, 2, 0]
    assert value(spark, T.expand_images(F.lit("a<image>b<image>"), F.lit(2))) == "a<img><ctx><ctx></img>b<image>"
    assert value(spark, R.two_scales(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)), "thumbnail_last")) == [1, 3, 2]
    assert value(spark, R.flagged(F.array(F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(1)))) == [2]


def test_models(spark):
    i = spark.createDataFrame([("a",), ("b",), ("c",)], "img_id string")
    assert M.captions(i).count() == 3
    r = M.regions(i)
    assert M.match_scores(r).count() == r.count()

    def failing():
        def run(b):
            raise M.Unavailable("no service")

        return run

    assert [x["answer"] for x in M.answers(spark.createDataFrame([("p",)], "prompt string"), failing).collect()] == [None]
