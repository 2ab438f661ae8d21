"""Templates and the labels of their families, on a tokenizer that shows every word."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import templates as M

TURNS = "array<struct<from_role:string,value:string>>"
TALK = [("human", "What is it"), ("gpt", "a red kettle"), ("human", "and there"), ("gpt", "a bench")]


def text_of(spark, template, talk=TALK):
    return spark.createDataFrame([(talk,)], f"t {TURNS}").select(M.rendered(F.col("t"), template).alias("x")).first()["x"]


def test_a_message_still_to_come(spark):
    t = M.Template("add_colon_two", ("USER", "ASSISTANT"), " ", "</s>", "{message}", "Sys.")
    assert text_of(spark, t, [("human", "Hi"), ("gpt", None)]) == "Sys. USER: Hi ASSISTANT:"
    assert text_of(spark, t._replace(style="rwkv"), [("human", "a\n\nb"), ("gpt", "")]) == "Sys.USER: a\nb\n\nASSISTANT:"
    assert text_of(spark, M.Template("llama2", ("[INST]", "[/INST]"), " ", " </s><s>"), TALK[:2]) == "[INST] What is it [/INST] a red kettle </s><s>"
    assert text_of(spark, M.Template("chatglm", ("问", "答"), "\n", first_round=1), TALK[:2]) == "[Round 1]\n问：What is it\n答：a red kettle\n"


def vocabulary(begin):
    """Ids by order of first use, and back."""
    known: dict[str, int] = {}

    def tokenize(text):
        import re

        return ([0] if begin else []) + [known.setdefault(w, len(known) + 1) for w in re.findall(r"<[^<>\s]*>|\n|[^\s<]+|<", text)]

    return tokenize, known


@pytest.mark.parametrize(("family", "name", "begin"), [("mpt", "Hermes-2", False), ("phi3", "phi3-chat", True), ("internlm", "internlm2-chat", True)])
def test_labels_are_the_answers(spark, family, name, begin):
    t = M.TEMPLATES[name]
    text = text_of(spark, t)
    tokenize, known = vocabulary(begin)
    ids = tokenize(text)
    first, spans = M.spans(family, text, t, tokenize)
    labels = M.labels(ids, first, spans, 10_000)
    assert len(labels) == len(ids)
    words = {v: k for k, v in known.items()}
    kept = [words[x] for x in labels if x != M.IGNORE]
    answers = [w for w in kept if w in ("a", "red", "kettle", "bench")]
    if any(x != M.IGNORE for x in labels):
        assert answers == ["a", "red", "kettle", "a", "bench"] and not {"What", "and", "there"} & set(kept)
    else:  # the family's own count of begin tokens does not fit this tokenizer: nothing is learned from
        assert sum(n for _, n in spans) + first != len(ids)


def test_spans_that_do_not_add_up_ignore_everything():
    assert M.labels([1, 2, 3, 4], 1, [(1, 2)], 10) == [M.IGNORE] * 4
    assert M.labels([1, 2, 3, 4], 1, [(1, 3)], 10) == [M.IGNORE, M.IGNORE, 3, 4]
    assert M.labels([1, 2, 3, 4], 0, [(1, 2)], 4) == [M.IGNORE] * 4 and M.labels([1, 2, 3, 4], 0, [(1, 5)], 4) == [M.IGNORE, 2, 3, 4]
    with pytest.raises(ValueError):
        M.spans("none", "", M.TEMPLATES["Hermes-2"], list)


def test_images_and_padding(spark):
    one = spark.range(1)
    got = one.select(M.expand_images(F.lit("<image>a<image>b<image>"), F.array(F.lit(1), F.lit(2))).alias("x"), M.expand_images(F.lit("none"), F.array(F.lit(1))).alias("y"), M.frames_mark(F.lit(2)).alias("z")).first()
    assert got["x"] == "<img><IMG_CONTEXT></img>a<img><IMG_CONTEXT><IMG_CONTEXT></img>b<image>" and got["y"] == "none" and got["z"] == "Frame1: <image>\nFrame2: <image>"
    z = one.select(M.zero_padded(F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0))), F.lit(3), F.lit(2)).alias("z")).first()["z"]
    assert z == [[1.0, 0.0], [2.0, 3.0], [0.0, 0.0]]
