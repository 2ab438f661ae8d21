"""Training samples: templates, labels, padding, positions, token selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.text import let

IGNORE = -100
#: Separators of the registered templates: system, user, assistant, end of a turn.
TEMPLATES = {
    "plain": ("", "USER: ", "ASSISTANT: ", "\n"),
    "im": ("<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"),
    "phi": ("<|system|>\n", "<|user|>\n", "<|assistant|>\n", "<|end|>\n"),
    "two": ("", "User: ", "Bot: ", "</s>"),
}


def without_system(turns: Column) -> Column:
    """Without a system turn in front."""
    return F.when(F.try_element_at(turns, F.lit(1))["from_role"] == "system", F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)


def from_first_human(turns: Column) -> Column:
    """Without a turn in front that isn't human."""
    t = without_system(turns)
    return F.when(F.try_element_at(t, F.lit(1))["from_role"] != "human", F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(t)


def alternates(turns: Column) -> Column:
    """Human and gpt in turn, human first."""
    return F.forall(F.transform(turns, lambda t, i: t["from_role"] == F.when(i % 2 == 0, "human").otherwise("gpt")), lambda x: x)


def rendered(turns: Column, template: str) -> Column:
    """A conversation as one text."""
    system, user, bot, end = TEMPLATES[template]
    head = lambda t: F.when(t["from_role"] == "human", user).when(t["from_role"] == "gpt", bot).otherwise(system)
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), F.coalesce(t["value"], F.lit("")), F.lit(end))), "")


def messages(turns: Column) -> Column:
    """Role and content in the common naming."""
    role = lambda t: F.when(t["from_role"] == "human", "user").when(t["from_role"] == "gpt", "assistant").otherwise("system")
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), t["value"].alias("content")))


def word_ids(text: Column, size: int = 30000) -> Column:
    """The built-in tokenizer: a bounded number for every word; any other is a function text -> array of numbers."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: (F.pmod(F.crc32(w.cast("binary")), F.lit(size)) + 1).cast("int"))


def pair_sample(prompt: Column, answer: Column, end: int, pad: int, longest: int) -> Column:
    """ids, labels and mask of one pair: the prompt ignored, an end mark that is attended, padding, cut to the longest."""
    room = F.greatest(F.lit(longest) - F.size(prompt) - F.size(answer) - 1, F.lit(0))
    ids = F.slice(F.concat(prompt, answer, F.array(F.lit(end)), F.array_repeat(F.lit(pad), room)), 1, longest)
    labels = F.slice(F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), answer, F.array(F.lit(end)), F.array_repeat(F.lit(IGNORE), room)), 1, longest)
    used = F.least(F.size(prompt) + F.size(answer) + 1, F.lit(longest))
    mask = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda i: i <= used)
    return F.struct(ids.alias("ids"), labels.alias("labels"), mask.alias("mask"))


def dialogue_labels(turns: Column, tokens, separator: int = -1) -> Column:
    """Labels of a dialogue: the answers' tokens, everything else ignored, a separator after every turn."""
    return F.flatten(F.transform(turns, lambda t: F.concat(F.when(t["from_role"] == "gpt", tokens(t["value"])).otherwise(F.array_repeat(F.lit(IGNORE), F.size(tokens(t["value"])))), F.array(F.lit(separator)))))


def padded(df: DataFrame, batch: str, ids: str, pad: int = 0) -> DataFrame:
    """Every row of a batch to the length of its longest, with the mask of what isn't padding."""
    most = F.max(F.size(ids)).over(W.partitionBy(batch))
    out = df.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), most - F.size(ids))))
    return out.withColumn("mask", F.transform(ids, lambda x: x != pad))


def positions(ids: Column, end: int) -> Column:
    """Positions that begin anew after every end-of-document token."""
    places = F.transform(ids, lambda x, i: F.when(x == end, i))  # where the end tokens are
    ends = F.array_compact(places)

    def numbered(stops: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(stops, lambda e: e + 1))
        lengths = F.transform(starts, lambda x, k: F.coalesce(F.try_element_at(starts, k + 2), F.size(ids)) - x)
        return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))))

    return let(ends, numbered)


def with_image_mark(text: Column) -> Column:
    """The mark in front where there is none."""
    return F.when(F.contains(text, F.lit("<image>")), text).otherwise(F.concat(F.lit("<image>\n"), text))


def expand_images(text: Column, tokens: Column) -> Column:
    """The first mark as the context tokens of the image's tiles."""
    at = F.instr(text, "<image>")
    filled = F.concat(F.lit("<img>"), F.repeat(F.lit("<ctx>"), tokens), F.lit("</img>"))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), filled, F.substring(text, at + 7, F.length(text)))).otherwise(text)


def choice_prompt(question: Column, options: Column, hint: Column | None = None) -> Column:
    """Hint, question and a line an option."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")
    body = F.concat(question, F.lit("\n"), lines, F.lit("\nAnswer with the option's letter from the given choices directly."))
    return body if hint is None else F.concat(F.when(hint.isNotNull(), F.concat(hint, F.lit("\n"))).otherwise(""), body)


def likeness_to_later(df: DataFrame, group: str, place: str, vector: str, block: int = 2048) -> DataFrame:
    """The rows with `likeness`: the largest cosine to any later member of the group; -1 for the last one. Places are whole numbers.

    Members are dealt by hash to blocks of about `block`, and every two blocks of a group meet once, as two matrices whose
    product has all their cosines. So no row is paired with a row in a plan, and a large group is many tasks' work.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    dealt = df.select(group, F.col(place).cast("long").alias("p"), F.transform(vector, lambda x: x.cast("double")).alias("v")).join(sizes, group).withColumn("a", F.pmod(F.xxhash64("p"), F.col("_blocks")).cast("int"))
    blocks = dealt.groupBy(group, "a").agg(F.collect_list("p").alias("p"), F.collect_list("v").alias("v"), F.first("_blocks").alias("_blocks"))
    left = blocks.withColumn("b", F.explode(F.sequence(F.col("a"), F.col("_blocks") - 1))).drop("_blocks")
    pairs = left.join(blocks.select(group, F.col("a").alias("b"), F.col("p").alias("q"), F.col("v").alias("w")), [group, "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, v, q, w = (batch.column(k)[i].as_py() for k in range(1, 5))
                p, q, v, w = np.array(p), np.array(q), np.array(v), np.array(w)
                unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                cosine = unit(v) @ unit(w).T
                ahead, behind = np.where(q[None, :] > p[:, None], cosine, -1.0).max(axis=1), np.where(p[:, None] > q[None, :], cosine, -1.0).max(axis=0)
                places = np.concatenate([p, q])
                yield pa.record_batch([pa.array([batch.column(0)[i].as_py()] * len(places), batch.schema.field(0).type), pa.array(places), pa.array(np.concatenate([ahead, behind]))], [group, "p", "likeness"])

    kind = df.schema[group].dataType.simpleString()
    most = pairs.select(group, "p", "v", "q", "w").mapInArrow(run, f"{group} {kind}, p long, likeness double").groupBy(group, "p").agg(F.max("likeness").alias("likeness"))
    return df.join(most.withColumnRenamed("p", place), [group, place])


def least_redundant(df: DataFrame, group: str, place: str, vector: str, keep: int) -> DataFrame:
    """The `keep` members of each group that are least like any later one; of equal ones the earlier. Places differ within a group."""
    scored = likeness_to_later(df, group, place, vector)
    return scored.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("likeness", place))).where(F.col("_r") <= keep).drop("_r")
