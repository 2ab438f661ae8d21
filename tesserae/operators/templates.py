"""Conversation templates: separator styles as data, one expression to render them, and the labels of the families' samples.

A style says what stands before the first message, between a role and its message, and after a message in even and odd
places; everything else is the same for all. Texts are rendered in the JVM; labels need a tokenizer and are made in Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import words

IGNORE = -100


class Style(NamedTuple):
    """`lead` is put in front always, if there is a system prompt ('prompt') or a system message ('message')."""

    lead: str
    when: str
    joint: str
    even: str
    odd: str
    bare: str  # behind the role of a message still to come


#: The separator styles; {system}, {message}, {sep} and {sep2} are the template's.
STYLES = {
    "add_colon_single": Style("{system}{sep}", "always", ": ", "{sep}", "{sep}", ":"),
    "add_colon_two": Style("{system}{sep}", "always", ": ", "{sep}", "{sep2}", ":"),
    "add_colon_space_single": Style("{system}{sep}", "always", ": ", "{sep}", "{sep}", ": "),
    "no_colon_single": Style("{system}", "always", "", "{sep}", "{sep}", ""),
    "no_colon_two": Style("{system}", "always", "", "{sep}", "{sep2}", ""),
    "add_new_line_single": Style("{system}{sep}", "prompt", "\n", "{sep}", "{sep}", "\n"),
    "llama2": Style("{system}", "message", " ", "{sep}", "{sep2}", ""),
    "chatglm": Style("{system}{sep}", "prompt", "：", "{sep}", "{sep}", "："),
    "chatml": Style("{system}{sep}\n", "prompt", "\n", "{sep}\n", "{sep}\n", "\n"),
    "chatintern": Style("{system}", "always", ":", "{sep}\n", "{sep2}\n", ":"),
    "dolly": Style("{system}", "always", ":\n", "{sep}", "{sep2}\n\n", ":\n"),
    "rwkv": Style("{system}", "always", ": ", "\n\n", "\n\n", ":"),
    "phoenix": Style("{system}", "always", ": <s>", "</s>", "</s>", ": <s>"),
    "robin": Style("{system}{sep}", "always", ":\n", "{sep}", "{sep}", ":\n"),
    "falcon_chat": Style("{system}{sep}", "message", ": ", "{sep}", "{sep}", ":"),
    "chatglm3": Style("{system}", "message", "\n ", "", "", ""),
    "internvl_zh": Style("{message}{sep2}", "always", ": ", "{sep2}", "{sep}", ":"),
    "mpt": Style("{system}{sep}", "always", "", "{sep}", "{sep}", ""),
}


class Template(NamedTuple):
    style: str
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    sep: str = "\n"
    sep2: str = ""
    system: str = "{message}"  # the system prompt around the system message
    message: str = ""
    first_round: int = 0  # the number of the first round, where rounds are numbered

    def filled(self, text: str) -> str:
        for name, value in (("{system}", self.system.replace("{message}", self.message)), ("{message}", self.message), ("{sep2}", self.sep2), ("{sep}", self.sep)):
            text = text.replace(name, value)
        return text


_ASSISTANT = "你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。"
#: The registered templates.
TEMPLATES = {
    "internvl_zh": Template("internvl_zh", ("<human>", "<bot>"), "</s>", " ", ""),
    "Hermes-2": Template("mpt", ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_end|>", "", "<|im_start|>system\n{message}", _ASSISTANT),
    "internlm2-chat": Template("mpt", ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_end|>", "", "<|im_start|>system\n{message}", _ASSISTANT),
    "phi3-chat": Template("mpt", ("<|user|>\n", "<|assistant|>\n"), "<|end|>", "", "<|system|>\n{message}", _ASSISTANT),
}


def lead(t: Template) -> str:
    """What stands before the first message."""
    style = STYLES[t.style]
    there = {"always": True, "prompt": t.filled("{system}") != "", "message": t.message != ""}[style.when]
    return t.filled(style.lead) if there else "[INST] " if t.style == "llama2" else ""


def rendered(turns: Column, t: Template) -> Column:
    """A conversation as one text. Roles follow the turns' speakers; a turn without a value is one still to come."""
    style = STYLES[t.style]
    lit = F.lit

    def piece(turn: Column, i: Column) -> Column:
        role = F.when(turn["from_role"] == "gpt", t.roles[1]).otherwise(t.roles[0])
        value, end = turn["value"], F.when(i % 2 == 0, t.filled(style.even)).otherwise(t.filled(style.odd))
        if t.style == "rwkv":
            value = F.replace(F.replace(value, lit("\r\n"), lit("\n")), lit("\n\n"), lit("\n"))
        said = F.concat(role, lit(style.joint), value, end)
        if t.style == "llama2":  # the first message stands in the brackets of the system prompt
            said = F.when(i == 0, F.concat(value, lit(" "))).otherwise(said)
        out = F.when(F.coalesce(turn["value"], lit("")) == "", F.concat(role, lit(style.bare))).otherwise(said)
        if t.style == "chatglm":
            number = (F.floor(i / 2) + t.first_round).cast("string")
            out = F.concat(F.when(i % 2 == 0, F.concat(lit("[Round "), number, lit("]" + t.sep))).otherwise(""), out)
        return out

    return F.concat(lit(lead(t)), F.array_join(F.transform(turns, piece), ""))


# --- labels -------------------------------------------------------------------------------------------------

Tokenize = Callable[[str], list[int]]
Span = tuple[int, int]  # tokens to ignore, tokens of the whole turn


def words_and_marks(text: str, begin: int = 1) -> list[int]:
    """The built-in tokenizer: a begin token, then one for every word, line end and mark in angle brackets."""
    import re
    from zlib import crc32

    return [begin, *(crc32(w.encode()) % 30000 + 10 for w in re.findall(r"<[^<>\s]*>|\n|[^\s<]+|<", text))]


def _rounds(text: str, sep: str) -> list[str]:
    """System, user and assistant as the first round, then user and assistant."""
    parts = text.split(sep)
    return [sep.join(parts[:3]), *(sep.join(parts[i : i + 2]) for i in range(3, len(parts), 2))]


def _split_rounds(texts: list[str], mark: str, size: Callable[[int, str], int], skip: Callable[[int, str], int]) -> Iterator[Span]:
    """A span for every round with one mark between question and answer; the first without ends it."""
    for i, text in enumerate(texts):
        parts = text.split(mark)
        if text == "" or len(parts) != 2:
            return
        yield skip(i, parts[0] + mark), size(i, text)


def spans(family: str, text: str, t: Template, tokenize: Tokenize, legacy: bool = True) -> tuple[int, list[Span]]:
    """Where labels begin, and the spans of a text, as the families count them: each is used to its own tokenizer's begin tokens."""
    count = lambda x: len(tokenize(x))
    later = lambda i: int(i > 0)
    if family == "generic":
        new = lambda i: later(i) * int(not legacy)
        return 1, list(_split_rounds(text.split(t.sep2), t.sep + t.roles[1] + ": ", lambda i, x: count(x) - new(i), lambda i, x: count(x) - 2 - new(i)))
    if family == "mpt":
        return 0, list(_split_rounds(_rounds(text, t.sep), t.sep + t.roles[1], lambda i, x: count(x) + 1, lambda i, x: count(x)))
    if family == "phi3":
        return 1, list(_split_rounds(_rounds(text, t.sep), t.sep + t.roles[1], lambda i, x: count(x) - later(i), lambda i, x: count(x) - 1 - later(i)))
    if family == "internlm":
        parts = text.split(t.roles[1])
        out = []
        asked = count(parts[0] + t.roles[1]) - 1
        for part in parts[1:-1]:
            answer, question = part.split(t.roles[0])
            out.append((asked, asked + count(answer) - 1))
            asked = count(t.roles[0] + question + t.roles[1]) - 1
        return 1, [*out, (asked, asked + count(parts[-1]) - 1)]
    raise ValueError(f"no such family: {family}")


def labels(ids: list[int], begin: int, parts: list[Span], longest: int, pad: int | None = None, never: int | None = None) -> list[int]:
    """The ids with everything but the answers ignored; all ignored where the spans don't add up to the sample."""
    out = [IGNORE if never is not None and x == never else x for x in ids]
    out[:begin] = [IGNORE] * begin
    at = begin
    for skipped, whole in parts:
        out[at : at + skipped] = [IGNORE] * len(out[at : at + skipped])
        at += whole
    out[at:] = [IGNORE] * len(out[at:])
    used = sum(x != pad for x in ids) if pad is not None else len(ids)
    return [IGNORE] * len(ids) if at < longest and at != used else out


SAMPLE = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("labels", T.ArrayType(T.IntegerType()))])


def masked(text: Column, family: str, t: Template, longest: int, tokenize: Tokenize = words_and_marks, never: str | None = None) -> Column:
    """ids and labels of a rendered conversation, cut to the longest."""

    @F.pandas_udf(SAMPLE)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            if x is None:
                rows.append((None, None))
                continue
            ids = tokenize(x)[:longest]
            begin, parts = spans(family, x, t, tokenize)
            rows.append((ids, labels(ids, begin, parts, longest, never=tokenize(never)[-1] if never else None)))
        return pd.DataFrame(rows, columns=["ids", "labels"])

    return run(text)


# --- other samples ------------------------------------------------------------------------------------------


def expand_images(text: Column, tokens: Column) -> Column:
    """One `<image>` mark after the other as begin, as many context tokens as its entry says, and end; marks without an entry stay."""
    fill = lambda n: F.concat(F.lit("<img>"), F.repeat(F.lit("<IMG_CONTEXT>"), n), F.lit("</img>"))
    parts = F.split(text, "<image>")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.concat(F.coalesce(fill(F.try_element_at(tokens, i + 1)), F.lit("<image>")), p))
    return F.concat(parts[0], F.array_join(tail, ""))


def frames_mark(frames: Column) -> Column:
    """The lines that stand for the frames of a video."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(frames, F.lit(1))), lambda i: F.concat(F.lit("Frame"), i.cast("string"), F.lit(": <image>"))), "\n")


def padded_to(ids: Column, length: int, pad: int, left: bool = False) -> Column:
    """Ids filled up to a fixed length; longer ones stay as they are."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def zero_padded(grid: Column, rows: Column, columns: Column) -> Column:
    """A ragged matrix filled with zeros to the given shape."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)))
    wide = F.transform(grid, lambda r: F.concat(r, zeros(columns - F.size(r))))
    return F.concat(wide, F.array_repeat(zeros(columns), F.greatest(rows - F.size(grid), F.lit(0))))


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))
