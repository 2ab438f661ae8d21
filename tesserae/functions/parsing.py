"""Parsers of answers and of tagged text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import text as X
from tesserae.functions.numeric import NUMBER

#: What leads to an open answer, and words of quantity (two of them are one, so that neither is found).
LEADS = ["could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result "]
QUANTITY_WORDS = ["most", "least", "fewestmore", "less", "fewer", "largest", "smallest", "greatest", "larger", "smaller", "greater", "highest", "lowest", "higher", "lower", "increase", "decrease", "minimum", "maximum", "max", "min", "mean", "average", "median", "total", "sum", "add", "subtract", "difference", "quotient", "gap", "half", "double", "twice", "triple", "square", "cube", "root", "approximate", "approximation", "triangle", "rectangle", "circle", "square", "cube", "sphere", "cylinder", "cone", "pyramid", "multiply", "divide", "percentage", "percent", "ratio", "proportion", "fraction", "rate"]


def multi_choice(response: Column, options: Column, row: Column, seed: int = 42) -> Column:
    """The option a free answer names: (A) before a bare A before an option's text in an answer of over five words.

    Of several the one whose last mention begins last, of equal ones the first option; of none a choice that depends on the
    row and the seed alone.
    """
    r = response
    for mark in (",", ".", "!", "?", ";", ":", "'"):
        r = F.regexp_replace(r, f"^[{mark}]+|[{mark}]+$", "")

    def named(text: Column) -> Column:
        low = F.lower(text)
        place = lambda f: F.transform(options, lambda o, i: F.struct(f(o).alias("at"), (-i).alias("order"), o["key"].alias("key")))
        pick = lambda a: F.array_max(F.filter(a, lambda x: x["at"] > 0))["key"]
        bracket = place(lambda o: last_start(text, F.concat(F.lit("("), o["key"], F.lit(")"))))
        bare = place(lambda o: last_start(text, F.concat(F.lit(" "), o["key"], F.lit(" "))))
        told = place(lambda o: F.when(F.size(X.words(text)) > 5, last_start(low, F.lower(o["text"]))).otherwise(0))
        return F.coalesce(pick(bracket), pick(bare), pick(told))

    chance = F.element_at(options, (F.pmod(F.xxhash64(F.lit(seed), row), F.size(options)) + 1).cast("int"))["key"]
    return F.coalesce(X.let(F.concat(F.lit(" "), r, F.lit(" ")), named), chance)


def last_start(text: Column, part: Column) -> Column:
    """Where the last occurrence begins, from 1; 0 for none. An empty part is found at the end."""
    back = F.call_function("instr", F.reverse(text), F.reverse(part))
    return F.when(F.length(part) == 0, F.length(text) + 1).when(back > 0, F.length(text) - back - F.length(part) + 2).otherwise(0)


def open_answer(response: Column) -> Column:
    """Pieces of a free answer that may be the answer, then the numbers in them.

    Of every line the shortest rest behind a lead word (in the last one an equals sign leads, too), unless it is a mark
    alone; without any the whole answer. Lower case comes first, so sentences are not told apart.
    """
    whole = F.lower(F.regexp_replace(X.strip(response), r"^\.+|\.+$", ""))

    def rest(line: Column, leads: list[str]) -> Column:
        found = F.array_compact(F.array(*[F.when(F.contains(line, F.lit(w)), X.strip(F.substring_index(line, w, -1))) for w in leads]))
        # the first of the shortest that isn't empty; an empty one gives way to any that follows
        step = lambda best, x: F.when((F.length(best) == 0) | (F.length(x) < F.length(best)), x).otherwise(best)
        return F.aggregate(found, F.lit("").cast("string"), step)

    def pieces(text: Column) -> Column:
        lines = F.split(text, "\n")
        kept = F.transform(lines, lambda x, i: F.when(i == F.size(lines) - 1, rest(x, [*LEADS, "="])).otherwise(rest(x, LEADS)))
        kept = F.filter(kept, lambda x: (x != "") & ~x.isin(":", ",", ".", "!", "?", ";", "'"))
        return F.when(F.size(kept) == 0, F.array(text)).otherwise(kept)

    return X.let(X.let(whole, pieces), lambda p: F.concat(p, F.flatten(F.transform(p, X.extract_numbers))))


FORM = "array<struct<text:string,number:double>>"


def normal_forms(c: Column) -> Column:
    """A number rounded to two places; else lower case, and a single character with a blank on either side in two forms."""
    bare = F.replace(X.strip(c), F.lit(","), F.lit(""))
    form = lambda t, n: F.struct(t.alias("text"), n.alias("number"))
    none, text = F.lit(None).cast("double"), F.lower(X.strip(c))
    single = F.array(form(F.concat(F.lit(" "), text), none), form(F.concat(text, F.lit(" ")), none))
    number = F.array(form(F.lit(None).cast("string"), F.bround(bare.try_cast("double"), 2)))
    return F.when(bare.rlike(NUMBER), number).when(F.length(text) == 1, single).otherwise(F.array(form(text, none)))


def open_correct(response: Column, golds: Column) -> Column:
    """A gold text contained in a piece, or a gold number among the pieces' numbers."""
    pieces = F.flatten(F.transform(open_answer(response), normal_forms))
    forms = F.flatten(F.transform(golds, normal_forms))
    return X.let(pieces, lambda ps: F.exists(forms, lambda g: F.exists(ps, lambda p: F.coalesce(F.contains(p["text"], g["text"]) | (p["number"] == g["number"]), p["number"] == g["number"], F.lit(False)))))


def choice_correct(gold: Column, predicted: Column) -> Column:
    """Whether the option is the gold one, or one of several."""
    return F.coalesce(F.array_contains(gold, predicted), F.lit(False))


def nearest_choice(text: Column, choices: Column) -> Column:
    """The choice at the smallest edit distance, the first of equal ones."""
    return F.array_min(F.transform(choices, lambda c, i: F.struct(F.levenshtein(text, c).alias("d"), i.alias("i"), c.alias("c"))))["c"]


def predicates(c: Column) -> dict[str, Column]:
    """Digit, number word, word of quantity, truth word, whole number, decimal number."""
    said = F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    low = F.transform(said, F.lower)
    has = lambda words: F.arrays_overlap(low, F.array(*[F.lit(w) for w in words]))
    return {
        "digit": c.rlike(r"\d"),
        "number_word": has(X.WORD_NUMBERS),
        "quantity_word": F.arrays_overlap(said, F.array(*[F.lit(w) for w in dict.fromkeys(QUANTITY_WORDS)])),
        "truth": F.lower(X.strip(c)).isin("yes", "no", "true", "false"),
        "whole": X.strip(c).rlike(r"^\d+$"),
        "decimal": X.strip(c).rlike(r"^\d+\.\d+$"),
    }


SEGMENT = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def segments(c: Column) -> Column:
    """A tagged text as a list of texts and of closed image, ref, box and quad tags, in order; an unclosed tag stays text."""
    import re

    tag = re.compile(r"<(img|ref|box|quad)>(.*?)</\1>", re.S)

    @F.pandas_udf(SEGMENT)
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for m in tag.finditer(text):
                if m.start() > at:
                    out.append({"kind": "text", "value": text[at : m.start()]})
                out.append({"kind": "image" if m[1] == "img" else m[1], "value": m[2]})
                at = m.end()
            if at < len(text):
                out.append({"kind": "text", "value": text[at:]})
            return out

        return s.map(one)

    return run(c)


def joined_segments(parts: Column) -> Column:
    """The tagged text of a list; pictures are numbered."""
    pictures = F.filter(parts, lambda p: p["kind"] == "image")
    number = lambda p: F.array_position(F.transform(pictures, lambda q: q["value"]), p["value"])
    one = lambda p: (
        F.when(p["kind"] == "text", p["value"])
        .when(p["kind"] == "image", F.concat(F.lit("Picture "), number(p).cast("string"), F.lit(": <img>"), p["value"], F.lit("</img>\n")))
        .otherwise(F.concat(F.lit("<"), p["kind"], F.lit(">"), p["value"], F.lit("</"), p["kind"], F.lit(">")))
    )
    return F.array_join(F.transform(parts, one), "")


def chat_html(c: Column) -> Column:
    """Escaped text; lines between code fences in a code element."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, code = [], False
            for line in text.split("\n"):
                if line.startswith("```"):
                    code = not code
                    out.append(f'<pre><code class="language-{html.escape(line[3:].strip())}">' if code else "</code></pre>")
                else:
                    out.append(html.escape(line) + ("" if code else "<br>"))
            return "\n".join(out)

        return s.map(one)

    return run(c)


def cut_at_stop(c: Column, stops: list[str]) -> Column:
    """A generated text up to the first stop word."""
    for s in stops:
        c = F.substring_index(c, s, 1)
    return c


def first_box(c: Column) -> Column:
    """Four numbers of the first [a,b,c,d], in one or two brackets; zeros where there is none or one isn't a number."""
    parts = F.array(*[F.regexp_extract(c, r"\[*\[(.*?),(.*?),(.*?),(.*?)\]\]*", i) for i in (1, 2, 3, 4)])
    numbers = F.transform(parts, lambda x: F.when(x.rlike(NUMBER), F.trim(x).try_cast("double")))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers).otherwise(F.array(*[F.lit(0.0)] * 4))


def boxes_with_ref(parts: Column) -> Column:
    """box (four whole numbers) and ref of every box of a segmented text; the ref is what the piece just before it names."""
    at = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.when(i > 0, F.try_element_at(parts, i)).alias("before")))
    boxes = F.filter(at, lambda x: x["p"]["kind"] == "box")
    whole = lambda v: F.transform(F.split(F.regexp_replace(v, "[()]", ""), ","), lambda n: F.trim(n).try_cast("int"))
    return F.transform(boxes, lambda x: F.struct(whole(x["p"]["value"]).alias("box"), F.when(x["before"]["kind"] == "ref", X.strip(x["before"]["value"])).alias("ref")))


def latest_picture(turns: Column) -> Column:
    """The last picture of a conversation's segmented texts, from the last turn back."""
    return F.try_element_at(F.filter(F.flatten(turns), lambda p: p["kind"] == "image")["value"], F.lit(-1))


def normalised_extraction(extraction: Column, choices: Column, question_type: Column, answer_type: Column, precision: int = 2) -> Column:
    """An extracted answer in the form of its kind: a choice by letter or the nearest one, a whole or rounded number, or null."""
    text = X.strip(F.coalesce(extraction, F.lit("None")))
    letter = F.regexp_extract(text, r"\(([a-zA-Z])\)", 1)

    def chosen(t: Column) -> Column:
        at = F.when(F.length(t) == 1, F.ascii(t) - 64)
        return F.when(at.between(1, F.size(choices)), F.try_element_at(choices, at)).otherwise(nearest_choice(t, choices))

    value = F.when(extraction.rlike(NUMBER), F.trim(extraction).try_cast("double"))
    shown = F.bround(value, precision).cast("string")
    return (
        F.when(question_type == "multi_choice", X.let(F.when(letter != "", F.upper(letter)).otherwise(text), chosen))
        .when(answer_type == "integer", value.cast("long").cast("string"))
        .when(answer_type == "float", shown)
        .otherwise(extraction)
    )


def letter_options(options: Column) -> Column:
    """The two options of `(a) one (b) two`."""
    parts = F.split(options, r"\(b\)")
    return F.array(X.strip(F.replace(parts[0], F.lit("(a)"), F.lit(""))), X.strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))))


def letters(answer: Column) -> Column:
    """(a) to (d) as A to D."""
    for a, b in zip("abcd", "ABCD", strict=True):
        answer = F.replace(answer, F.lit(f"({a})"), F.lit(b))
    return answer
