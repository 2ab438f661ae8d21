"""Filters, lookups, validation and prompts over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.numeric import NUMBER
from tesserae.operators.sampling import ranged

IMAGE_TYPES, VIDEO_TYPES = (1, 9), (10, 12)


class InvalidSubmission(ValueError):
    """What a submission has that the questions don't, or the other way round."""


def of_type(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """image, video, all or one number."""
    c = F.col(column)
    if wanted == "all":
        return df
    if wanted in ("image", "video"):
        return df.where(c.between(*(IMAGE_TYPES if wanted == "image" else VIDEO_TYPES)))
    if wanted.isdigit():
        return df.where(c == int(wanted))
    raise ValueError(f"no such type: {wanted}")


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the ids, all of which must be there."""
    found = df.where(F.col(key).isin(ids))
    missing = set(ids) - {r[0] for r in found.select(key).distinct().collect()}
    if missing:
        raise KeyError(sorted(missing))
    return found


def validated(truth: DataFrame, submission: DataFrame, key: str, answer: str) -> DataFrame:
    """The submission joined with the questions, when its keys are theirs, each once, with a text as answer."""
    if submission.where(F.col(answer).isNull()).limit(1).count():
        raise InvalidSubmission("an answer is missing")
    both = truth.groupBy(key).agg(F.count(F.lit(1)).alias("a")).join(submission.groupBy(key).agg(F.count(F.lit(1)).alias("b")), key, "full")
    wrong = both.where(~F.col("a").eqNullSafe(F.col("b")))
    if wrong.limit(1).count():
        raise InvalidSubmission(f"keys differ: {[r[key] for r in wrong.select(key).limit(5).collect()]}")
    return truth.join(submission, key)


def options(row: list[str]) -> Column:
    """Letter and text of the options that are there, in order."""
    return F.filter(F.array(*[F.struct(F.lit(chr(65 + i)).alias("key"), F.col(c).alias("text")) for i, c in enumerate(row)]), lambda o: o["text"].isNotNull())


def flattened(df: DataFrame, column: str) -> DataFrame:
    """A struct's fields beside the row's; of equal names the struct's."""
    inner = df.schema[column].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != column and c not in inner], f"{column}.*")


def subject(identifier: Column) -> Column:
    """The parts of an id between the first and the last underscore."""
    parts = F.split(identifier, "_")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def image_number(path: Column) -> Column:
    """Digits behind the last underscore."""
    return F.regexp_extract(path, r"_(\d+)(?:\.[a-z]+)?$", 1).try_cast("long")


def flagged(tiles: Column, flags: Column) -> Column:
    """Tiles whose flag is 1."""
    return F.transform(F.filter(F.arrays_zip(tiles.alias("t"), flags.alias("f")), lambda z: z["f"] == 1), lambda z: z["t"])


def two_scales(fine: Column, coarse: Column, order: str = "fine_coarse") -> Column:
    """Tiles of both scales; the thumbnail, which is the last, stays last where asked."""
    if order == "fine_coarse":
        return F.concat(fine, coarse)
    if order == "coarse_fine":
        return F.concat(coarse, fine)
    body = lambda t: F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
    if order == "thumbnail_last":
        return F.concat(body(fine), body(coarse), F.slice(fine, F.size(fine), 1))
    raise ValueError(order)


def quarantined(df: DataFrame, good: Column, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows that fail, and the rows with a substitute for each of them: the good row at a place that the failed key's hash names."""
    bad, fine = df.where(~good), df.where(good)
    n = fine.count()
    if not n:
        return bad, fine
    placed = ranged(fine.withColumn("_h", F.xxhash64(F.lit(seed), key)), ["_h", key], "_at").drop("_h")
    wanted = bad.select(F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(n)).alias("_at"))
    return bad, fine.unionByName(placed.join(wanted, "_at").select(*df.columns))


def estimated_lengths(df: DataFrame, key: str, text: str, tokens: Column, image_tokens: int) -> DataFrame:
    """Length by the string length's first row, without the image's tokens for that row itself, as the sampler keeps it.

    The first row of every string length is aggregated before it is joined: few lengths hold most rows.
    """
    first = df.groupBy(F.length(text).alias("_l")).agg(F.min(F.struct(F.col(key).alias("k"), tokens.alias("t"))).alias("_f"))
    met = df.withColumn("_l", F.length(text)).join(first, "_l")
    return met.withColumn("estimate", F.col("_f.t") + F.when(F.col(key) == F.col("_f.k"), 0).otherwise(image_tokens)).drop("_l", "_f")


def extracted_choice(response: Column, choices: Column) -> Column:
    """The text of the choice whose letter stands in brackets; else null."""
    letter = F.upper(F.regexp_extract(response, r"\(([a-zA-Z])\)", 1))
    at = F.ascii(letter) - 64
    return F.when((letter != "") & at.between(1, F.size(choices)), F.try_element_at(choices, at))


def extracted_answer(response: Column, choices: Column, kind: Column, precision: int = 2) -> Column:
    """By rule: a choice given as it is or by letter, a number of its kind, or what `The answer is "..."` holds; else null."""
    quoted = F.regexp_extract(response, r'The answer is "(.*)"\.', 1)
    value = F.when(response.rlike(NUMBER), response.try_cast("double"))
    number = F.when(kind == "integer", value.try_cast("long").cast("string")).when(kind == "float", F.bround(value, precision).cast("string"))
    return F.coalesce(F.when(F.array_contains(choices, response), response), extracted_choice(response, choices), number, F.when(quoted != "", quoted))


def accuracy_by_keys(df: DataFrame, hit: str, keys: list[str], many: str | None = None) -> DataFrame:
    """key, value, correct, total, accuracy (percent, two places), place: over all, by every value of the keys, and by every member of the list `many`; in one pass.

    Places are within a key, from the best; equal ones by value. A null value is a value; a row counts once for each member.
    """
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    kinds = F.array(pair("average", F.lit("all")), *(pair(k, F.col(k)) for k in keys))
    if many:
        kinds = F.concat(kinds, F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda x: pair(many, x)))
    g = df.select(F.col(hit).cast("long").alias("h"), F.explode(kinds).alias("k")).groupBy("k.key", "k.value").agg(F.sum("h").alias("correct"), F.count(F.lit(1)).alias("total"))
    shown = g.withColumn("accuracy", F.round(F.col("correct") * 100.0 / F.col("total"), 2))
    return shown.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(F.desc("accuracy"), "value")))


def gains(figures: DataFrame, chance: DataFrame) -> DataFrame:
    """The figures with what they are above those of another run; null where that has none."""
    return figures.join(chance.select("key", "value", F.col("accuracy").alias("_other")), ["key", "value"], "left").withColumn("gain", F.round(F.col("accuracy") - F.col("_other"), 2)).drop("_other")


def category_names(df: DataFrame, categories: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the name of their category, slashes as blanks; categories are a table of names. Rows of none have no name."""
    return df.join(categories.select(key, F.replace(name, F.lit("/"), F.lit(" ")).alias(name)), key, "left")


def of_known_classes(df: DataFrame, column: str, classes: list[str], into: str = "class_id") -> DataFrame:
    """Rows whose class has a place in the list, with it; others are dropped."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column))
    return df.where(F.col(column).isin(classes)).withColumn(into, (at - 1).cast("int"))


def with_column_at(df: DataFrame, name: str, value: Column, place: int, without: tuple[str, ...] = ()) -> DataFrame:
    """A column put in at a fixed place, and named ones left out."""
    kept = [F.col(c) for c in df.columns if c not in without and c != name]
    return df.select(*kept[:place], value.alias(name), *kept[place:])


def joined_as_text(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join on keys of different types by what they are written as."""
    text = lambda df: df.withColumn(key, F.col(key).cast("string"))
    return text(a).join(text(b), key, how)


def zipped(frames: list[DataFrame], orders: list[list[str]], name: str = "row") -> DataFrame:
    """Rows with the same place in every frame's order, as long as the shortest."""
    out = ranged(frames[0], orders[0], name)
    for df, order in zip(frames[1:], orders[1:], strict=True):
        out = out.join(ranged(df, order, name), name)
    return out


def ratio_draws(sizes: DataFrame, name: str, draws: int, seed: int = 0) -> DataFrame:
    """draw, name, at: rows drawn with replacement so that data sets come in their ratios, whatever their sizes; `sizes` has name, n and ratio.

    A row's weight is max(n) / n * ratio / sum of ratios, so that a data set's weight is its ratio.
    """
    total = sizes.agg(F.sum("ratio").alias("_r"))
    from tesserae.operators.sampling import weighted_draws

    return weighted_draws(sizes.join(F.broadcast(total)).withColumn("weight", F.col("ratio") / F.col("_r")), name, draws, seed)


def subject_prompt(question: Column, options: Column, form: str = "{question}\n\n{options}\nAnswer with the option's letter from the given choices directly.", lead: str = "") -> Column:
    """A question with `(A) text` lines in a form, behind instructions."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), o, F.lit("\n"))), "")
    before, rest = form.split("{question}")
    between, after = rest.split("{options}")
    text = F.concat(F.lit(before), question, F.lit(between), lines, F.lit(after))
    return F.concat(F.lit(lead.strip() + "\n\n"), text) if lead else text


def extraction_prompt(demo: str, query: Column, response: Column) -> Column:
    """What an extracting model reads."""
    return F.concat(F.lit(demo.strip() + "\n\n"), query, F.lit("\n\n"), response, F.lit("\n\nExtracted answer: "))


def to_extract(df: DataFrame, extraction: str) -> DataFrame:
    """Rows whose extraction is missing or blank, to be run again."""
    return df.where(F.col(extraction).isNull() | (F.trim(extraction) == ""))


def instruction(prompts: list[str], key: Column, seed: int = 0) -> Column:
    """One of the wordings, by the key and the seed."""
    return F.element_at(F.array(*[F.lit(p) for p in prompts]), (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(prompts))) + 1).cast("int"))


def interleaved(parts: Column) -> Column:
    """A message of texts and images with numbered marks for the images."""
    images = F.transform(F.filter(F.transform(parts, lambda p, i: F.struct(p["kind"].alias("k"), i.alias("i"))), lambda x: x["k"] == "image"), lambda x: x["i"])
    return F.array_join(F.transform(parts, lambda p, i: F.when(p["kind"] == "image", F.concat(F.lit("<image-"), F.array_position(images, i).cast("string"), F.lit(">"))).otherwise(p["value"])), "\n")


def captioned(tokens: Column, begin: int, end: int, longest: int) -> Column:
    """Begin, tokens from the front, end, and which of them are to be predicted."""
    body = F.slice(tokens, 1, longest - 2)
    return F.struct(F.concat(F.array(F.lit(begin)), body, F.array(F.lit(end))).alias("tokens"), F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), F.size(body) + 1)).alias("predict"))


def affine(x: Column, y: Column, scale: Column, left: Column, top: Column) -> Column:
    """Scaled and cropped coordinates."""
    return F.array(x * scale - left, y * scale - top)


def affine_back(x: Column, y: Column, scale: Column, left: Column, top: Column) -> Column:
    return F.array((x + left) / scale, (y + top) / scale)
