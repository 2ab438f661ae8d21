"""Corpus n-gram score (BLEU) over blank-separated words: counts a row as expressions, sums by group, one formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import words


def grams(tokens: Column, n: int) -> Column:
    """The n-grams of a row, in order."""
    size = F.size(tokens) - (n - 1)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def clipped(pred: Column, refs: Column, n: int) -> Column:
    """How many n-grams of the prediction are in a reference, each at most as often as in the reference that has it most."""
    count = lambda a, g: F.size(F.filter(a, lambda x: x == g))
    return F.aggregate(F.array_distinct(pred), F.lit(0), lambda s, g: s + F.least(count(pred, g), F.coalesce(F.array_max(F.transform(refs, lambda r: count(grams(r, n), g))), F.lit(0))))


def bleu(df: DataFrame, pred: str, refs: str, by: str, order: int = 4) -> DataFrame:
    """by, bleu: geometric mean of the clipped shares of 1..order-grams, times the penalty for short answers."""
    tokens = df.select(by, words(F.lower(pred)).alias("p"), F.transform(refs, lambda r: words(F.lower(r))).alias("r"))
    length = F.size("p")
    nearest = F.array_min(F.transform("r", lambda r: F.struct(F.abs(F.size(r) - length).alias("d"), F.size(r).alias("n"))))["n"]
    sums = [F.sum(length).alias("c"), F.sum(nearest).alias("e")]
    for n in range(1, order + 1):
        sums += [F.sum(clipped(grams(F.col("p"), n), F.col("r"), n)).alias(f"m{n}"), F.sum(F.greatest(length - (n - 1), F.lit(0))).alias(f"t{n}")]
    g = tokens.groupBy(by).agg(*sums)
    logs = sum((F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in range(1, order + 1)), F.lit(0.0)) / order
    whole = F.least(*[F.col(f"m{n}") for n in range(1, order + 1)]) > 0
    penalty = F.when(F.col("c") >= F.col("e"), 1.0).otherwise(F.exp(1 - F.col("e") / F.col("c")))
    return g.select(by, F.round(F.when(whole, penalty * F.exp(logs)).otherwise(0.0), 6).alias("bleu"))
