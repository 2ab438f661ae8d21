"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import budget, encoding, mixing, overlap, packing, pairs, sentences, truncation
from tesserae.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_sequences": lambda s, d: packing.sequences(load(s, d, "conversation"), load(s, d, "pack_budget")),
        "p1_fill": lambda s, d: packing.fill_report(load(s, d, "conversation"), load(s, d, "pack_budget")),
        "p2_found": lambda s, d: overlap.found(load(s, d, "vqa_question")),
        "p2_overlap": lambda s, d: overlap.by_split_and_source(load(s, d, "vqa_question")),
        "p3_budget": lambda s, d: budget.token_budget(*(load(s, d, t) for t in ("conversation", "prediction", "vqa_question", "manifest"))),
        "p4_found": lambda s, d: truncation.found(load(s, d, "conversation"), load(s, d, "prediction")),
        "p4_share": lambda s, d: truncation.by_source(load(s, d, "conversation"), load(s, d, "prediction")),
        "p5_found": lambda s, d: pairs.found(*(load(s, d, t) for t in ("conversation", "prediction", "vqa_question"))),
        "p5_defects": lambda s, d: pairs.by_source(*(load(s, d, t) for t in ("conversation", "prediction", "vqa_question"))),
        "p6_ids": lambda s, d: encoding.encode_corpus(load(s, d, "documents")),
        "p7_mixture": lambda s, d: mixing.repeats(load(s, d, "documents"), load(s, d, "mix_target")),
        "p7_shares": lambda s, d: mixing.shares(load(s, d, "documents"), load(s, d, "mix_target")),
        "p8_found": lambda s, d: sentences.sentence_units(load(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """None: merges, fields, automata and packings are not SQL; tests/llm holds them against brute force."""
    return {}
