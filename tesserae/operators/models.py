"""The surface for opaque models: batches in, columns out. The fakes are deterministic and stand in for weights in tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame


class Model(Protocol):
    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def apply(df: DataFrame, load: Callable[[], Model], schema: str) -> DataFrame:
    """A model over batches, loaded once a task; it may answer with fewer or more rows than it was given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            if len(frame):
                yield model(frame)

    return df.mapInPandas(run, schema)


def captions(df: DataFrame, load: Callable[[], Model] | None = None) -> DataFrame:
    """img_id -> img_id, caption."""
    return apply(df.select("img_id"), load or (lambda: lambda b: b.assign(caption=["a picture of " + str(crc32(str(x).encode()) % 100) for x in b["img_id"]])), "img_id string, caption string")


def regions(df: DataFrame, load: Callable[[], Model] | None = None) -> DataFrame:
    """img_id -> rows of img_id, caption, box, score."""

    def fake():
        def run(b: pd.DataFrame) -> pd.DataFrame:
            rows = [(x, f"thing {k}", [0.1 * k, 0.1, 0.1 * k + 0.2, 0.5], 1.0 / (k + 1)) for x in b["img_id"] for k in range(crc32(str(x).encode()) % 3)]
            return pd.DataFrame(rows, columns=["img_id", "caption", "box", "score"])

        return run

    return apply(df.select("img_id"), load or fake, "img_id string, caption string, box array<double>, score double")


def match_scores(df: DataFrame, load: Callable[[], Model] | None = None) -> DataFrame:
    """img_id, caption -> and the score of the match."""
    return apply(df.select("img_id", "caption"), load or (lambda: lambda b: b.assign(score=[crc32(f"{i}{c}".encode()) % 1000 / 1000 for i, c in zip(b["img_id"], b["caption"], strict=True)])), "img_id string, caption string, score double")


class Unavailable(Exception):
    """What a service raises when asking again may help."""


def answers(df: DataFrame, load: Callable[[], Model] | None = None, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """prompt and any other columns -> and answer; a batch that the service is not available for is asked again, each time after twice the wait, and then answered with null.

    Any other error is the caller's to see.
    """
    import time

    def stubborn():
        model = (load or (lambda: lambda b: b.assign(answer=["answer to " + p[:40] for p in b["prompt"]])))()

        def run(b: pd.DataFrame) -> pd.DataFrame:
            for k in range(tries):
                try:
                    return model(b)
                except Unavailable:
                    time.sleep(wait * 2**k)
            return b.assign(answer=None)

        return run

    rows = df.where("prompt is not null")
    return apply(rows, stubborn, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "answer") + ", answer string")


def masks(df: DataFrame, load: Callable[[], Model] | None = None) -> DataFrame:
    """img_id -> rows of img_id, area, bbox (left, top, width, height), predicted_iou, stability_score."""

    def fake():
        def run(b: pd.DataFrame) -> pd.DataFrame:
            rows = [(x, 100 * (k + 1), [k, k, 10 * (k + 1), 10], 0.9, 0.95) for x in b["img_id"] for k in range(crc32(str(x).encode()) % 4)]
            return pd.DataFrame(rows, columns=["img_id", "area", "bbox", "predicted_iou", "stability_score"])

        return run

    return apply(df.select("img_id"), load or fake, "img_id string, area long, bbox array<int>, predicted_iou double, stability_score double")


def text_lines(df: DataFrame, load: Callable[[], Model] | None = None) -> DataFrame:
    """img_id -> rows of img_id, line, score; a picture without lines has no row, and a line that is null is dropped."""

    def fake():
        def run(b: pd.DataFrame) -> pd.DataFrame:
            rows = [(x, f"line {k}" if k % 3 != 2 else None, 1.0 / (k + 1)) for x in b["img_id"] for k in range(crc32(str(x).encode()) % 4)]
            return pd.DataFrame(rows, columns=["img_id", "line", "score"])

        return run

    return apply(df.select("img_id"), load or fake, "img_id string, line string, score double").where("line is not null")
