"""Regions of pictures: thresholds, top masks, duplicate suppression, merging of annotations, matching, suppression of overlapping boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.geometry import clipped, iou


def above(objects: Column, threshold: float) -> Column:
    """Regions with a score strictly above the threshold."""
    return F.filter(objects, lambda o: o["score"] > threshold)


def prompt_string(objects: Column) -> Column:
    """`caption: box; ` of every region in order."""
    return F.concat(F.lit(""), F.array_join(F.transform(objects, lambda o: F.concat(o["caption"], F.lit(": "), F.lit("["), F.array_join(F.transform(o["box"], lambda x: x.cast("string")), ", "), F.lit("]; "))), ""))


def top_by_area(df: DataFrame, image: str, area: str, order: list[str], k: int) -> DataFrame:
    """The k largest of each image; of equal ones the earlier."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(image).orderBy(F.desc(area), *order))).where(F.col("rank") <= k)


def first_kept(df: DataFrame, keys: list[str], box: str, order: list[str], limit: float = 0.6) -> DataFrame:
    """Within image and caption the first box, and every later one whose overlap with the first is below the limit.

    The reference box never changes, so one window does what looks like a loop.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("first_box", F.first(box).over(w)).withColumn("at", F.row_number().over(w))
    return first.where((F.col("at") == 1) | (iou(F.col(box), F.col("first_box")) < limit)).drop("first_box")


def merge_annotations(captions: DataFrame, dense: DataFrame, segments: DataFrame, ocr: DataFrame, key: str = "img_id") -> DataFrame:
    """Four annotations by picture: captions lead, dense captions and segments must be there, text may be missing."""
    return captions.join(dense, key).join(segments, key).join(ocr, key, "left").withColumn("ocr", F.coalesce("ocr", F.lit("")))


def cells(box: Column, side: float) -> Column:
    """The cells of a grid that a box touches; boxes that overlap share one. A box that isn't one (a corner that is null or no number) touches none."""
    at = lambda x: F.floor(x / side).cast("int")
    fine = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x)) & (box[2] >= box[0]) & (box[3] >= box[1])
    across = F.transform(F.sequence(at(box[0]), at(box[2])), lambda x: F.transform(F.sequence(at(box[1]), at(box[3])), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    return F.when(fine, F.flatten(across)).otherwise(F.array().cast("array<struct<x:int,y:int>>"))


def best_match(proposals: DataFrame, truths: DataFrame, image: str, threshold: float = 0.5, side: float = 0.25) -> DataFrame:
    """For each proposal the truth of the same image with the largest overlap, the first of equal ones, or none below the threshold.

    Only boxes that share a cell of the image's grid meet, so that an image with very many boxes is no one task's work and
    no pair is made that can't overlap; `side` is about the size of the boxes.
    """
    spread = lambda df, box: df.withColumn("_c", F.explode(cells(F.col(box), side)))
    met = spread(proposals, "box").join(spread(truths, "truth_box"), [image, "_c"]).withColumn("iou", iou(F.col("box"), F.col("truth_box"), inclusive=False))
    top = met.groupBy(image, "proposal").agg(F.max(F.struct("iou", (-F.col("truth")).alias("truth"))).alias("m"))
    return proposals.select(image, "proposal").join(top, [image, "proposal"], "left").select(image, "proposal", F.round(F.coalesce("m.iou", F.lit(0.0)), 6).alias("iou"), F.when(F.col("m.iou") >= threshold, -F.col("m.truth")).alias("truth"))


def most_overlap(boxes: DataFrame, image: str, order: str, box: str, side: float = 0.25) -> DataFrame:
    """image, pairs, most: how many pairs an image's boxes make, and the largest overlap of two; of images with two and more."""
    n = boxes.groupBy(image).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    x = boxes.select(image, F.col(order).alias("_i"), F.col(box).alias("_a"), F.explode(cells(F.col(box), side)).alias("_c"))
    met = x.join(x.select(image, "_c", F.col("_i").alias("_j"), F.col("_a").alias("_b")), [image, "_c"]).where("_i < _j")
    most = met.groupBy(image).agg(F.max(iou(F.col("_a"), F.col("_b"), inclusive=False)).alias("most"))
    return n.join(most, image, "left").select(image, F.expr("n * (n - 1) div 2").alias("pairs"), F.round(F.coalesce("most", F.lit(0.0)), 6).alias("most"))


def finite(df: DataFrame, box: str, score: str, threshold: float) -> DataFrame:
    """Boxes of finite numbers with a score above the threshold."""
    fine = F.forall(box, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine & ~F.isnan(score) & (F.col(score) > threshold))


def rescale_detections(df: DataFrame, box: str, sx: Column, sy: Column, w: Column, h: Column) -> DataFrame:
    """To the output size, cut to the image, empty ones away."""
    b = F.col(box)
    out = df.withColumn(box, clipped(F.array(b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy), w, h))
    return out.where((F.col(box)[2] > F.col(box)[0]) & (F.col(box)[3] > F.col(box)[1]))


#: Groups up to this size are worked through in plain numbers; larger ones in arrays, with the same result.
SMALL = 24


def suppress(boxes: list, scores: list[float], method: str = "gaussian", sigma: float = 0.5, limit: float = 0.3, prune: float = 1e-3, small: int = SMALL) -> list[tuple[int, float]]:
    """Indices kept, in order, with their scores: the best box is kept and lowers the others by their overlap with it, again and again."""
    if len(scores) == 1:
        return [(0, scores[0])]
    return (_suppress_few if len(scores) <= small else _suppress_many)(boxes, scores, method, sigma, limit, prune)


def _suppress_few(boxes: list, scores: list[float], method: str, sigma: float, limit: float, prune: float) -> list[tuple[int, float]]:
    s = list(scores)
    left, kept = list(range(len(s))), []
    area = [(b[2] - b[0]) * (b[3] - b[1]) for b in boxes]
    while left:
        top = max(left, key=lambda i: (s[i], -i))
        kept.append((top, s[top]))
        rest = []
        t = boxes[top]
        for i in left:
            if i == top:
                continue
            b = boxes[i]
            both = max(0.0, min(t[2], b[2]) - max(t[0], b[0])) * max(0.0, min(t[3], b[3]) - max(t[1], b[1]))
            union = area[top] + area[i] - both
            o = both / union if union > 0 else 0.0
            s[i] *= math.exp(-o * o / sigma) if method == "gaussian" else (1 - o if o > limit else 1.0) if method == "linear" else float(o <= limit)
            if s[i] > prune:
                rest.append(i)
        left = rest
    return kept


def _suppress_many(boxes: list, scores: list[float], method: str, sigma: float, limit: float, prune: float) -> list[tuple[int, float]]:
    s = np.array(scores, np.float64)
    b = np.array(boxes, np.float64).reshape(len(s), 4)
    left = np.arange(len(s))
    area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    kept: list[tuple[int, float]] = []
    while len(left):
        top = left[s[left].argmax()]  # the first of equal ones
        kept.append((int(top), float(s[top])))
        left = left[left != top]
        both = np.maximum(0.0, np.minimum(b[top, 2], b[left, 2]) - np.maximum(b[top, 0], b[left, 0])) * np.maximum(0.0, np.minimum(b[top, 3], b[left, 3]) - np.maximum(b[top, 1], b[left, 1]))
        union = area[top] + area[left] - both
        o = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        s[left] *= np.exp(-o * o / sigma) if method == "gaussian" else np.where(o > limit, 1 - o, 1.0) if method == "linear" else o <= limit
        left = left[s[left] > prune]
    return kept


def class_nms(df: DataFrame, image: str, label: str, method: str = "hard", limit: float = 0.5, keep: int | None = None) -> DataFrame:
    """image, label, id, score of what suppression within image and class leaves; of every image at most the `keep` best, the first of equal ones.

    One shuffle by image and class, then the sorted rows are read as a stream: a task holds the boxes of one image and class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def close() -> None:
            for i, score in suppress([g[1] for g in group], [g[2] for g in group], method, limit=limit):
                out.append((*key, group[i][0], round(score, 6)))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], ["image", "label", "id", "score"])

        for batch in batches:
            for img, lab, i, box, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (img, lab) != key:
                    if group:
                        close()
                    key, group = (img, lab), []
                group.append((i, box, score))
            if len(out) > 10_000:
                yield taken()
        if group:
            close()
        if out:
            yield taken()

    rows = df.select(F.col(image).cast("long").alias("image"), F.col(label).alias("label"), F.col("id").cast("long").alias("id"), "box", "score")
    out = rows.repartition("image", "label").sortWithinPartitions("image", "label", "id").mapInArrow(run, "image long, label string, id long, score double")
    if keep is None:
        return out
    best = W.partitionBy("image").orderBy(F.desc("score"), "label", "id")
    return out.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep).drop("_r")
