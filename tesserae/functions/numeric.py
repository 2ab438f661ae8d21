"""Numeric scalars of answer scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column) -> Column:
    """A float, or a percentage as its hundredth; null otherwise. Suffixes of other languages' number literals don't count."""
    bare = F.regexp_replace(c, "%$", "")
    value = F.when(bare.rlike(NUMBER), F.trim(bare).try_cast("double"))
    return F.when(c.endswith("%"), value / 100.0).otherwise(value)


def relaxed_correct(target: Column, pred: Column, tolerance: float = 0.05) -> Column:
    """Numbers within the tolerance of a target that isn't 0; otherwise equal texts, whatever their case."""
    t, p = number(target), number(pred)
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), F.abs(p - t) / F.abs(t) <= tolerance).otherwise(F.lower(pred) == F.lower(target))


def leave_one_out(matches: Column, n: Column) -> Column:
    """Mean over n annotators of min(1, matches among the others / 3), with `matches` agreeing annotators."""
    m, k = matches.cast("double"), n.cast("double")
    return (m * F.least(F.lit(1.0), (m - 1) / 3) + (k - m) * F.least(F.lit(1.0), m / 3)) / k


def image_tokens(size: Column, patch: int = 14, ratio: float = 0.5) -> Column:
    return (F.floor(size / patch) * F.floor(size / patch) * ratio * ratio).cast("int")


def softmax_pair(negative: Column, positive: Column) -> Column:
    return F.bround(F.exp(positive) / (F.exp(negative) + F.exp(positive)), 3)


def length_normalised(logprob: Column, n: Column) -> Column:
    return logprob / F.greatest(n, F.lit(1))


def segment_centres(start: Column, frames: Column, segments: int) -> Column:
    """Frames at the beginnings of equal segments; every frame when there are fewer frames than segments."""
    step = frames.cast("double") / segments
    return F.when(frames < segments, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: (start + i).cast("int"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: (start + F.bround(step * i)).cast("int"))
    )


def middle_frames(frames: Column, wanted: int) -> Column:
    """The middle frame of each of `wanted` intervals with whole ends."""
    edge = lambda i: F.floor(frames * i / wanted)
    return F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.floor((edge(i) + F.greatest(edge(i + 1) - 1, edge(i))) / 2).cast("int"))


def frame_indices(frames: Column, wanted: int, mode: str = "middle", start: int | None = None, seed: Column | None = None) -> Column:
    """One frame of each of `wanted` intervals with whole ends: the middle one, one at a fixed place, or one by the seed.

    A shorter video has as many intervals as frames, and its last frame again for the rest.
    """
    n = F.least(F.lit(wanted), frames)
    edge = lambda i: F.floor(frames * i / n).cast("int")

    def one(i: Column) -> Column:
        low, high = edge(i), edge(i + 1) - 1
        if start is not None and mode != "rand":
            return low + start
        if mode == "rand":  # of an interval of one frame that frame
            return low + F.pmod(F.xxhash64(seed, i), F.greatest(high - low, F.lit(1))).cast("int")
        return F.floor((low + high) / 2).cast("int")

    taken = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), one)
    return F.concat(taken, F.array_repeat(F.element_at(taken, -1), F.lit(wanted) - F.size(taken)))


def frames_per_second(frames: Column, input_fps: Column, fps: float, most: int = -1) -> Column:
    """The frame in the middle of every clip of 1 / fps seconds, half-even; at most `most`."""
    delta = 1.0 / fps
    clips = F.greatest(F.ceil(frames / input_fps / delta).cast("int"), F.lit(1))
    at = F.transform(F.sequence(F.lit(0), clips - 1), lambda i: F.rint((F.lit(delta / 2) + i * delta) * input_fps).cast("int"))
    within = F.filter(at, lambda x: x < frames)
    return F.slice(within, 1, most) if most > 0 else within


def two_places(c: Column) -> Column:
    """A figure as text with two places."""
    return F.format_string("%.2f", c.cast("double"))
