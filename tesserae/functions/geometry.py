"""Boxes and tile grids. A box is an array of x1, y1, x2, y2 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column, inclusive: bool = True) -> Column:
    """Intersection over union; inclusive: with the pixel of both edges counted, whatever the unit."""
    off = 1.0 if inclusive else 0.0
    low = 0.0
    w = F.greatest(F.lit(low), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + off)
    h = F.greatest(F.lit(low), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + off)
    area = lambda x: (x[2] - x[0] + off) * (x[3] - x[1] + off)
    return w * h / (area(a) + area(b) - w * h)


def xywh_to_xyxy(b: Column) -> Column:
    return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])


def xyxy_to_xywh(b: Column) -> Column:
    return F.array(b[0], b[1], b[2] - b[0], b[3] - b[1])


def quad_to_box(q: Column) -> Column:
    """Corners 0 and 2 of eight numbers."""
    return F.array(q[0], q[1], q[4], q[5])


def normalised(b: Column, w: Column, h: Column) -> Column:
    return F.array(F.bround(b[0] / w, 3), F.bround(b[1] / h, 3), F.bround(b[2] / w, 3), F.bround(b[3] / h, 3))


def rescaled(b: Column, w: Column, h: Column) -> Column:
    """From a grid of 0..1000, or of 0..1 when the sum is below 4, to pixels."""
    grid = F.when(b[0] + b[1] + b[2] + b[3] >= 4, F.lit(1000.0)).otherwise(F.lit(1.0))
    return F.array(b[0] / grid * w, b[1] / grid * h, b[2] / grid * w, b[3] / grid * h)


def clipped(b: Column, w: Column, h: Column) -> Column:
    cut = lambda x, top: F.greatest(F.lit(0.0), F.least(x, top))
    return F.array(cut(b[0], w), cut(b[1], h), cut(b[2], w), cut(b[3], h))


def grids(least: int, most: int) -> list[tuple[int, int]]:
    """Grids of columns and rows with between `least` and `most` tiles; by product, then columns."""
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most), key=lambda g: (g[0] * g[1], g[0]))


def closest_grid(w: Column, h: Column, candidates: list[tuple[int, int]], size: int = 448) -> Column:
    """The grid with the ratio nearest to the image's; of equal ones a later one only if the image has more than half its area."""
    ratio, area = w / h, w * h
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in candidates])
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(float("inf")).alias("d"))

    def fold(best: Column, g: Column) -> Column:
        d = F.abs(ratio - g["i"] / g["j"])
        take = (d < best["d"]) | ((d == best["d"]) & (area > 0.5 * size * size * g["i"] * g["j"]))
        return F.when(take, F.struct(g["i"].alias("i"), g["j"].alias("j"), d.alias("d"))).otherwise(best)

    return F.aggregate(each, start, fold, lambda b: F.struct(b["i"].alias("columns"), b["j"].alias("rows")))


def tile_boxes(columns: Column, rows: Column, size: int = 448) -> Column:
    """Row by row the boxes of the tiles."""
    return F.transform(F.sequence(F.lit(0), columns * rows - 1), lambda k: F.array((k % columns) * size, F.floor(k / columns).cast("int") * size, (k % columns + 1) * size, (F.floor(k / columns).cast("int") + 1) * size))


def with_thumbnail(boxes: Column, w: Column, h: Column) -> Column:
    """The tiles and, where there are several, the whole picture behind them."""
    return F.when(F.size(boxes) > 1, F.concat(boxes, F.array(F.array(F.lit(0), F.lit(0), w.cast("int"), h.cast("int"))))).otherwise(boxes)


def second_grid(w: Column, h: Column, first: Column, candidates: list[tuple[int, int]], both: bool = True, size: int = 448) -> Column:
    """The nearest grid that doesn't divide the first: no side of it (as in training), or not both (as in use); 1 by 1 without any."""
    ratio, area = w / h, w * h
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in candidates])
    apart = lambda g: (first["columns"] % g["i"] != 0, first["rows"] % g["j"] != 0)
    left = F.filter(each, lambda g: apart(g)[0] & apart(g)[1] if both else apart(g)[0] | apart(g)[1])
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(float("inf")).alias("d"))

    def fold(best: Column, g: Column) -> Column:
        d = F.abs(ratio - g["i"] / g["j"])
        take = (d < best["d"]) | ((d == best["d"]) & (area > 0.5 * size * size * g["i"] * g["j"]))
        return F.when(take, F.struct(g["i"].alias("i"), g["j"].alias("j"), d.alias("d"))).otherwise(best)

    return F.aggregate(left, start, fold, lambda b: F.struct(b["i"].alias("columns"), b["j"].alias("rows")))


def windows(w: Column, h: Column, size: int, step: int, partial: bool = False) -> Column:
    """Left and upper edges of sliding windows, row by row; whole ones only, or also those that the picture ends within."""
    count = lambda n: (F.ceil(n / step) if partial else F.floor((n - size) / step) + 1).cast("int")
    edges = lambda n: F.when(count(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count(n), F.lit(1)) - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(edges(h), lambda y: F.transform(edges(w), lambda x: F.struct(x.alias("left"), y.alias("top")))))


def reassembled(tiles: Column, columns: Column) -> Column:
    """Rows of tiles from a list of them, row by row."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(tiles) - 1) / columns).cast("int")), lambda r: F.slice(tiles, (r * columns + 1).cast("int"), columns))


def longest_side(b: Column, w: Column, h: Column, side: float = 720.0) -> Column:
    """A box in a picture whose longer side becomes `side`."""
    return F.transform(b, lambda x: x * side / F.greatest(w, h))


def grid_to_pixels(b: Column, w: Column, h: Column, grid: int = 1000) -> Column:
    """From a grid of 0..1000 to whole pixels, cut off."""
    return F.transform(b, lambda x, i: F.floor(x / grid * F.when(i % 2 == 0, w).otherwise(h)).cast("int"))


def fit_in_square(w: Column, h: Column, side: int) -> Column:
    """Sizes after scaling by the smaller of the two ratios, cut to whole numbers."""
    scale = F.least(F.lit(side) / w, F.lit(side) / h)
    return F.array(F.floor(w * scale).cast("int"), F.floor(h * scale).cast("int"))
