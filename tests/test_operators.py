"""Operators against plain Python."""

import random

from tesserae.operators import regions as R
from tesserae.operators import sampling as S


def test_shards_cover_once_and_differ_by_one(spark):
    for n, world in ((10, 4), (17, 5), (3, 5)):
        rows = S.contiguous_shards(spark.range(n), ["id"], world).collect()
        sizes = {}
        for r in rows:
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
        assert sorted(r["id"] for r in rows) == list(range(n))
        assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(sizes.values()) == [1, 1, 1]


def test_ranged_numbers_every_row(spark):
    got = S.ranged(spark.range(1000).selectExpr("id * 7 % 1000 k"), ["k"]).collect()
    assert all(r["k"] == r["row"] for r in got)


def test_ranged_keeps_every_row_of_a_wide_frame(spark):
    """Under default AQE the two sides of the offsets' join were once planned apart, and rows of wide frames were lost."""
    n = 60_000
    wide = spark.range(n).selectExpr("id * 7919 % 60013 k", "repeat(cast(id as string), 60) text", "array_repeat(id, 20) more")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = S.ranged(wide, ["k"])
        assert got.count() == n
        assert got.selectExpr("count(distinct row) a", "min(row) b", "max(row) c").first().asDict() == {"a": n, "b": 0, "c": n - 1}
        shards = S.contiguous_shards(wide, ["k"], 7).groupBy("shard").count().collect()
        assert sum(r["count"] for r in shards) == n and max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1
        assert S.ranged(wide.where("false"), ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_balanced_chunks():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 99) for _ in range(64)), reverse=True)
    chunks = S.balanced(lengths, 8)
    assert all(chunks.count(c) == 8 for c in range(8))
    loads = [sum(x for x, c in zip(lengths, chunks, strict=True) if c == k) for k in range(8)]
    assert max(loads) - min(loads) < 99
    assert S.balanced([1, 2, 3], 2) == [0, 1, 0]


def test_turn_batches_lose_what_meets_a_full_bucket_out_of_turn():
    rows = [("b", 0, i) for i in range(5)] + [("a", 0, i) for i in range(2)] + [("b", 0, 9)]
    assert list(S.turn_batches(iter(rows), ["a", "b"], 2)) == [(0, "a", 0), (0, "a", 1), (1, "b", 0), (1, "b", 1)]


def test_turn_batches_take_every_data_set_that_has_rows(spark, tmp_path):
    from tesserae.plans import q_sampling

    names = [f"n{i}" for i in range(8)]
    spark.createDataFrame([(n,) for n in [*names, "n3_empty"]], "ds_name string").write.parquet(str(tmp_path / "manifest.parquet"))
    rows = [(8 * k + i, n, ["a.jpg"]) for k, n in enumerate(names * 2) for i in range(8)]
    spark.createDataFrame(rows, "row_id long, source string, image array<string>").write.parquet(str(tmp_path / "conversation.parquet"))
    got = q_sampling.turn_batches(spark, str(tmp_path)).collect()
    assert [(r["batch"], r["source"], r["row_id"]) for r in got] == [(k, n, 8 * k + i) for k, n in enumerate(names * 2) for i in range(8)]


def test_newest_first_is_the_loop(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.randint(0, 60)) for c in range(30) for t in range(rng.randint(1, 9))]
    from pyspark.sql import functions as F

    got = {(r["c"], r["t"]) for r in S.newest_first(spark.createDataFrame(rows, "c int, t int, n int"), "c", "t", F.col("n"), 100).collect()}
    want = set()
    for c in range(30):
        used = 0
        for t, n in sorted(((t, n) for k, t, n in rows if k == c), reverse=True):
            used += n
            if used >= 100:
                break
            want.add((c, t))
    assert got == want


def test_suppression():
    boxes, scores = [(0, 0, 10, 10), (1, 1, 11, 11), (20, 20, 30, 30)], [0.9, 0.8, 0.7]
    assert [i for i, _ in R.suppress(boxes, scores, "hard", limit=0.5)] == [0, 2]
    soft = dict(R.suppress(boxes, scores, "gaussian"))
    assert soft[0] == 0.9 and soft[1] < 0.8 and soft[2] == 0.7
    assert R.suppress([], [], "hard") == []


def test_suppression_is_the_same_at_every_size():
    rng = random.Random(8)
    for method in ("hard", "linear", "gaussian"):
        for n in (2, 7, 60):
            corners = [(rng.random(), rng.random()) for _ in range(n)]
            boxes = [(x, y, x + rng.random(), y + rng.random()) for x, y in corners]
            scores = [round(rng.random(), 1) for _ in range(n)]
            a, b = R.suppress(boxes, scores, method, small=0), R.suppress(boxes, scores, method, small=1000)
            assert [i for i, _ in a] == [i for i, _ in b] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(a, b, strict=True))


def test_boxes_meet_in_cells(spark):
    """Against all pairs: boxes of any size, touching ones, and ones without a match."""
    rng = random.Random(9)

    def box():
        x, y = rng.uniform(-2, 2), rng.uniform(-2, 2)
        return [x, y, x + rng.choice([0.05, 0.3, 2.0]), y + rng.choice([0.05, 0.3, 2.0])]

    p = [(i % 3, i, box()) for i in range(60)] + [(7, 99, box())]
    t = [(i % 3, i, box()) for i in range(40)]

    def iou(a, b):
        both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    got = R.best_match(spark.createDataFrame(p, "img int, proposal int, box array<double>"), spark.createDataFrame(t, "img int, truth int, truth_box array<double>"), "img", 0.2).collect()
    assert len(got) == 61
    for r in got:
        own = next(b for i, k, b in p if k == r["proposal"])
        best = max(((iou(own, b), -k) for i, k, b in t if i == r["img"]), default=(0.0, 0))
        assert abs(r["iou"] - best[0]) < 1e-6 and r["truth"] == (-best[1] if best[0] >= 0.2 else None)
    n = R.most_overlap(spark.createDataFrame(p, "img int, k int, box array<double>"), "img", "k", "box").collect()
    assert {r["img"]: r["pairs"] for r in n} == {0: 190, 1: 190, 2: 190}
    assert all(abs(r["most"] - max(iou(a, b) for i, k, a in p if i == r["img"] for j, m, b in p if j == i and k < m)) < 1e-6 for r in n)


def test_likeness_by_blocks(spark):
    import numpy as np

    from tesserae.operators.training import likeness_to_later

    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5))
    rows = [("a" if i % 3 else "b", i, [float(x) for x in v[i]]) for i in range(90)]
    got = {r["place"]: r["likeness"] for r in likeness_to_later(spark.createDataFrame(rows, "g string, place long, v array<double>"), "g", "place", "v", block=7).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for g, i, _ in rows:
        later = [float(unit[i] @ unit[j]) for h, j, _ in rows if h == g and j > i]
        assert abs(got[i] - max(later, default=-1.0)) < 1e-9
