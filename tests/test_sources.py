"""Readers, sinks and the stream on small files."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources import readers as R
from tesserae.sources import sinks as K
from tesserae.streaming import scoring


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"img_id": "1", "objects": [{"caption": "c", "box": [0.0, 0.1, 0.2, 0.3], "score": 0.5}]}]))
    assert R.json_array(spark, str(tmp_path / "a.json"), R.REGIONS).first()["objects"][0]["caption"] == "c"
    (tmp_path / "t.txt").write_text("a\tb\tc\nbad\nd\te\tf\n")
    good, bad = R.headerless(spark, str(tmp_path / "t.txt"), ["x", "y", "z"])
    assert sorted(r["z"] for r in good.collect()) == ["c", "f"] and bad.count() == 1
    (tmp_path / "i").mkdir()
    for n in ("x.jpg", "y.png", "z.JPG", "n.txt"):
        (tmp_path / "i" / n).write_bytes(b"1")
    assert R.images(spark, str(tmp_path / "i")).count() == 2
    (tmp_path / "v").write_text("YQ== 0\nYmM= 1\n")
    assert [bytes(r["piece"]) for r in R.merge_ranks(spark, str(tmp_path / "v")).orderBy("rank").collect()] == [b"a", b"bc"]
    p = spark.createDataFrame([("d/x.tar.gz", "s3://b/"), ("y", "/r//")], "p string, r string")
    assert [tuple(r) for r in p.select(R.stem(F.col("p")), R.joined_path(F.col("r"), F.col("p"))).collect()] == [("x.tar", "s3://b/d/x.tar.gz"), ("y", "/r/y")]


def test_detection_records(spark):
    i = spark.createDataFrame([(1, "a"), (2, "b")], "id long, file_name string")
    a = spark.createDataFrame([(9, 1, 0, [1.0], 3), (8, 1, 1, [1.0], 3), (7, 2, 1, [1.0], 3)], "id long, image_id long, iscrowd int, bbox array<double>, category_id int")
    rows = R.detection_records(i, a).collect()
    assert len(rows) == 1 and [x["id"] for x in rows[0]["annotations"]] == [9]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int")
    assert sorted(tuple(r) for r in K.keyed_map(df, "k", "v", "o").collect()) == [(1, "b"), (2, "c")]
    path = str(tmp_path / "out")
    K.append_and_resume(spark, df.where("k = 1").dropDuplicates(["k"]), path, "k")
    K.append_and_resume(spark, df.dropDuplicates(["k"]), path, "k")
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2]
    assert K.changed(df, df).count() == 0
    K.by_shard(df, str(tmp_path / "s"), "k")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_stream_appends_once(spark, tmp_path):
    schema = T.StructType.fromDDL("pred_id long, source string, answer string, annotation array<string>")
    spark.createDataFrame([(1, "s", "ab", ["ab"]), (1, "s", "ab", ["ab"]), (2, "s", None, ["x"])], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        scoring.resume_into(scoring.scored(scoring.predictions(spark, str(tmp_path / "in"), schema)), str(tmp_path / "o"), "pred_id", str(tmp_path / f"c{_}")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert [(r["pred_id"], r["score"]) for r in rows] == [(1, 1.0)]


def test_queries_are_named_without_a_session():
    """A driver asks for the names before it has a session."""
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[-1] == "True", said.stderr[-2000:]
