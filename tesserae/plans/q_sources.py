"""Sources and sinks: what is written comes back, in every format; the tables are the driver's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import records as R
from tesserae.sources import readers, sinks
from tesserae.sources.lineage import checkpoint_folder
from tesserae.sources.readers import table


def _place(s: SparkSession) -> str:
    """A folder of its own within the shared one."""
    return f"{checkpoint_folder(s)}/exports/{uuid.uuid4().hex}"


def _nations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation")


_NATION = T.StructType().add("n_nationkey", T.IntegerType()).add("n_name", T.StringType()).add("n_regionkey", T.IntegerType())


def json_lines_back(s: SparkSession, d: str) -> DataFrame:
    """Questions as JSON lines, read with their schema."""
    at, q = _place(s), table(s, d, "vqa_question").select("record_id", "question", "answer", "lang")
    sinks.json_lines(q, at)
    return readers.json_lines(s, at, q.schema).select("record_id", "question", F.array_join("answer", "|").alias("answer"), "lang")


def json_array_back(s: SparkSession, d: str) -> DataFrame:
    """A small table as one JSON array."""
    at = _place(s)
    sinks.json_array(_nations(s, d).coalesce(1), at)
    return readers.json_array(s, at, _NATION)


def csv_back(s: SparkSession, d: str) -> DataFrame:
    """A summary with the prediction as its second column, as CSV."""
    at, x = _place(s), R.with_column_at(_nations(s, d), "prediction", F.upper("n_name"), 1)
    sinks.csv(x, at, x.columns)
    return readers.csv(s, at, T.StructType.fromDDL("n_nationkey int, prediction string, n_name string, n_regionkey int"))


def tsv_images_back(s: SparkSession, d: str) -> DataFrame:
    """Tab-separated items with a base64 column, decoded."""
    at = _place(s)
    _nations(s, d).select("n_nationkey", F.base64(F.encode("n_name", "UTF-8")).alias("image")).write.option("sep", "\t").option("header", True).csv(at)
    return readers.tsv(s, at, T.StructType.fromDDL("n_nationkey int, image string")).select("n_nationkey", F.decode(F.unbase64("image"), "UTF-8").alias("name"))


def headerless_back(s: SparkSession, d: str) -> DataFrame:
    """Lines of four fields, and the number of lines that have another one."""
    at = _place(s)
    c = table(s, d, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.lit("Yes"), F.when(F.col("c_acctbal") > 0, "Yes").otherwise("No"))).alias("value"))
    c.write.text(at)
    good, bad = readers.headerless(s, at, ["image", "question", "gt", "pred"])
    return good.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit("bad").alias("gt"), F.lit("bad").alias("pred"), F.count(F.lit(1)).alias("n")))


def ranks_back(s: SparkSession, d: str) -> DataFrame:
    """A vocabulary of base64 pieces and ranks."""
    at = _place(s)
    _nations(s, d).select(F.concat_ws(" ", F.base64(F.encode("n_name", "UTF-8")), F.col("n_nationkey").cast("string")).alias("value")).write.text(at)
    return readers.merge_ranks(s, at).select(F.decode("piece", "UTF-8").alias("piece"), "rank")


def text_sequences_back(s: SparkSession, d: str) -> DataFrame:
    """Image bytes and the text in a nested JSON ground truth, in Parquet."""
    at = _place(s)
    truth = F.to_json(F.struct(F.struct(F.col("n_name").alias("text_sequence")).alias("gt_parse")))
    _nations(s, d).select(F.struct(F.encode("n_name", "UTF-8").alias("bytes")).alias("image"), truth.alias("ground_truth")).write.parquet(at)
    return readers.ocr_parquet(s, at).select(F.length("bytes").alias("size"), "text_sequence")


def sharded_back(s: SparkSession, d: str) -> DataFrame:
    """A folder a shard; read back as one table."""
    at = _place(s)
    sinks.by_shard(table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 4).cast("int").alias("shard")), at)
    return s.read.parquet(at).select("c_custkey", F.col("shard").cast("int").alias("shard"))


def resumed(s: SparkSession, d: str) -> DataFrame:
    """A run that was broken off after a third, and the run that adds the rest."""
    at, c = _place(s), table(s, d, "customer").select("c_custkey", "c_name")
    sinks.append_and_resume(s, c.where("c_custkey % 3 = 0"), at, "c_custkey")
    sinks.append_and_resume(s, c, at, "c_custkey")
    return s.read.parquet(at)


def summaries(s: SparkSession, d: str) -> DataFrame:
    """Two summaries appended to one file."""
    at = _place(s)
    for name in ("orders", "customer"):
        sinks.append_summary(table(s, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")).coalesce(1), at)
    return s.read.schema("name string, n long").json(at)


def blanks_filled(s: SparkSession, d: str) -> DataFrame:
    """Extractions that are missing or blank are worked out again; the others stay."""
    p = table(s, d, "prediction").select("pred_id", "answer")
    old = p.select("pred_id", F.when(F.col("pred_id") % 3 == 0, F.lit(" ")).when(F.col("pred_id") % 3 == 1, F.lit("kept")).alias("answer"))
    again = R.to_extract(old, "answer").select("pred_id")
    return sinks.blanks_last(p, old, "pred_id", "answer").join(again.withColumn("again", F.lit(True)), "pred_id", "left").select("pred_id", "answer", F.coalesce("again", F.lit(False)).alias("again"))


def changed_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of a new result that the old one doesn't have."""
    old = table(s, d, "customer").select("c_custkey", "c_nationkey")
    return sinks.changed(old, old.withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_nationkey"))))


def detection_images(s: SparkSession, d: str) -> DataFrame:
    """Orders as images with their lines as annotations that are no crowd; an order without any goes."""
    i = table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    a = table(s, d, "lineitem").select(
        F.monotonically_increasing_id().alias("id"), F.col("l_orderkey").alias("image_id"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("iscrowd"), F.array("l_quantity").alias("bbox"), F.col("l_linenumber").alias("category_id")
    )
    return readers.detection_records(i, a).select("id", F.size("annotations").alias("n"), F.aggregate("annotations", F.lit(0.0), lambda x, y: x + y["bbox"][0]).alias("quantity"))


def polygons(s: SparkSession, d: str) -> DataFrame:
    """Polygons with an even number of six coordinates and more."""
    p = table(s, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.array_repeat(k, (F.col("p_size") % (k + 7)).cast("int"))).alias("g"))
    return p.select("p_partkey", F.array_join(F.transform(readers.valid_polygons(F.col("g")), lambda x: F.size(x).cast("string")), ",").alias("sizes"))


def united(s: SparkSession, d: str) -> DataFrame:
    """Tables of unlike columns as one, each row with the name of its own."""
    u = readers.union_of({"a": table(s, d, "nation").select(F.col("n_name").alias("name")), "b": table(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))})
    return u.select("ds_name", "name", "k")


def registered_views(s: SparkSession, d: str) -> DataFrame:
    readers.register(s, d, ["nation", "region"])
    return s.sql("select r_name, count(*) n from nation join region on n_regionkey = r_regionkey group by r_name")


QUERIES = {f.__name__: f for f in (json_lines_back, json_array_back, csv_back, tsv_images_back, headerless_back, ranks_back, text_sequences_back, sharded_back, resumed, summaries, blanks_filled, changed_rows, detection_images, polygons, united, registered_views)}

SQL = {
    "json_lines_back": "SELECT record_id, question, array_to_string(answer, '|') AS answer, lang FROM vqa_question",
    "json_array_back": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "csv_back": "SELECT n_nationkey, upper(n_name) AS prediction, n_name, n_regionkey FROM nation",
    "tsv_images_back": "SELECT n_nationkey, n_name AS name FROM nation",
    "headerless_back": "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'bad' ELSE 'Yes' END AS gt, CASE WHEN c_custkey % 10 = 0 THEN 'bad' WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS pred, count(*) AS n FROM customer GROUP BY 1, 2",
    "ranks_back": "SELECT n_name AS piece, n_nationkey AS rank FROM nation",
    "text_sequences_back": "SELECT CAST(length(n_name) AS INT) AS size, n_name AS text_sequence FROM nation",
    "sharded_back": "SELECT c_custkey, CAST(c_custkey % 4 AS INT) AS shard FROM customer",
    "resumed": "SELECT c_custkey, c_name FROM customer",
    "summaries": "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer",
    "blanks_filled": "SELECT pred_id, CASE WHEN pred_id % 3 = 1 THEN 'kept' ELSE answer END AS answer, pred_id % 3 <> 1 AS again FROM prediction",
    "changed_rows": "SELECT c_custkey, CAST(-1 AS INT) AS c_nationkey FROM customer WHERE c_custkey % 5 = 0 AND c_nationkey <> -1",
    "detection_images": "SELECT o_orderkey AS id, CAST(count(*) AS INT) AS n, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY 1",
    "polygons": "SELECT p_partkey, array_to_string(list_filter([p_size % 8, p_size % 9, p_size % 10], lambda x: x % 2 = 0 AND x >= 6), ',') AS sizes FROM part",
    "united": "SELECT 'a' AS ds_name, n_name AS name, CAST(NULL AS INT) AS k FROM nation UNION ALL SELECT 'b', r_name, r_regionkey FROM region",
    "registered_views": "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
}
