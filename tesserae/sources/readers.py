"""Scans. Schemas are explicit: inference is unstable for the polymorphic fields of the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGION = T.StructType().add("caption", T.StringType()).add("box", T.ArrayType(T.DoubleType())).add("score", T.DoubleType())
REGIONS = T.StructType().add("img_id", T.StringType()).add("objects", T.ArrayType(REGION))
QUESTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("image", "question", "answer", "question_id")])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True).option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def headerless(spark: SparkSession, path: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tab-separated lines with as many fields as named; and the other lines."""
    lines = spark.read.text(path).withColumn("parts", F.split("value", "\t"))
    good = lines.where(F.size("parts") == len(fields)).select(*[F.col("parts")[i].alias(n) for i, n in enumerate(fields)])
    return good, lines.where(F.size("parts") != len(fields)).select("value")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Files that end in .jpg or .png, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,png}").load(folder)


def sidecars(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """JSON files with the stem of the image they belong to."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder, multiLine=True).withColumn("stem", stem(F.col("_metadata.file_name")))


def ocr_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Image bytes and the text sequence of a nested JSON ground truth."""
    return spark.read.parquet(path).select("image.bytes", F.get_json_object("ground_truth", "$.gt_parse.text_sequence").alias("text_sequence"))


def merge_ranks(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary of base64 piece and rank a line."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(F.unbase64(parts[0]).alias("piece"), parts[1].cast("int").alias("rank"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def joined_path(root: Column, path: Column) -> Column:
    """In an object store the strings one after the other, else joined by one slash."""
    return F.when(root.startswith("s3://"), F.concat(root, path)).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path))


def detection_records(images_: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their annotations that are no crowd; images without any go."""
    kept = annotations.where(F.col("iscrowd") <= 0).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", "bbox", "category_id"))).alias("annotations"))
    return images_.join(kept, images_["id"] == kept["image_id"])


def valid_polygons(polygons: Column) -> Column:
    """Polygons of an even number of at least six coordinates."""
    return F.filter(polygons, lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """A view a table."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def union_of(frames: dict[str, DataFrame]) -> DataFrame:
    """All data sets, each row with the name of its own."""
    parts = [df.withColumn("ds_name", F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
