"""Region and box queries on boxes derived from lineitem: the order is the image, a line a region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import geometry as G
from tesserae.operators import regions as R
from tesserae.sources.readers import table

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def lines(s: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("img"),
        F.col("l_returnflag").alias("caption"),
        ((F.lit(100) - F.round(F.col("l_discount") * 1000).cast("int")) / 100.0).alias("score"),
        F.array(x / 100, y / 100, (x + F.col("l_quantity")) / 100, (y + F.col("l_quantity")) / 100).alias("box"),
        (F.col("l_quantity") * F.col("l_linenumber")).alias("area"),
        F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)).alias("pos"),
    )


def region_threshold(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).where(F.col("score") > 0.5).groupBy("caption").agg(F.count(F.lit(1)).alias("n"))


def region_captions(s: SparkSession, d: str) -> DataFrame:
    """`caption: [box]; ` of the regions above the threshold, in order, as one string an image."""
    o = lines(s, d).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("pos", "caption", "score", F.transform("box", lambda x: F.round(x * 100).cast("int")).alias("box")))).alias("o"))
    return o.select("img", R.prompt_string(R.above(F.col("o"), 0.5)).alias("prompt"))


def region_topk_area(s: SparkSession, d: str) -> DataFrame:
    return R.top_by_area(lines(s, d), "img", "area", ["pos"], 3).select("img", "pos", "area", "rank")


def region_first_kept(s: SparkSession, d: str) -> DataFrame:
    return R.first_kept(lines(s, d).where(F.col("score") > 0.5), ["img", "caption"], "box", ["pos"]).select("img", "caption", "pos")


def iou_consecutive(s: SparkSession, d: str) -> DataFrame:
    """Overlap of every region with the one before it, with and without the edge pixel."""
    b = lines(s, d).withColumn("before", F.lag("box").over(W.partitionBy("img").orderBy("pos"))).where("before is not null")
    return b.select("img", "pos", F.round(G.iou(F.col("box"), F.col("before")), 6).alias("iou"), F.round(G.iou(F.col("box"), F.col("before"), False), 6).alias("iou_plain"))


def precision_at_half(s: SparkSession, d: str) -> DataFrame:
    b = lines(s, d).withColumn("before", F.lag("box").over(W.partitionBy("img").orderBy("pos"))).where("before is not null")
    return b.groupBy("caption").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((G.iou(F.col("box"), F.col("before"), False) >= 0.5).cast("double")), 6).alias("precision"))


def annotation_merge(s: SparkSession, d: str) -> DataFrame:
    """Captions lead; dense captions and segments must be there; text may be missing."""
    x = lines(s, d)
    joined = lambda df, name: df.groupBy("img").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "caption"))), lambda r: F.concat(r["caption"], F.lit(";"))), "").alias(name)).withColumnRenamed("img", "img_id")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("img_id"), F.col("o_orderpriority").alias("blip2cap"))
    return R.merge_annotations(o, joined(x.where("score > 0.4"), "grit"), joined(x.where("score > 0.5"), "sam_blip"), joined(x.where("score > 0.85"), "ocr"))


def caption_fusion_prompt(s: SparkSession, d: str) -> DataFrame:
    """The text clause only where there is text."""
    m = annotation_merge(s, d)
    return m.select("img_id", F.concat(F.lit("Caption: "), "blip2cap", F.lit(" Objects: "), "grit", F.when(F.col("ocr") != "", F.concat(F.lit(" Text: "), "ocr")).otherwise("")).alias("prompt"))


def region_best_match(s: SparkSession, d: str) -> DataFrame:
    """Regions of flag N against those of flag R of the same image."""
    x = lines(s, d)
    truths = x.where("caption = 'R'").select("img", F.col("pos").alias("truth"), F.col("box").alias("truth_box"))
    return R.best_match(x.where("caption = 'N'").select("img", F.col("pos").alias("proposal"), "box"), truths, "img")


def detections_rescaled(s: SparkSession, d: str) -> DataFrame:
    x = R.rescale_detections(lines(s, d), "box", F.lit(640.0), F.lit(480.0), F.lit(400.0), F.lit(300.0))
    return x.groupBy("caption").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("box")[2] - F.col("box")[0]), 3).alias("width"))


def score_fusion(s: SparkSession, d: str) -> DataFrame:
    x = lines(s, d)
    return x.groupBy("caption").agg(F.round(F.avg(F.sqrt(F.col("score") * F.col("box")[2])), 6).alias("fused"), F.round(F.avg(F.sqrt(F.col("score") * F.exp(-F.col("box")[0]))), 6).alias("with_text"))


def beam_topk(s: SparkSession, d: str) -> DataFrame:
    """Beams as further detections, the best two of each image."""
    x = lines(s, d).select("img", "pos", F.posexplode(F.array(F.col("score"), F.col("score") * 0.5)).alias("beam", "fused"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("img").orderBy(F.desc("fused"), "pos", "beam"))).where("rank <= 2").select("img", "pos", "beam", "rank")


def box_formats(s: SparkSession, d: str) -> DataFrame:
    """To x, y, width, height and back; rescaled to a grid; fit into a square."""
    b = F.col("box")
    x = lines(s, d).select("img", "pos", G.xyxy_to_xywh(b).alias("f"), G.rescaled(b, F.lit(640.0), F.lit(480.0)).alias("r"), G.normalised(b, F.lit(3.0), F.lit(7.0)).alias("n"))
    y = x.withColumn("g", G.xywh_to_xyxy(F.col("f")))
    return y.select("img", "pos", F.round(F.col("f")[2], 6).alias("w"), F.round(F.col("g")[3], 6).alias("y2"), F.round(F.col("r")[0], 6).alias("rx1"), F.round(F.col("r")[3], 6).alias("ry2"), F.col("n")[1].alias("ny1"))


def class_nms(s: SparkSession, d: str) -> DataFrame:
    x = lines(s, d).select("img", "caption", F.col("pos").alias("id"), "box", "score")
    return R.class_nms(x, "img", "caption")


def nms_best(s: SparkSession, d: str) -> DataFrame:
    """The two best regions of every image after suppression."""
    x = lines(s, d).select("img", "caption", F.col("pos").alias("id"), "box", "score")
    return R.class_nms(x, "img", "caption", keep=2)


def class_soft_nms(s: SparkSession, d: str) -> DataFrame:
    x = lines(s, d).select("img", "caption", F.col("pos").alias("id"), "box", "score")
    return R.class_nms(x, "img", "caption", "gaussian")


QUERIES = {f.__name__: f for f in (region_threshold, region_captions, region_topk_area, region_first_kept, iou_consecutive, precision_at_half, annotation_merge, caption_fusion_prompt, region_best_match, detections_rescaled, score_fusion, beam_topk, box_formats, class_nms, nms_best, class_soft_nms)}

_L = """lines AS (SELECT l_orderkey AS img, l_returnflag AS caption, (100 - CAST(round(l_discount * 1000) AS INT)) / 100.0 AS score, l_quantity * l_linenumber AS area,
  (l_partkey % 50) / 100.0 AS x1, (l_suppkey % 50) / 100.0 AS y1, ((l_partkey % 50) + l_quantity) / 100 AS x2, ((l_suppkey % 50) + l_quantity) / 100 AS y2,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS INT) AS pos FROM lineitem)"""


def _iou(a: str, b: str, off: str) -> str:
    w = f"greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1) + {off})"
    h = f"greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1) + {off})"
    area = lambda p: f"({p}x2 - {p}x1 + {off}) * ({p}y2 - {p}y1 + {off})"
    return f"({w} * {h} / ({area(a)} + {area(b)} - {w} * {h}))"


_LAG = "lagged AS (SELECT *, lag(x1) OVER w AS b_x1, lag(y1) OVER w AS b_y1, lag(x2) OVER w AS b_x2, lag(y2) OVER w AS b_y2 FROM lines WINDOW w AS (PARTITION BY img ORDER BY pos))"
_J = "(SELECT img, string_agg(caption || ';', '' ORDER BY pos) AS v FROM lines WHERE score > {} GROUP BY 1)"
_MERGE = f"merged AS (SELECT o_orderkey AS img_id, o_orderpriority AS blip2cap, g.v AS grit, s.v AS sam_blip, coalesce(o.v, '') AS ocr FROM orders JOIN {_J.format(0.4)} g ON g.img = o_orderkey JOIN {_J.format(0.5)} s ON s.img = o_orderkey LEFT JOIN {_J.format(0.85)} o ON o.img = o_orderkey)"

SQL = {
    "region_threshold": f"WITH {_L} SELECT caption, count(*) AS n FROM lines WHERE score > 0.5 GROUP BY 1",
    "region_captions": f"WITH {_L} SELECT img, coalesce(string_agg(caption || ': [' || CAST(round(x1 * 100) AS INT) || ', ' || CAST(round(y1 * 100) AS INT) || ', ' || CAST(round(x2 * 100) AS INT) || ', ' || CAST(round(y2 * 100) AS INT) || ']; ', '' ORDER BY pos) FILTER (score > 0.5), '') AS prompt FROM lines GROUP BY 1",
    "region_topk_area": f"WITH {_L} SELECT img, pos, area, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY img ORDER BY area DESC, pos) AS INT) AS rank FROM lines) WHERE rank <= 3",
    "region_first_kept": f"""WITH {_L}, f AS (SELECT *, first_value(x1) OVER w AS f_x1, first_value(y1) OVER w AS f_y1, first_value(x2) OVER w AS f_x2, first_value(y2) OVER w AS f_y2, row_number() OVER w AS rn FROM lines WHERE score > 0.5 WINDOW w AS (PARTITION BY img, caption ORDER BY pos))
      SELECT img, caption, pos FROM f WHERE rn = 1 OR {_iou('', 'f_', '1.0')} < 0.6""",
    "iou_consecutive": f"WITH {_L}, {_LAG} SELECT img, pos, round({_iou('', 'b_', '1.0')}, 6) AS iou, round({_iou('', 'b_', '0.0')}, 6) AS iou_plain FROM lagged WHERE b_x1 IS NOT NULL",
    "precision_at_half": f"WITH {_L}, {_LAG} SELECT caption, count(*) AS n, round(CAST(avg(CASE WHEN {_iou('', 'b_', '0.0')} >= 0.5 THEN 1.0 ELSE 0.0 END) AS DOUBLE), 6) AS precision FROM lagged WHERE b_x1 IS NOT NULL GROUP BY 1",
    "annotation_merge": f"WITH {_L}, {_MERGE} SELECT * FROM merged",
    "caption_fusion_prompt": f"WITH {_L}, {_MERGE} SELECT img_id, 'Caption: ' || blip2cap || ' Objects: ' || grit || CASE WHEN ocr <> '' THEN ' Text: ' || ocr ELSE '' END AS prompt FROM merged",
    "region_best_match": f"""WITH {_L}, m AS (SELECT p.img, p.pos AS proposal, t.pos AS truth, coalesce({_iou('p.', 't.', '0.0')}, 0.0) AS iou FROM lines p LEFT JOIN lines t ON t.img = p.img AND t.caption = 'R' WHERE p.caption = 'N')
      SELECT img, proposal, round(iou, 6) AS iou, CASE WHEN iou >= 0.5 THEN truth END AS truth FROM (SELECT *, row_number() OVER (PARTITION BY img, proposal ORDER BY iou DESC, truth) AS r FROM m) WHERE r = 1""",
    "detections_rescaled": f"""WITH {_L}, c AS (SELECT caption, least(x1 * 640, 400) AS a, least(y1 * 480, 300) AS b, least(x2 * 640, 400) AS c, least(y2 * 480, 300) AS d FROM lines)
      SELECT caption, count(*) AS n, round(sum(c - a), 3) AS width FROM c WHERE c > a AND d > b GROUP BY 1""",
    "score_fusion": f"WITH {_L} SELECT caption, round(avg(sqrt(score * x2)), 6) AS fused, round(avg(sqrt(score * exp(-x1))), 6) AS with_text FROM lines GROUP BY 1",
    "beam_topk": f"""WITH {_L}, b AS (SELECT img, pos, 0 AS beam, score AS fused FROM lines UNION ALL SELECT img, pos, 1, score * 0.5 FROM lines)
      SELECT img, pos, beam, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY img ORDER BY fused DESC, pos, beam) AS INT) AS rank FROM b) WHERE rank <= 2""",
    "box_formats": f"""WITH {_L} SELECT img, pos, round(x2 - x1, 6) AS w, round(y1 + (y2 - y1), 6) AS y2, round(x1 / (CASE WHEN x1 + y1 + x2 + y2 >= 4 THEN 1000.0 ELSE 1.0 END) * 640, 6) AS rx1, round(y2 / (CASE WHEN x1 + y1 + x2 + y2 >= 4 THEN 1000.0 ELSE 1.0 END) * 480, 6) AS ry2, round_even(y1 / 7.0, 3) AS ny1 FROM lines""",
}
