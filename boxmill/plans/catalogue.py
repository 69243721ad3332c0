"""Queries of cataloguing, cleaning and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxmill.operators import catalogue
from boxmill.plans.fixture import gt_boxes, sql
from boxmill.plans.fixture import table as read
from boxmill.plans.registry import query


@query("unlabeled_images", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabeled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


_SIDES = "a AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id FROM labels)"


@query(
    "pair_check",
    f"WITH {_SIDES} SELECT doc_id, 'left' AS missing FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT doc_id, 'right' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)",
)
def pair_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images (here documents; each seventh lost its file) without labels, and labels without images."""
    return catalogue.pair_check(read(spark, sf_dir, "documents").where("doc_id % 7 <> 0"), read(spark, sf_dir, "labels"), "doc_id")


@query(
    "exclude_reviewed",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)",
)
def exclude_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no exclusion list names."""
    lists = read(spark, sf_dir, "labels")
    named = lists.where("toxic = 1").select("doc_id").union(lists.where("quality = 0").select("doc_id")).distinct()
    return read(spark, sf_dir, "documents").join(named, "doc_id", "left_anti").select("doc_id", "lang")


#: Reviewed lines: every eleventh order's lines from 1 to 9, some of which don't exist.
_REVIEWED = f"{sql()}, reviewed AS (SELECT DISTINCT image_id, CAST(image_id % 60 AS BIGINT) AS box_idx FROM fx WHERE image_id % 11 = 0)"


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image_id")).distinct()
    return parts.where("image_id % 11 = 0").withColumn("box_idx", F.expr("image_id % 60"))


@query("delete_lines", f"WITH {_REVIEWED} SELECT image_id, box_idx, cls FROM gt_boxes g WHERE NOT EXISTS (SELECT 1 FROM reviewed r WHERE r.image_id = g.image_id AND r.box_idx = g.box_idx)")
def delete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt_boxes(spark, sf_dir).join(_reviewed(spark, sf_dir), ["image_id", "box_idx"], "left_anti").select("image_id", "box_idx", "cls")


@query("delete_lines_out_of_range", f"WITH {_REVIEWED} SELECT image_id, box_idx FROM reviewed r WHERE NOT EXISTS (SELECT 1 FROM gt_boxes g WHERE r.image_id = g.image_id AND r.box_idx = g.box_idx)")
def delete_lines_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).join(gt_boxes(spark, sf_dir), ["image_id", "box_idx"], "left_anti").select("image_id", "box_idx")


@query(
    "accept_fp",
    f"""WITH {sql()}, accepted AS (SELECT DISTINCT image_id, image_id % 5 AS box_idx FROM fx WHERE image_id % 3 = 0),
numbered AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_idx) - 1 AS box_idx, cls, x1, y1, x2, y2 FROM pred_boxes)
SELECT image_id, cls, x1, y1, x2, y2, 'accepted' AS origin FROM numbered SEMI JOIN accepted USING (image_id, box_idx)
UNION ALL SELECT image_id, cls, x1, y1, x2, y2, 'label' FROM gt_boxes WHERE image_id % 3 = 0""",
)
def accept_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that a review accepted, by 0-based number, beside the labels of the reviewed images; duplicates stay."""
    from boxmill.plans.fixture import pred_boxes

    pred = pred_boxes(spark, sf_dir)
    number = F.row_number().over(W.partitionBy("image_id").orderBy(F.col("score").desc(), "box_idx")).cast("long") - 1
    accepted = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image_id")).distinct().where("image_id % 3 = 0").withColumn("box_idx", F.expr("image_id % 5"))
    box = ["image_id", "cls", "x1", "y1", "x2", "y2"]
    new = pred.withColumn("box_idx", number).join(accepted, ["image_id", "box_idx"], "left_semi").select(*box, F.lit("accepted").alias("origin"))
    return new.unionByName(gt_boxes(spark, sf_dir).where("image_id % 3 = 0").select(*box, F.lit("label").alias("origin")))


@query(
    "split_copy_plan",
    """SELECT d.doc_id, 'raw/' || d.source || '/' || d.doc_id || '.jpg' AS src, CASE WHEN l.quality = 1 THEN 'train/' ELSE 'test/' END || d.source || '/' || d.doc_id || '.jpg' AS dst, l.doc_id IS NOT NULL AS has_label
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def split_copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies that realise a split, as rows; what isn't there is flagged, not dropped."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    rows = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".jpg"))
    dst = F.concat(F.when(F.col("quality") == 1, "train/").otherwise("test/"), name)
    return rows.select("doc_id", F.concat(F.lit("raw/"), name).alias("src"), dst.alias("dst"), F.col("there").isNotNull().alias("has_label"))


@query("dup_documents", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return catalogue.duplicates(docs, "doc_id", F.col("text"))


@query(
    "renumber_by_time",
    """WITH o AS (SELECT c_mktsegment, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate IS NOT NULL)
SELECT c_mktsegment, o_orderkey, CAST(n AS INTEGER) AS number, printf('%s_%04d', c_mktsegment, n) AS new_name
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) AS n FROM o)""",
)
def renumber_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return catalogue.renumber(rows, "c_mktsegment", "o_orderdate", "o_orderkey").select("c_mktsegment", "o_orderkey", "number", "new_name")


_RANK = "row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('43:' || o_orderkey), o_orderkey)"


@query("cap_per_class", f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, {_RANK} AS rn FROM orders) WHERE rn <= 200")
def cap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 200 rows of each class."""
    return catalogue.cap_per_group(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 200)


@query("test_split", f"SELECT o_orderkey, o_orderpriority, {_RANK} <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.2) AS BIGINT)) AS in_first FROM orders")
def test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.split(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.2, least=1)


@query("train_val_split", f"SELECT o_orderkey, o_orderpriority, {_RANK} <= CAST(floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.8) AS BIGINT) AS in_first FROM orders")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.split(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.8)


_QUOTAS = {"1-URGENT": 0, "2-HIGH": 160, "3-MEDIUM": 160, "5-LOW": 550}


@query(
    "quota_split",
    f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, {_RANK} AS rn FROM orders) WHERE rn <= CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _QUOTAS.items()) + " ELSE 0 END",
)
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: a quota of rows for each class."""
    return catalogue.quota_sample(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", _QUOTAS)


@query(
    "label_mismatch",
    f"""WITH {sql()}, wrong AS (SELECT image_id, box_idx, cls, (image_id // 3) % 4 AS expected FROM gt_boxes WHERE cls <> (image_id // 3) % 4)
SELECT image_id, box_idx, cls, expected FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_idx) AS rn FROM wrong) WHERE rn = 1""",
)
def label_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each file whose class isn't its folder's."""
    wrong = gt_boxes(spark, sf_dir).withColumn("expected", F.expr("(image_id DIV 3) % 4")).where("cls <> expected")
    rank = F.row_number().over(W.partitionBy("image_id").orderBy("box_idx"))
    return wrong.withColumn("rank_", rank).where("rank_ = 1").select("image_id", "box_idx", "cls", "expected")
