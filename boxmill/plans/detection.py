"""Queries of detection: suppression, matching and the metrics that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxmill.functions.boxes import corners, iou, ratio
from boxmill.operators import crowded, folds, metrics, tiling
from boxmill.plans.fixture import DENSE, gt_boxes, images, mosaics, pred_boxes, sql, tasks
from boxmill.plans.registry import query
from boxmill.sources.shared import written

NMS_IOU, CONTAINED = 0.4, 0.5
MATCH_IOU, MATCH_COVER, RULE_COVER = 0.5, 0.9, 0.5

_INTER = "greatest(0, least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1)) * greatest(0, least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1))"
_AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_BOX = "{'box_idx': q.box_idx, 'cls': q.cls, 'x1': q.x1, 'y1': q.y1, 'x2': q.x2, 'y2': q.y2, 'score': q.score}"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_idx) AS k FROM {0})"


def _iou(a: str, b: str) -> str:
    inter = _INTER.format(a, b)
    return f"(CASE WHEN {inter} = 0 THEN 0.0 ELSE ({inter})::DOUBLE / ({_AREA.format(a)} + {_AREA.format(b)} - {inter}) END)"


def _cover(a: str, b: str) -> str:
    return f"(({_INTER.format(a, b)})::DOUBLE / ({_AREA.format(a)}))"


def _nms(source: str) -> str:
    """Common table expressions that end in nms: the kept boxes."""
    return f"""{_RANKED.format(source)}, kept AS (
  SELECT image_id, k, [{_BOX}] AS boxes FROM ranked q WHERE k = 1
  UNION ALL
  SELECT q.image_id, q.k, CASE WHEN len(list_filter(boxes, lambda b: {_iou('b', 'q')} > {NMS_IOU})) > 0 THEN boxes ELSE list_append(boxes, {_BOX}) END
  FROM kept JOIN ranked q ON q.image_id = kept.image_id AND q.k = kept.k + 1
), nms AS (
  SELECT image_id, b.box_idx, b.cls, b.x1, b.y1, b.x2, b.y2, b.score
  FROM (SELECT image_id, unnest(boxes) AS b FROM (SELECT image_id, arg_max(boxes, k) AS boxes FROM kept GROUP BY image_id))
)"""


def _contained(source: str) -> str:
    return f"""contained AS (
  SELECT * FROM {source} a WHERE NOT EXISTS (
    SELECT 1 FROM {source} b WHERE a.image_id = b.image_id AND a.box_idx <> b.box_idx AND b.score >= a.score AND {_cover('a', 'b')} >= {CONTAINED}) AND {_AREA.format('a')} <> 0
)"""


def _match(source: str, fits: str, ranked: str = "order_") -> str:
    """Common table expressions that end in outcomes."""
    return f"""{ranked} AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_idx) AS k FROM {source}),
gts AS (SELECT image_id, list({{'box_idx': box_idx, 'cls': cls, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY box_idx) AS boxes FROM gt_boxes GROUP BY image_id),
taking AS (
  SELECT q.image_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT image_id FROM {ranked}) q
  UNION ALL
  SELECT q.image_id, q.k, list_append(taken, coalesce(list_filter(coalesce(g.boxes, []), lambda h: {fits} AND NOT list_contains(taken, h.box_idx))[1].box_idx, 0))
  FROM taking t JOIN {ranked} q ON q.image_id = t.image_id AND q.k = t.k + 1 LEFT JOIN gts g ON g.image_id = q.image_id
), taken AS (SELECT image_id, arg_max(taken, k) AS taken FROM taking GROUP BY image_id
), outcomes AS (
  SELECT image_id, cls, box_idx, CASE WHEN taken[k] > 0 THEN 'TP' ELSE 'FP' END AS outcome FROM {ranked} JOIN taken USING (image_id)
  UNION ALL
  SELECT image_id, cls, box_idx, 'FN' FROM gt_boxes LEFT JOIN taken USING (image_id) WHERE NOT coalesce(list_contains(taken, box_idx), FALSE)
)"""


_FITS_MODEL = f"(q.cls = h.cls AND ({_iou('q', 'h')} >= {MATCH_IOU} OR {_cover('q', 'h')} >= {MATCH_COVER} OR {_cover('h', 'q')} >= {MATCH_COVER}))"
_FITS_RULES = f"({_cover('q', 'h')} >= {RULE_COVER})"


@query("conf_filter", f"WITH {sql()} SELECT image_id, box_idx, cls, score FROM pred_boxes WHERE score > 0.468")
def conf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred_boxes(spark, sf_dir).where("score > 0.468").select("image_id", "box_idx", "cls", "score")


@query("nms", f"WITH RECURSIVE {sql(DENSE)}, {_nms('pred_boxes')} SELECT * FROM nms")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.suppress(pred_boxes(spark, sf_dir, DENSE), NMS_IOU)


@query("nms_sparse", f"WITH RECURSIVE {sql()}, {_nms('pred_boxes')} SELECT * FROM nms")
def nms_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.suppress(pred_boxes(spark, sf_dir), NMS_IOU)


@query("containment_suppress", f"WITH {sql(DENSE)}, {_contained('pred_boxes')} SELECT * FROM contained")
def containment_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.suppress_contained(pred_boxes(spark, sf_dir, DENSE), CONTAINED)


@query("match_outcomes", f"WITH RECURSIVE {sql()}, {_match('pred_boxes', _FITS_MODEL)} SELECT * FROM outcomes")
def match_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.outcomes(images(spark, sf_dir), folds.fits_model(MATCH_IOU, MATCH_COVER)).select("image_id", "cls", "box_idx", "outcome")


@query("match_iop", f"WITH RECURSIVE {sql()}, {_match('pred_boxes', _FITS_RULES)} SELECT * FROM outcomes")
def match_iop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.outcomes(images(spark, sf_dir), folds.fits_rules(RULE_COVER)).select("image_id", "cls", "box_idx", "outcome")


#: The list that is left, walked by its first box: of what overlaps it the smaller goes, and a larger one ends its turn.
_WALKED = f"""walked AS (
  SELECT image_id, list({{'box_idx': box_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY box_idx) AS todo, CAST([] AS BIGINT[]) AS kept FROM gt_boxes GROUP BY image_id
  UNION ALL
  SELECT image_id, list_filter(rest, lambda b, i: i >= ender OR ({_INTER.format('b', 'head')}) = 0) AS todo, CASE WHEN ender > len(rest) THEN list_append(kept, head.box_idx) ELSE kept END
  FROM (
    SELECT *, coalesce(list_position(list_transform(rest, lambda b: ({_INTER.format('b', 'head')}) > 0 AND {_AREA.format('b')} > {_AREA.format('head')}), TRUE), len(rest) + 1) AS ender
    FROM (SELECT image_id, todo[1] AS head, todo[2:] AS rest, kept FROM walked WHERE len(todo) > 0)
  )
)"""


@query("overlap_remove", f"WITH RECURSIVE {sql(DENSE)}, {_WALKED} SELECT image_id, box_idx, x1, y1, x2, y2 FROM gt_boxes JOIN (SELECT image_id, unnest(kept) AS box_idx FROM walked WHERE len(todo) = 0) USING (image_id, box_idx)")
def overlap_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.remove_overlaps(gt_boxes(spark, sf_dir, DENSE))


@query("nms_crowded", f"WITH RECURSIVE {sql(DENSE, mosaic=True)}, {_nms('pred_boxes')} SELECT * FROM nms")
def nms_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression on a hundred images, whose boxes grow in number with the data."""
    return crowded.suppress(mosaics(spark, sf_dir)[0], NMS_IOU, tasks=tasks(spark, sf_dir))


@query("match_crowded", f"WITH RECURSIVE {sql(DENSE, mosaic=True)}, {_match('pred_boxes', _FITS_MODEL)} SELECT * FROM outcomes")
def match_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowded.match(*mosaics(spark, sf_dir), folds.fits_model(MATCH_IOU, MATCH_COVER), tasks=tasks(spark, sf_dir))


@query("overlap_crowded", f"WITH RECURSIVE {sql(DENSE, mosaic=True)}, {_WALKED} SELECT image_id, box_idx, x1, y1, x2, y2 FROM gt_boxes JOIN (SELECT image_id, unnest(kept) AS box_idx FROM walked WHERE len(todo) = 0) USING (image_id, box_idx)")
def overlap_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowded.remove_overlaps(mosaics(spark, sf_dir)[1], tasks=tasks(spark, sf_dir))


@query("contained_crowded", f"WITH {sql(DENSE, mosaic=True)}, {_contained('pred_boxes')} SELECT * FROM contained")
def contained_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowded.suppress_contained(mosaics(spark, sf_dir)[0], CONTAINED, tasks=tasks(spark, sf_dir))


_EVALUATED = f"{sql()}, {_nms('pred_boxes')}, {_contained('nms')}, {_match('contained', _FITS_MODEL)}"


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppress, drop contained boxes, match: three steps on one row for each image, so one reading and one shuffle by image."""
    kept = images(spark, sf_dir).withColumn("pred", folds.suppressed(F.col("pred"), NMS_IOU))
    kept = kept.withColumn("pred", folds.uncovered(F.col("pred"), CONTAINED))
    return folds.outcomes(kept, folds.fits_model(MATCH_IOU, MATCH_COVER))


def _counts(group: str) -> str:
    return f"""SELECT {group}, CAST(count(*) FILTER (WHERE outcome = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE outcome = 'FP') AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE outcome = 'FN') AS BIGINT) AS fn FROM outcomes GROUP BY"""


_SCORED = """SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 9) ELSE 0.0 END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 9) ELSE 0.0 END AS recall,
  CASE WHEN tp > 0 THEN round(2.0 * tp / (2.0::DOUBLE * tp + fp + fn), 9) ELSE 0.0 END AS f1 FROM counts"""


@query("detection_metrics", f"WITH RECURSIVE {_EVALUATED}, counts AS ({_counts('cls')} cls) {_SCORED}")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(metrics.counts(evaluated(spark, sf_dir), "cls"))


@query("metrics_rollup", f"WITH RECURSIVE {_EVALUATED}, counts AS ({_counts('coalesce(cls, -1) AS cls')} ROLLUP(outcomes.cls)) {_SCORED}")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class, and over all classes as class -1."""
    return metrics.scored(metrics.counts(evaluated(spark, sf_dir), "cls", total=-1))


@query(
    "micro_f1",
    f"WITH RECURSIVE {_EVALUATED}, counts AS (SELECT CAST(count(*) FILTER (WHERE outcome = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE outcome = 'FP') AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE outcome = 'FN') AS BIGINT) AS fn FROM outcomes WHERE cls IN (0, 1, 3)) {_SCORED}",
)
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over three classes, as the runs without the fourth are compared."""
    return metrics.scored(metrics.counts(evaluated(spark, sf_dir).where(F.col("cls").isin(0, 1, 3))))


@query("fp_budget", f"WITH RECURSIVE {_EVALUATED}, counts AS ({_counts('cls')} cls) SELECT cls, tp, fp, round(fp - tp * 0.1::DOUBLE / 0.9::DOUBLE, 6) AS surplus FROM counts")
def fp_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.surplus(metrics.counts(evaluated(spark, sf_dir), "cls"), 0.9).select("cls", "tp", "fp", F.round("surplus", 6).alias("surplus"))


#: Runs of an evaluation: the outcomes at other score thresholds, from the boxes that matching saw.
_RUNS = """runs AS (
  SELECT 'train' || (image_id % 5) AS train, 'eval' || (image_id % 3) AS eval, cls, CAST(count(*) FILTER (WHERE outcome = 'TP') AS BIGINT) AS tp,
    CAST(count(*) FILTER (WHERE outcome = 'FP') AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE outcome = 'FN') AS BIGINT) AS fn
  FROM outcomes GROUP BY ALL
), counts AS (SELECT * FROM runs)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_outcomes(spark, sf_dir)
    found = found.withColumns({"train": F.concat(F.lit("train"), F.expr("image_id % 5")), "eval": F.concat(F.lit("eval"), F.expr("image_id % 3"))})
    return metrics.scored(metrics.counts(found, "train", "eval", "cls"))


_SCORED_RUNS = f"WITH RECURSIVE {sql()}, {_match('pred_boxes', _FITS_MODEL)}, {_RUNS}, scored AS ({_SCORED})"


@query("best_run_per_class", f"{_SCORED_RUNS} SELECT cls, train, eval, f1 FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, train, eval) AS rn FROM scored) WHERE rn = 1")
def best_run_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = metrics.best(runs(spark, sf_dir), ["cls"], F.col("f1"), ["train", "eval"])
    return best.select("cls", "train", "eval", "f1")


@query(
    "best_per_metric",
    f"""{_SCORED_RUNS}, long AS (SELECT train, eval, cls, m.metric, m.value FROM scored, unnest([{{'metric': 'precision', 'value': "precision"}}, {{'metric': 'recall', 'value': recall}}, {{'metric': 'f1', 'value': f1}}]) AS x(m))
SELECT metric, cls, train, eval, value FROM (SELECT *, row_number() OVER (PARTITION BY metric, cls ORDER BY value DESC, train, eval) AS rn FROM long) WHERE rn = 1""",
)
def best_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = runs(spark, sf_dir).unpivot(["train", "eval", "cls"], ["precision", "recall", "f1"], "metric", "value")
    return metrics.best(long, ["metric", "cls"], F.col("value"), ["train", "eval"]).select("metric", "cls", "train", "eval", "value")


@query(
    "target_flags",
    f"""{_SCORED_RUNS} SELECT train, eval, cls, "precision" < 0.9 AS low_precision, recall < 0.8 AS low_recall FROM scored""",
)
def target_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("train", "eval", "cls", (F.col("precision") < 0.9).alias("low_precision"), (F.col("recall") < 0.8).alias("low_recall"))


#: False positives of two models: all predictions without a partner, and the same boxes two pixels on with other scores.
_TWO_MODELS = f"""{_match('pred_boxes', _FITS_MODEL)}, fp_a AS (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_idx) - 1 AS fp_idx, cls, score, x1, y1, x2, y2 FROM outcomes JOIN pred_boxes USING (image_id, box_idx, cls) WHERE outcome = 'FP'
), fp_b AS (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, box_idx) - 1 AS fp_idx, cls, s AS score, x1 + 2 AS x1, y1 AS y1, x2 + 2 AS x2, y2 AS y2
  FROM (SELECT *, ((1000 * score)::BIGINT * 7 % 1000) / 1000.0::DOUBLE AS s FROM outcomes JOIN pred_boxes USING (image_id, box_idx, cls) WHERE outcome = 'FP' AND box_idx % 3 <> 0)
)"""


def _two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, a, b): the false positives of two models by image, as arrays of (cls, score, x1, y1, x2, y2) in order of their places; from one evaluation, without a further shuffle."""
    fp = folds.outcomes(images(spark, sf_dir), folds.fits_model(MATCH_IOU, MATCH_COVER)).where("outcome = 'FP'")
    s = F.expr("(CAST(1000 * score AS BIGINT) * 7 % 1000) / 1000.0D")
    first = F.struct("place", "cls", "score", "x1", "y1", "x2", "y2")
    other = F.when(F.col("box_idx") % 3 != 0, F.struct((-s).alias("rank"), "box_idx", "cls", s.alias("score"), (F.col("x1") + 2).alias("x1"), "y1", (F.col("x2") + 2).alias("x2"), "y2"))
    lists = fp.groupBy("image_id").agg(folds.gathered("a", first), folds.gathered("b", other))
    bare = lambda c: F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in ("cls", "score", *folds.BOX)])).alias(c)
    return lists.select("image_id", bare("a"), bare("b"))


def _listed(models: DataFrame, which: str) -> DataFrame:
    """The rows of one model's list, with their places."""
    return models.select("image_id", F.posexplode(which).alias("fp_idx", "x")).select("image_id", F.col("fp_idx").cast("long").alias("fp_idx"), "x.*")


@query("fp_common", f"WITH RECURSIVE {sql()}, {_TWO_MODELS} SELECT a.image_id, a.fp_idx, a.score AS score_x, b.score AS score_y FROM fp_a a JOIN fp_b b ON a.image_id = b.image_id AND a.fp_idx = b.fp_idx")
def fp_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined by place in the lists, as the comparison is defined; fp_common_boxes joins by geometry."""
    both = F.filter(F.arrays_zip("a", "b"), lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    rows = _two_models(spark, sf_dir).select("image_id", F.posexplode(both).alias("fp_idx", "z"))
    return rows.select("image_id", F.col("fp_idx").cast("long").alias("fp_idx"), F.col("z.a.score").alias("score_x"), F.col("z.b.score").alias("score_y"))


@query(
    "fp_common_boxes",
    f"WITH RECURSIVE {sql()}, {_TWO_MODELS} SELECT a.image_id, a.fp_idx, b.fp_idx AS other_idx, round({_iou('a', 'b')}, 9) AS iou FROM fp_a a JOIN fp_b b ON a.image_id = b.image_id AND a.cls = b.cls WHERE {_iou('a', 'b')} >= 0.5",
)
def fp_common_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = written(_two_models(spark, sf_dir), "models")
    a, b = (_listed(models, which) for which in "ab")
    pairs = tiling.meeting_pairs(a, b, ["image_id", "cls"], tasks=tasks(spark, sf_dir)).withColumn("iou", iou(corners("a."), corners("b."))).where("iou >= 0.5")
    return pairs.select(F.col("a.image_id").alias("image_id"), F.col("a.fp_idx").alias("fp_idx"), F.col("b.fp_idx").alias("other_idx"), F.round("iou", 9).alias("iou"))


@query(
    "fp_only_in_one",
    f"""WITH RECURSIVE {sql()}, {_TWO_MODELS}
SELECT 'first' AS model, count(*) AS n FROM fp_a a WHERE NOT EXISTS (SELECT 1 FROM fp_b b WHERE a.image_id = b.image_id AND a.fp_idx = b.fp_idx)
UNION ALL SELECT 'second', count(*) FROM fp_b b WHERE NOT EXISTS (SELECT 1 FROM fp_a a WHERE a.image_id = b.image_id AND a.fp_idx = b.fp_idx)""",
)
def fp_only_in_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists are aligned by place, so what the longer one has more is in it alone."""
    more = F.size("a") - F.size("b")
    counts = _two_models(spark, sf_dir).agg(*[F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias(name) for name, n in (("first", more), ("second", -more))])
    return counts.unpivot([], ["first", "second"], "model", "n")


@query("fp_share", f"WITH RECURSIVE {sql()}, {_TWO_MODELS} SELECT cls, count(*) AS n, CAST(count(*) FILTER (WHERE score > 0.6) AS BIGINT) AS n_high, round((count(*) FILTER (WHERE score > 0.6))::DOUBLE / count(*), 9) AS share FROM fp_a GROUP BY cls")
def fp_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.count_if(F.col("score") > 0.6)
    return _listed(_two_models(spark, sf_dir), "a").groupBy("cls").agg(F.count("*").alias("n"), high.alias("n_high"), F.round(ratio(high, F.count("*")), 9).alias("share"))


@query(
    "fp_canvas_pages",
    f"""WITH RECURSIVE {sql()}, {_TWO_MODELS}, placed AS (
  SELECT image_id, fp_idx, cls, x2 - x1 AS w, y2 - y1 AS h, (rn - 1) // 100 AS page, ((rn - 1) % 100) // 10 AS prow, (rn - 1) % 10 AS pcol
  FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, image_id, fp_idx) AS rn FROM fp_a)
), cells AS (
  SELECT *, max(h) OVER (PARTITION BY cls, page, prow) AS row_height, max(w) OVER (PARTITION BY cls, page, pcol) AS col_width FROM placed
), row_sizes AS (
  SELECT cls, page, prow, coalesce(sum(hh) OVER (PARTITION BY cls, page ORDER BY prow ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y FROM (SELECT cls, page, prow, max(h) AS hh FROM placed GROUP BY ALL)
)
SELECT c.cls, c.page, c.prow, c.pcol, image_id, fp_idx, row_height, col_width, y FROM cells c JOIN row_sizes USING (cls, page, prow)""",
)
def fp_canvas_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.canvas_pages(_listed(_two_models(spark, sf_dir), "a").withColumns({"w": F.expr("x2 - x1"), "h": F.expr("y2 - y1")}))
