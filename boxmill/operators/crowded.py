"""Greedy operators for images with any number of boxes: the image is split into the connected parts of its graph, each part is folded on its own.

Two boxes are joined in the graph if one can decide about the other: overlap over the threshold, a prediction that fits a box, area in common. A fold never lets boxes
of different parts meet, so the parts' results together are the image's. The pairs come from grid cells, the parts from union-find inside tasks and some rounds over what
is left between them; so no task gets an image, and the work is that of the pairs plus the square of each part's boxes, instead of the square of the image's.
For usual images (up to some thousands of boxes) boxmill.operators.folds does with one shuffle. box_idx has to tell an image's boxes of a kind apart; a row without an
image meets nothing and stays as it is. Pairs are joined in `tasks` tasks where that is given, otherwise in as many as the session's settings say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.functions.boxes import area, containment, corners, iou
from boxmill.operators import folds
from boxmill.operators.tiling import meeting_pairs
from boxmill.sources.shared import discarded, written

#: Side of the squares of pixels whose pairs are joined up first.
BLOCK = 4096


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list, and for each the least node of its component: edges hook larger roots to smaller ones, then all paths are halved."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image_id, node, root) for each image of each batch of edges. Batches are bounded, whatever an image holds; what they don't see of each other is left for the rounds."""
    for batch in batches:
        images = batch.column("image_id").to_numpy(zero_copy_only=False)
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ab")
        order = np.argsort(images, kind="stable")
        cuts = np.flatnonzero(np.diff(images[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows):
                nodes, roots = _least_reachable(a[rows], b[rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), images[rows[0]])), pa.array(nodes), pa.array(roots)], ["image_id", "node", "root"])


def parts(edges: DataFrame) -> DataFrame:
    """(image_id, node, part): the nodes of edges (image_id, a, b; longs, and block_x, block_y, where the edge is) with the least node that each reaches in its image.

    Nodes that several batches saw under different roots tie these roots together; rounds over such ties, which shrink by a factor each and
    are none where an image's edges were in one batch, give the roots of roots. Null ids aren't nodes; no edges give no rows.
    """
    near = edges.where("image_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").repartition("image_id", "block_x", "block_y").select(*[F.col(c).cast("long") for c in ("image_id", "a", "b")])
    local = written(near.mapInArrow(_joined_up, "image_id long, node long, root long"), "parts-local")
    # Written once: what follows reads it again.
    node = written(local.groupBy("image_id", "node").agg(F.min("root").alias("part"), F.max("root").alias("most")), "parts-node")
    torn = node.where("part < most").drop("most")
    node = node.drop("most")
    ties = local.join(torn, ["image_id", "node"]).select("image_id", F.col("part").alias("a"), F.col("root").alias("b")).where("a < b").distinct()
    ties, found = written(ties, "parts-ties"), None
    while not ties.isEmpty():
        both = ties.select("image_id", F.col("a").alias("root"), F.col("b").alias("other")).union(ties.select("image_id", "b", "a"))
        up = both.groupBy("image_id", "root").agg(F.min("other").alias("other")).select("image_id", "root", F.least("root", "other").alias("up"))
        once = written(up, "parts-up")
        twice = once.select("image_id", F.col("root").alias("up"), F.col("up").alias("top"))
        up = written(once.join(twice, ["image_id", "up"], "left").select("image_id", "root", F.coalesce("top", "up").alias("up")), "parts-up")
        end = lambda c: up.select("image_id", F.col("root").alias(c), F.col("up").alias(f"top_{c}"))  # noqa: B023, E731
        old = [once, ties]
        if found is None:
            found = up
        else:
            old += [found, up]
            found = written(found.join(up.toDF("image_id", "up", "top"), ["image_id", "up"], "left").select("image_id", "root", F.coalesce("top", "up").alias("up")), "parts-found")
        moved = ties.join(end("a"), ["image_id", "a"]).join(end("b"), ["image_id", "b"]).select("image_id", F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b"))
        ties = written(moved.where("a < b").distinct(), "parts-ties")
        discarded(*old)
    if found is None:
        return node
    return node.join(found.withColumnRenamed("root", "part"), ["image_id", "part"], "left").select("image_id", "node", F.coalesce("up", "part").alias("part"))


def _edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Edges of pairs from meeting_pairs(), with the block of the cell that counted them."""
    block = lambda c: F.floor(F.greatest(f"a.{c}", f"b.{c}") / BLOCK).alias(f"block_{c[0]}")
    return pairs.select(F.col("a.image_id").alias("image_id"), F.expr(a).cast("long").alias("a"), F.expr(b).cast("long").alias("b"), block("x1"), block("y1"))


def _own_pairs(boxes: DataFrame, cell: int, tasks: int | None) -> DataFrame:
    return meeting_pairs(boxes, boxes, ["image_id"], cell, tasks).where("a.box_idx < b.box_idx")


#: What rows of one part have in common after _placed().
PART = ["image_id", "part", "alone"]


def _placed(rows: DataFrame, found: DataFrame, node: str = "box_idx") -> DataFrame:
    """rows with `part` and `alone`. What nothing else decides about is a part of its own, named by its node, which is in no other part; a row without an image or a
    node is alone by a number of its own. So all rows are folded in one pass and none is worked out twice."""
    of = found.select(F.col("image_id").alias("image_"), "node", "part")
    placed = rows.join(of, (F.col("image_id") == F.col("image_")) & (F.expr(node) == F.col("node")), "left").withColumn("part", F.coalesce("part", F.expr(node)))
    return placed.withColumn("alone", F.when(F.col("image_id").isNull() | F.expr(node).isNull(), F.monotonically_increasing_id())).drop("image_", "node")


def suppress(pred: DataFrame, threshold: float, cell: int = 256, tasks: int | None = None) -> DataFrame:
    """folds.suppress() for images with any number of boxes: the same rows."""
    columns = ["image_id", "box_idx", "cls", *folds.BOX, "score"]
    pred = pred.select(*columns)
    rivals = _own_pairs(pred, cell, tasks).where(iou(corners("a."), corners("b.")) > threshold)
    placed = _placed(pred, parts(_edges(rivals, "a.box_idx", "b.box_idx")))
    held = placed.groupBy(*PART).agg(folds.gathered("pred", folds.prediction()))
    return held.select("image_id", F.explode(folds.suppressed(F.col("pred"), threshold)).alias("b")).select("image_id", *[f"b.{c}" for c in columns[1:]])


def suppress_contained(pred: DataFrame, threshold: float, cell: int = 256, tasks: int | None = None) -> DataFrame:
    """folds.suppress_contained() for images with any number of boxes: no order matters here, so the pairs alone tell what goes."""
    columns = ["image_id", "box_idx", "cls", *folds.BOX, "score"]
    pred = pred.select(*columns)
    covered = (F.col("b.score") >= F.col("a.score")) & (containment(corners("a."), corners("b.")) >= threshold)
    pairs = meeting_pairs(pred, pred, ["image_id"], cell, tasks).where("a.box_idx <> b.box_idx").where(covered)
    gone, pred = pairs.select(F.col("a.image_id").alias("image_id"), F.col("a.box_idx").alias("box_idx")), pred.where(area(corners()) != 0)
    if tasks:
        gone, pred = (rows.repartition(tasks, "image_id", "box_idx") for rows in (gone, pred))
    return pred.join(gone.distinct(), ["image_id", "box_idx"], "left_anti").select(*columns)


def match(pred: DataFrame, gt: DataFrame, fits: folds.Fits, cell: int = 256, tasks: int | None = None) -> DataFrame:
    """folds.match() for images with any number of boxes: (image_id, cls, box_idx, outcome)."""
    pred, gt = pred.select("image_id", "box_idx", "cls", *folds.BOX, "score"), gt.select("image_id", "box_idx", "cls", *folds.BOX)
    pairs = meeting_pairs(pred, gt, ["image_id"], cell, tasks).where(fits(corners("a."), corners("b."), F.col("a.cls"), F.col("b.cls")))
    # Predictions are the even nodes, boxes of gt the odd ones.
    found = parts(_edges(pairs, "2 * a.box_idx", "2 * b.box_idx + 1"))
    both = pred.select("image_id", F.expr("2 * box_idx").alias("own"), folds.prediction().alias("p"))
    both = both.unionByName(gt.select("image_id", F.expr("2 * box_idx + 1").alias("own"), folds.labelled().alias("g")), allowMissingColumns=True)
    held = _placed(both, found, "own").groupBy(*PART).agg(folds.gathered("pred", F.col("p")), folds.gathered("gt", F.col("g")))
    return folds.outcomes(held, fits).select("image_id", "cls", "box_idx", "outcome")


def remove_overlaps(boxes: DataFrame, cell: int = 256, tasks: int | None = None) -> DataFrame:
    """folds.remove_overlaps() for images with any number of boxes: the same rows."""
    boxes = boxes.select("image_id", "box_idx", *folds.BOX)
    placed = _placed(boxes, parts(_edges(_own_pairs(boxes, cell, tasks), "a.box_idx", "b.box_idx")))
    return folds.remove_overlaps(placed, PART).drop("part", "alone")
