"""Folds by parts against the folds of whole images, and images too large for the latter."""

import random
import time

import numpy as np
import pytest

from boxmill.operators import crowded, folds
from tests.test_folds import GT, PRED


def boxes(rnd, n, room, images):
    out = []
    for i in images:
        for k in rnd.sample(range(10 * n), n):
            x, y = rnd.randint(-20, room), rnd.randint(-20, room)
            out.append((i, k, rnd.randrange(2), x, y, x + rnd.randint(0, 40), y + rnd.randint(0, 40)))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    """Images from crowded to sparse, one with predictions alone, one with boxes alone; half of the predictions are shifted boxes."""
    rnd = random.Random(8)
    gt = boxes(rnd, 60, 120, [1, 2]) + boxes(rnd, 80, 700, [3, 4]) + boxes(rnd, 5, 50, [6])
    shifted = [(i, k, c, *(v + rnd.randint(-3, 3) for v in b)) for i, k, c, *b in gt if i != 6 and rnd.random() < 0.7]
    extra = [(i, k + 10_000, *r) for i, k, *r in boxes(rnd, 40, 120, [1, 2]) + boxes(rnd, 40, 700, [3, 4]) + boxes(rnd, 20, 60, [5])]
    pred = [(*r, rnd.randint(0, 9) / 10) for r in shifted + extra]
    return spark.createDataFrame(pred, PRED).repartition(5), spark.createDataFrame(gt, GT).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_same_rows_as_whole_images(frames):
    pred, gt = frames
    assert rows(crowded.suppress(pred, 0.4, 64)) == rows(folds.suppress(pred, 0.4))
    assert rows(crowded.suppress_contained(pred, 0.5, 64)) == rows(folds.suppress_contained(pred, 0.5))
    for fits in (folds.fits_model(0.5, 0.9), folds.fits_rules(0.5)):
        assert rows(crowded.match(pred, gt, fits, 64)) == rows(folds.match(pred, gt, fits))
    assert rows(crowded.remove_overlaps(gt, 64)) == rows(folds.remove_overlaps(gt))


def test_empty_tables(spark):
    pred, gt = spark.createDataFrame([], PRED), spark.createDataFrame([], GT)
    assert crowded.suppress(pred, 0.4).count() == crowded.remove_overlaps(gt).count() == crowded.match(pred, gt, folds.fits_rules(0.5)).count() == 0


def test_parts_over_batches_and_rounds(spark):
    """Long chains whose edges lie in many blocks and batches."""
    rnd = random.Random(9)
    edges, want = [], {}
    for image in (1, 2):
        for chain in range(6):
            nodes = [chain * 1000 + k for k in range(200 if chain else 2)]
            rnd.shuffle(nodes)
            edges += [(image, a, b, rnd.randrange(9), 0) for a, b in zip(nodes, nodes[1:])]
            want |= {(image, n): min(nodes) for n in nodes}
    rnd.shuffle(edges)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = crowded.parts(spark.createDataFrame(edges, "image_id long, a long, b long, block_x int, block_y int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.image_id, r.node): r.part for r in got} == want and len(got) == len(want)


def plain_suppress(b, score, threshold):
    """Suppression with the boxes sorted into cells, on one machine."""
    from collections import defaultdict

    cells, kept = defaultdict(list), []
    for k in np.lexsort((np.arange(len(b)), -score)):
        x1, y1, x2, y2 = b[k]
        around = [(x, y) for x in range(x1 // 64, x2 // 64 + 1) for y in range(y1 // 64, y2 // 64 + 1)]
        for j in {j for c in around for j in cells[c]}:
            u1, v1, u2, v2 = b[j]
            both = max(0, min(x2, u2) - max(x1, u1)) * max(0, min(y2, v2) - max(y1, v1))
            if both and both / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - both) > threshold:
                break
        else:
            kept.append(int(k))
            for c in around:
                cells[c].append(k)
    return sorted(kept)


def test_one_image_of_a_hundred_thousand_boxes(spark):
    """20,000 objects with five predictions each, over which a fold of the whole image would take hours."""
    rng = np.random.default_rng(10)
    at = np.repeat(rng.integers(0, 12_000, (20_000, 2)), 5, 0) + rng.integers(-8, 9, (100_000, 2))
    b = np.concatenate([at, at + rng.integers(20, 60, (100_000, 2))], 1)
    score = rng.integers(0, 1000, 100_000) / 1000
    import pandas as pd

    frame = pd.DataFrame(b, columns=list(folds.BOX)).assign(image_id=1, box_idx=np.arange(len(b)), cls=0, score=score)
    pred = spark.createDataFrame(frame[["image_id", "box_idx", "cls", *folds.BOX, "score"]], PRED)
    began = time.time()
    got = sorted(r.box_idx for r in crowded.suppress(pred, 0.4).select("box_idx").collect())
    assert got == plain_suppress(b, score, 0.4)
    assert time.time() - began < 120


def test_rows_without_an_image_stay_and_nothing_is_worked_out_twice(spark, frames):
    pred, gt = (spark.createDataFrame([(None, 1, 0, 0, 0, 9, 9, *more), (None, 2, 0, 0, 0, 9, 9, *more), (7, 3, 0, 0, 0, 9, 9, *more)], schema) for schema, more in ((PRED, (0.5,)), (GT, ())))
    assert sorted(r.box_idx for r in crowded.suppress(pred, 0.4).collect()) == sorted(r.box_idx for r in crowded.remove_overlaps(gt).collect()) == [1, 2, 3]
    got = sorted((r.image_id or 0, r.box_idx, r.outcome) for r in crowded.match(pred, gt, folds.fits_rules(0.5)).collect())
    assert got == [(0, 1, "FN"), (0, 1, "FP"), (0, 2, "FN"), (0, 2, "FP"), (7, 3, "TP")]
    plan = crowded.match(*frames, folds.fits_rules(0.5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parts-node") == 1 and plan.count("Join") == 1
