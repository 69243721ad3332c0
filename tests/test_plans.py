"""What the plans of some queries read."""

import pytest

import __spark_entry__
from boxmill.operators import metrics
from boxmill.plans import fixture

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["detection_metrics", "match_iop", "overlaps_removed", "fp_common", "fp_only_in_one", "fp_share"])
def test_one_reading_of_the_boxes(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_pages_are_placed_over_what_was_written(spark):
    plan = __spark_entry__.queries()["fp_canvas_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "placed-" in plan


@pytest.mark.parametrize("name", ["conf_filter", "offsets", "corners_to_yolo", "overlap_remove"])
def test_tasks_that_deal_boxes_are_bounded_by_rows(spark, name, monkeypatch):
    """The number of tasks grows with the table, and not with a setting alone."""
    monkeypatch.setattr(fixture, "ROWS", 100)
    out = __spark_entry__.queries()[name](spark, SF)
    assert out.rdd.getNumPartitions() >= fixture.table(spark, SF, "lineitem").count() // 100


def test_rule_boxes_and_labels_come_from_one_reading(spark):
    """As for the models' boxes: the lines are dealt by image once, and nothing by image is shuffled again."""
    plan = __spark_entry__.queries()["species_metrics"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning(image_id") == 0


@pytest.mark.parametrize("name", ["containment_ratio", "pairwise_iou", "overlap_pairs", "fp_common_boxes", "contained_crowded"])
def test_tasks_that_join_boxes_are_bounded_by_rows(spark, name, monkeypatch):
    """Boxes that meet and boxes that go are joined in a number of tasks that grows with the table, and no join takes the session's number."""
    monkeypatch.setattr(fixture, "ROWS", 100)
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    n = fixture.tasks(spark, SF)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("cell_x" in line or name == "contained_crowded")]
    assert n > 50 and len(dealt) > 1 and all(f", {n}), " in line for line in dealt)


def test_tasks_that_fill_pages_are_bounded_by_rows(spark, monkeypatch):
    """Places and pages, not the counts by class and score, which don't grow."""
    monkeypatch.setattr(metrics, "ROWS", 10)
    plan = __spark_entry__.queries()["fp_canvas_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 2 and all(int(line.split("), REPARTITION_BY_NUM")[0].rsplit(" ", 1)[1]) > 20 for line in dealt)
