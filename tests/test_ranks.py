import math
import random

import pytest
from pyspark.sql import functions as F

from boxmill.operators import ranks

SHARES = {"low": 0.0, "p05": 0.05, "q1": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}


@pytest.mark.parametrize("few, cuts", [(4096, 64), (8, 4)])
def test_equal_to_the_built_in(spark, monkeypatch, few, cuts):
    """Uniform, heavy-tailed, tied, single and empty groups, a null key and NaN; also with many rounds."""
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "CUTS", cuts)
    rnd = random.Random(11)
    rows = [("uniform", rnd.random()) for _ in range(3000)] + [("tail", rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-200, 200)) for _ in range(1500)]
    rows += [("tied", float(rnd.choice([1, 1, 1, 2, 7]))) for _ in range(2000)] + [("single", 3.5), ("empty", None), ("two", 1.0), ("two", 2.0)]
    rows += [(None, rnd.gauss(0, 1)) for _ in range(500)] + [("nan", math.nan)] * 3 + [("nan", float(k)) for k in range(40)] + [("uniform", None)] * 5
    df = spark.createDataFrame(rows, "key string, x double").repartition(5)
    got = {r.key: r for r in ranks.exact_percentiles(df, ["key"], "x", SHARES).collect()}
    want = {r.key: r for r in df.groupBy("key").agg(F.percentile("x", list(SHARES.values())).alias("q"), F.min("x").alias("min"), F.max("x").alias("max")).collect()}
    assert set(got) == set(want) - {"empty"}
    for key, r in got.items():
        for name, q in zip(SHARES, want[key].q):
            assert r[name] == pytest.approx(q, rel=1e-12, nan_ok=True), (key, name)
        assert (r.min, str(r.max)) == (want[key].min, str(want[key].max))


def test_no_rows(spark):
    assert ranks.exact_percentiles(spark.createDataFrame([], "key string, x double"), ["key"], "x", SHARES).count() == 0
