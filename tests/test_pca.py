"""Principal axes against numpy, and what they cost: rows are read for means and for covariances, no third time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.operators import logratio as lr


def test_axes_equal_plain_ones_in_two_passes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3)) @ np.diag([3.0, 2.0, 0.5]) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + [5.0, -7.0, 40.0]
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(8)
    told = lr.logratio_pca(df.withColumn("a", F.udf(seen, "double")("a")), ["a", "b", "c"]).collect()
    values, axes = np.linalg.eigh(np.cov(x.T))
    for k in (1, 2):
        axis = axes[:, -k] * np.sign(axes[np.abs(axes[:, -k]).argmax(), -k])
        assert [r["loading"] for r in told if r["axis"] == k] == pytest.approx(axis.tolist(), abs=1e-9)
        assert {round(r["explained"], 9) for r in told if r["axis"] == k} == {round(values[-k] / values.sum(), 9)}
    assert read.value < 2.5 * len(x)


def test_a_fit_keeps_its_group_and_parts_alone(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lr, "select", lambda df, *args, **kwargs: kept.append(df.columns) or {})
    with pytest.raises(ValueError):
        lr.fit_prep(spark.createDataFrame([("x", 1.0, 2.0, "long text")], "g string, a double, b double, other string"), ["a", "b"], "g", min_obs=2)
    assert kept == [["g", "a", "b"]] * 2
