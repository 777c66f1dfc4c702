"""Scenarios of the chosen setting read the points once."""

import types

from partwise.plans import models


def test_scenarios_share_written_points(spark, monkeypatch):
    decisions = spark.createDataFrame([("logistic", 0.5)], "model string, raw_threshold double")
    monkeypatch.setattr(models, "chain_of", lambda s, d: types.SimpleNamespace(selected="logistic", configs={"logistic": {}}, decisions=decisions))
    read = []

    def fixed(df, *args, zero_c, group):
        read.append(sorted({f.rsplit("/", 2)[-2].split("-")[0] for f in df.inputFiles()}))
        return spark.createDataFrame([("logistic", 0.5, 0.25, 0)], "model string, balanced_accuracy double, brier double, failed_folds int")

    monkeypatch.setattr(models.pipelines, "fixed_cv", fixed)
    told = models.l15_sensitivity(spark, "/root/testdata/sf0.001").collect()
    assert read == [["scenarios"]] * 7 and len({r["scenario"] for r in told}) == 7
