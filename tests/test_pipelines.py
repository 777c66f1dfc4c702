"""The chain from out-of-fold scores to rejected units, against copied rows and plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partwise.operators import classify, nested, pipelines, refit, trees
from test_nested import LIBRARY, PARTS, discriminant, features, logistic, points  # noqa: F401

LOGISTIC = {"model": "logistic", "features": ["one", "two"], "c": 1.0, "balanced": True, "shrinkage": None, "depth": None, "leaf": None, "alpha": None}
TREE = LOGISTIC | {"model": "tree", "depth": 2, "leaf": 3, "alpha": 0.005}
LDA = LOGISTIC | {"model": "lda", "shrinkage": "0.3", "balanced": False}
CONFIGS = {"logistic": LOGISTIC, "tree": TREE, "lda": LDA}


def _copies(spark, points, rep, salt="pipeline"):  # noqa: F811
    """The points of a replicate with every unit copied as often as it is drawn."""
    words = refit.drawn_words(points, salt).toPandas().sort_values("unit_id")
    n = refit.Drawn().roles(words.a_.to_numpy(), words.b_.to_numpy(), np.array([rep]))[0][:, 0].astype(int)
    plain = points.toPandas().astype({p: float for p in PARTS})
    return pd.concat([plain[plain.unit_id == u].assign(unit_id=1000 * k + u) for u, m in zip(words.unit_id, n, strict=True) for k in range(m)], ignore_index=True)


@pytest.mark.parametrize("model", ["logistic", "lda"])
def test_refitted_pipelines_equal_copied_rows(spark, points, model):  # noqa: F811
    boot = pipelines.boot_pipelines(points, PARTS, LIBRARY, CONFIGS, model, reps=30)
    assert len(boot.fits) + len(boot.failed) == 30 and len(boot.fits) > 25
    for k in list(boot.fits)[:6]:
        own = _copies(spark, points, k)
        ids = sorted(own.unit_id.unique())
        x = features(own, ids, ids)
        y = (own.drop_duplicates("unit_id").set_index("unit_id").label[ids] == "PB").to_numpy().astype(float)
        beta = (logistic if model == "logistic" else discriminant)(x, y, CONFIGS[model])
        assert np.allclose(boot.fits[k], beta, atol=1e-6)


def test_replicates_without_a_fit_are_named_and_intervals_need_enough(spark, points):  # noqa: F811
    few = points.where("unit_id < 4 or (unit_id = 5)").withColumn("label", F.when(F.col("unit_id") == 5, "PB").otherwise("K"))
    boot = pipelines.boot_pipelines(few, PARTS, LIBRARY, CONFIGS, "logistic", reps=60)
    assert "single_class" in boot.failed.values()
    told = {r["reason"]: r["n"] for r in pipelines.failures(few, boot).collect()}
    assert sum(told.values()) == 60 and told["fitted"] == len(boot.fits)
    units = few.select("unit_id").distinct()
    assert all(r["p_low"] is None and r["majority"] is None for r in pipelines.boot_score(units, few, boot, 0.5, least=60).collect())
    some = pipelines.boot_score(units, few, boot, 0.5, least=1).collect()
    assert len(some) == 5 and all(0 <= r["p_low"] <= r["p_high"] <= 1 and r["majority"] >= 0.5 for r in some)


def test_intervals_and_votes_equal_loops(spark, points):  # noqa: F811
    for model in ("logistic", "tree"):
        boot = pipelines.boot_pipelines(points, PARTS, LIBRARY, CONFIGS, model, reps=25)
        told = pipelines.boot_score(points.select("unit_id").distinct(), points, boot, 0.4, least=1).toPandas().set_index("unit_id")
        scores = []
        for k in boot.fits:
            own, plain = _copies(spark, points, k), points.toPandas().astype({p: float for p in PARTS})
            both = pd.concat([own, plain.assign(unit_id=plain.unit_id + 10**6)], ignore_index=True)
            ids = sorted(own.unit_id.unique())
            x = features(both, ids, [10**6 + u for u in sorted(plain.unit_id.unique())])
            scores.append(boot.fits[k].score(x, boot.edges) if model == "tree" else 1 / (1 + np.exp(-(x @ boot.fits[k][:-1] + boot.fits[k][-1]))))
        p = np.array(scores).T
        own = told.loc[sorted(told.index)]
        assert np.allclose(own.p_low, np.quantile(p, 0.025, axis=1), atol=1e-6)
        vote = (p >= 0.4).mean(axis=1)
        assert np.allclose(own.majority, np.maximum(vote, 1 - vote))


def test_frozen_models_score_as_they_were_fitted(spark, points, tmp_path):  # noqa: F811
    pipe = pipelines.train_final(points, PARTS, LIBRARY, CONFIGS)
    plain = points.toPandas().astype({p: float for p in PARTS})
    ids = sorted(plain.unit_id.unique())
    x = features(plain, ids, ids)
    y = (plain.drop_duplicates("unit_id").set_index("unit_id").label[ids] == "PB").to_numpy().astype(float)
    path = f"file://{tmp_path}/frozen"
    classify.freeze(spark, pipe, path)
    pipe = classify.load_frozen(spark, path)
    told = pipelines.score_units(points.withColumn("valid", F.lit(True)), pipe).toPandas().set_index("unit_id").loc[ids]
    for model, fit in (("logistic", logistic), ("lda", discriminant)):
        beta = fit(x, y, CONFIGS[model])
        assert np.allclose(told[f"p_{model}"], 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1]))), atol=1e-6)
    assert set(told.p_tree.round(9)) == {round(v, 9) for v in _leaves(pipe["models"]["tree"])}
    unseen = points.where("unit_id = 3").withColumn("state", F.lit("X")).withColumn("valid", F.lit(True))
    assert pipelines.score_units(unseen, pipe).first()["unseen_group"] == 1
    changed = spark.read.parquet(f"{path}/parameters").withColumn("value", F.when(F.col("name") == "thresholds", "{}").otherwise(F.col("value")))
    rows = changed.collect()
    spark.createDataFrame(rows, changed.schema).write.mode("overwrite").parquet(f"{path}/parameters")
    with pytest.raises(ValueError, match="changed"):
        classify.load_frozen(spark, path)


def _leaves(node):
    return [node["p"]] if "p" in node else _leaves(node["low"]) + _leaves(node["high"])


def test_chain_chooses_within_one_error(spark, points):  # noqa: F811
    chain = pipelines.choose(points, PARTS, LIBRARY, 4, 3)
    oof, metrics = chain.oof.toPandas(), chain.metrics.toPandas()
    assert len(oof) == 45 * 3 * 3 and len(metrics) == 9
    means = metrics.groupby("model").agg(ba=("balanced_accuracy", "mean"), sd=("balanced_accuracy", "std"), brier=("brier", "mean"))
    top = means.ba.idxmax()
    fine = means[(means.ba >= means.ba[top] - means.sd[top] / np.sqrt(3) - 1e-12) & (means.brier <= means.brier.min() + 0.02 + 1e-12)]
    assert chain.selected == min(fine.index, key=lambda m: (pipelines.SIMPLICITY[m], fine.brier[m]))
    for r in chain.decisions.collect():
        own = oof[oof.model == r["model"]]
        assert r["raw_threshold"] == pytest.approx(own.threshold.median())
        assert (r["slope"] is not None) == r["enabled"]
        if not r["enabled"]:
            assert r["threshold"] == r["raw_threshold"]
    for m, s in chain.configs.items():
        assert s["model"] == m and any(nested.settings(list(LIBRARY))[i] | {"features": list(s["features"])} == s for i in range(174) if list(nested.settings(list(LIBRARY))[i]["features"]) == list(s["features"]))


def test_calibration_helps_scores_that_are_too_bold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for rep in range(4):
        z = rng.normal(size=400)
        y = rng.uniform(size=400) < 1 / (1 + np.exp(-z))
        rows += [(rep, int(i), int(v), "logistic", float(1 / (1 + np.exp(-6 * s))), 0.5) for i, (s, v) in enumerate(zip(z, y, strict=True))]
    oof = spark.createDataFrame(rows, "rep int, unit_id long, y int, model string, score double, threshold double")
    told = pipelines.calibration_decisions(oof).first()
    assert told["enabled"] and told["brier_gain"] > 0.05 and told["slope"] == pytest.approx(1 / 6, abs=0.05) and abs(told["threshold"] - 0.5) < 0.05


def test_tree_is_pruned_and_scores_by_bins():
    tree = trees.Tree(False, {(): (50.0, 50.0), ((0, 0, False),): (40.0, 10.0), ((0, 0, True),): (10.0, 40.0), ((0, 0, False), (1, 1, False)): (20.0, 5.0), ((0, 0, False), (1, 1, True)): (20.0, 5.0)}, {(): (0, 0), ((0, 0, False),): (1, 1)})
    assert set(tree.pruned(4, 0.005).splits) == {()} and set(tree.pruned(1, 0.0).splits) == {()} and set(tree.pruned(4, 0.0).splits) == set(tree.splits)
    edges = np.array([[0.0, 1.0], [0.0, 1.0]])
    assert tree.score(np.array([[0.0, 5.0], [0.1, 0.0]]), edges).tolist() == [0.2, 0.8]
