"""Mixtures of all groups at once, against pyspark.ml's model from the same start."""

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler

from partwise.operators import cluster, mixture


def test_steps_equal_the_library_and_share_a_pass(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, s, (150, 3)) for c, s in ((0, 1.0), (1.5, 0.7), (3, 1.2))])
    one = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "unit_id long, a double, b double, c double").coalesce(1)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x_").transform(one)
    starts = {}
    for k in (2, 3):
        start = GaussianMixture(k=k, seed=7, featuresCol="x_", maxIter=0).fit(rows)
        starts[0, k] = np.array(start.weights), np.array([g.mean.toArray() for g in start.gaussians]), np.array([g.cov.toArray() for g in start.gaussians])
    got = mixture.fit(one.selectExpr("0 as g_", "array(a, b, c) as x"), starts)
    for k in (2, 3):
        want = GaussianMixture(k=k, seed=7, featuresCol="x_").fit(rows)
        assert np.allclose(got[0, k][0], want.weights, atol=1e-6)
        assert np.allclose(got[0, k][1], [g.mean.toArray() for g in want.gaussians], atol=1e-5)
        told = [r["prediction"] for r in want.transform(rows).orderBy("unit_id").collect()]
        assert mixture.weighted_densities(x, got[0, k]).argmax(axis=1).tolist() == told

    spark.sparkContext.setJobGroup("mixtures", "")
    both = cluster.cluster_grid(one.selectExpr("*", "if(unit_id % 2 = 0, 'x', 'y') as label"), ["a", "b", "c"], (2, 3, 4, 5), "gmm")
    assert both.count() == 4 * len(x) and both.select("label", "k", "unit_id").distinct().count() == 4 * len(x)
    steps = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixtures"))
    spark.sparkContext.setJobGroup("", "")
    assert steps < 350
