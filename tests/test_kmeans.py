"""Batched k-means against a plain loop, and the stability measures on groups that are known."""

import numpy as np
import pytest

from partwise.operators import cluster, kmeans
from partwise.operators import resample as R


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        label, n = ("K", 3) if i % 2 else ("PB", 2)
        rows.append((i, label, *map(float, rng.normal(0, 0.3, 2) + 4 * np.array([i // 2 % n, (i // 2 % n) ** 2]))))
    return spark.createDataFrame(rows, "unit_id long, label string, u double, v double").repartition(3)


def test_replicates_equal_plain_lloyd(units):
    groups, ready = cluster._units(units, ["u", "v"], "boot")
    rows = ready.toPandas()
    draw = R.Poisson(2)
    begin = kmeans.starts(ready, draw, 6, (2, 3))
    found = kmeans.fit(ready, draw, 6, (2, 3))
    for g in range(2):
        own = rows[rows.g_ == g]
        x = np.array(own.x.tolist())
        w = np.searchsorted(R.Poisson.cuts, R.drawn(own.a_.to_numpy(), own.b_.to_numpy(), np.arange(6)), "right")
        for k in (2, 3):
            for r in range(6):
                centres = begin[g, k][r].copy()
                for _ in range(12):
                    at = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
                    centres = np.array([np.average(x[at == j], axis=0, weights=w[at == j, r]) if w[at == j, r].sum() else centres[j] for j in range(k)])
                assert np.allclose(found[g, k][r], centres)


def test_true_number_of_clusters_is_stable(units):
    strength = cluster.prediction_strength(units, ["u", "v"], (2, 3), 8).groupBy("label", "k").avg("strength").collect()
    told = {(r["label"], r["k"]): r["avg(strength)"] for r in strength}
    assert told["K", 3] > 0.99 and told["PB", 2] > 0.99 and told["PB", 3] < 0.9
    runs = cluster.cluster_stability(units, ["u", "v"], (2, 3), 40).toPandas()
    assert len(runs) == 2 * 2 * 40 and (runs[(runs.label == "K") & (runs.k == 3)].ari > 0.99).mean() > 0.9
    sizes = {(r["label"], r["k"]): r["smallest"] for r in cluster.main_sizes(units, ["u", "v"], (2, 3)).collect()}
    assert sizes["PB", 2] == 60 and sizes["K", 3] == 40


def test_rand_index_of_known_tables():
    assert kmeans.rand_index(np.array([[5.0, 0], [0, 7]])) == 1 and abs(kmeans.rand_index(np.array([[2.0, 2], [2, 2]])) + 1 / 6) < 1e-12


def test_parts_stand_for_their_groups(spark):
    """a and b move together and are one group; of them the one that is measured more often stands for both."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 1))
    logs = np.hstack([x + 0.05 * rng.normal(size=(80, 1)), x + 0.05 * rng.normal(size=(80, 1)), 3 * rng.normal(size=(80, 4))])
    logs -= logs.mean(axis=1, keepdims=True)
    parts = ["a", "b", "c", "d", "e", "f"]
    centers = spark.createDataFrame([("K", i, *map(float, r)) for i, r in enumerate(logs)], "label string, unit_id int, " + ", ".join(f"l_{p} double" for p in parts))
    points = spark.createDataFrame([("K", None if i % 2 else 1.0, 1.0, 1.0, None if i % 5 == 0 else 1.0, 1.0, 1.0) for i in range(80)], "label string, a double, b double, c double, d double, e double, f double")
    told = {r["part"]: r for r in cluster.variable_selection(points, centers, parts).collect()}
    assert told["a"]["part_group"] == told["b"]["part_group"] and not told["a"]["representative"] and told["b"]["representative"]
    assert told["a"]["detection_rate"] == 0.5 and told["d"]["detection_rate"] == 0.8
    for k, p in enumerate(parts):
        assert np.isclose(told[p]["mad"], np.median(np.abs(logs[:, k] - np.median(logs[:, k]))))
