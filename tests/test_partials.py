"""Partial correlations: the closed form, and replicates against copied units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.operators import network as N
from partwise.operators import refit
from test_nested import PARTS, points  # noqa: F401


def _plain(x):
    """Ledoit-Wolf shrinkage and partial correlations of rows."""
    z = x - x.mean(axis=0)
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / p
    a = min(beta, delta) / delta
    inverse = np.linalg.inv((1 - a) * s + a * mu * np.eye(p))
    d = np.sqrt(np.diag(inverse))
    return -inverse / np.outer(d, d), a


def test_partials_equal_a_plain_loop(spark, points):  # noqa: F811
    centers = N.log_centers(N.fitted(points, PARTS), PARTS)
    told = N.partial_corr(centers, PARTS).toPandas()
    for label, own in centers.toPandas().groupby("label"):
        partial, a = _plain(own[[f"l_{p}" for p in PARTS]].to_numpy())
        mine = told[told.label == label].set_index(["part_j", "part_k"])
        assert mine.partial["a", "b"] == pytest.approx(partial[0, 1]) and mine.shrinkage.iloc[0] == pytest.approx(a)


def test_replicates_equal_copied_units(spark, points):  # noqa: F811
    boot = N.boot_partials(points, PARTS, 12).toPandas()
    plain = points.toPandas().astype({p: float for p in PARTS})
    for label, own in plain.groupby("label"):
        words = refit.drawn_words(points.where(F.col("label") == label), "boot").toPandas().sort_values("unit_id")
        for rep in (0, 5, 11):
            n = refit.Drawn().roles(words.a_.to_numpy(), words.b_.to_numpy(), np.array([rep]))[0][:, 0].astype(int)
            rows = [own[own.unit_id == u].assign(unit_id=1000 * k + u) for u, m in zip(words.unit_id, n, strict=True) for k in range(m)]
            import pandas as pd

            copy = pd.concat(rows, ignore_index=True)
            for p in PARTS:
                copy[p] = copy[p].fillna(copy[p].median())
            for p in PARTS:
                copy.loc[copy[p] == 0, p] = 0.5 * copy.loc[copy[p] > 0, p].min()
            logs = np.log(copy[list(PARTS)])
            x = logs.sub(logs.mean(axis=1), axis=0).groupby(copy.unit_id).mean().to_numpy()
            partial, a = _plain(x)
            mine = boot[(boot.label == label) & (boot.rep == rep)].set_index(["part_j", "part_k"])
            assert mine.partial["a", "b"] == pytest.approx(partial[0, 1], abs=1e-6) and mine.partial["b", "c"] == pytest.approx(partial[1, 2], abs=1e-6)
            assert mine.shrinkage.iloc[0] == pytest.approx(a, abs=1e-6)
