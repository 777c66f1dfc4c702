"""Gaussian mixtures of all groups and numbers of components at once: one pass over the units a step.

Starts are those of ``pyspark.ml``'s GaussianMixture, steps and the rule to stop are its own; only sums of the size
groups x components x coordinates squared leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .resample import _matrix, _sliced, _vector, folded

EPSILON = float(np.finfo(float).eps)


def weighted_densities(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Density times weight (row, component), by the pseudo-inverse of each covariance."""
    weights, means, covs = model
    out = np.empty((len(x), len(weights)))
    for j, (w, mean, cov) in enumerate(zip(weights, means, covs, strict=True)):
        d, u = np.linalg.eigh(cov)
        used = d > EPSILON * d.max() * len(d)
        root = u[:, used] / np.sqrt(d[used])
        z = (x - mean) @ root
        out[:, j] = EPSILON + w * np.exp(-0.5 * (len(mean) * np.log(2 * np.pi) + np.log(d[used]).sum()) - 0.5 * (z * z).sum(axis=1))
    return out


def _sums(units: DataFrame, models: dict) -> dict[tuple[int, int], np.ndarray]:
    """Of each (group, k): by component weight, sum and products of the rows; the log likelihood at the end."""

    def add(batches):
        total: dict = {}
        for batch in _sliced(batches):
            x, g = _matrix(batch, "x"), _vector(batch, "g_")
            ones = {c: x[g == c] for c in np.unique(g).tolist()}
            for (c, k), model in models.items():
                own = ones.get(c)
                if own is None:
                    continue
                p = weighted_densities(own, model)
                all_ = p.sum(axis=1)
                p /= all_[:, None]
                squares = (own[:, :, None] * own[:, None, :]).reshape(len(own), -1)
                v = np.concatenate([p.sum(axis=0), (p.T @ own).ravel(), (p.T @ squares).ravel(), [np.log(all_).sum()]])
                total[c, k] = total[c, k] + v if (c, k) in total else v
        if total:
            yield pa.RecordBatch.from_pydict({n: pa.array([i[j] for i in total], pa.int32()) for j, n in enumerate(("c", "k"))} | {"x": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    return {(r["c"], r["k"]): np.frombuffer(bytes(r["x"])) for r in folded(units.select("g_", "x").mapInArrow(add, "c int, k int, x binary"), ["c", "k"]).collect()}


def fit(units: DataFrame, starts: dict, passes: int = 100, tol: float = 0.01) -> dict:
    """Weights, means and covariances by (group number, k) of ``units(g_, x)``, each until its log likelihood settles."""
    models, open_ = dict(starts), dict.fromkeys(starts, 0.0)
    for _ in range(passes):
        if not open_:
            break
        for (c, k), v in _sums(units, {key: models[key] for key in open_}).items():
            n = models[c, k][1].shape[1]
            w, first, second = v[:k], v[k : k + k * n].reshape(k, n), v[k + k * n : -1].reshape(k, n, n)
            means = first / w[:, None]
            models[c, k] = w / w.sum(), means, second / w[:, None, None] - means[:, :, None] * means[:, None, :]
            settled = abs(v[-1] - open_[c, k]) <= tol
            open_[c, k] = v[-1]
            if settled:
                del open_[c, k]
    return models


def grid(df: DataFrame, columns, ks, by: str = "label", seed: int = 7) -> DataFrame:
    """``by, k, unit_id, cluster``: the likeliest component of every unit, for each number of components in its group."""
    columns, ks = list(columns), list(ks)
    rows = materialise(df.select(by, "unit_id", *columns), "mixture")
    groups = sorted(r[0] for r in rows.select(by).distinct().collect())
    vectors = VectorAssembler(inputCols=columns, outputCol="x_").transform(rows).persist()
    starts = {}
    try:
        for c, group in enumerate(groups):
            own = vectors.where(F.col(by) == group)
            for k in ks:
                model = GaussianMixture(k=k, seed=seed, featuresCol="x_", maxIter=0).fit(own)
                starts[c, k] = np.array(model.weights), np.array([g.mean.toArray() for g in model.gaussians]), np.array([g.cov.toArray() for g in model.gaussians])
    finally:
        vectors.unpersist()
    code = (F.array_position(F.array(*map(F.lit, groups)), F.col(by)) - 1).cast("int")
    units = rows.select(by, "unit_id", code.alias("g_"), F.array(*columns).alias("x")).persist()
    try:
        models = fit(units, starts)
    finally:
        units.unpersist()

    def judge(batches):
        for batch in _sliced(batches):
            x, g = _matrix(batch, "x"), _vector(batch, "g_")
            told = np.zeros((len(x), len(ks)), np.int32)
            for c in np.unique(g).tolist():
                own = np.flatnonzero(g == c)
                for i, k in enumerate(ks):
                    told[own, i] = weighted_densities(x[own], models[c, k]).argmax(axis=1)
            for i, k in enumerate(ks):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), k, np.int32)), batch.column(1), pa.array(told[:, i])], names=[by, "k", "unit_id", "cluster"])

    kinds = dict(rows.dtypes)
    return units.mapInArrow(judge, f"{by} {kinds[by]}, k int, unit_id {kinds['unit_id']}, cluster int")
