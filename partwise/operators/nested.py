"""Nested cross-validation: every fold of every repeat tunes three models on inner folds, all folds and settings at once.

The inner folds of a target fold are the other folds of its repeat, so ``fold_a`` and ``fold_b`` taken out together
serve both targets: each judges the settings of the other one; ``fold_a = fold_b`` is the outer fit.  Units stay
distributed and are copied neither by fold nor by setting (see ``refit``): a task adds up the sums of all settings for its
block of units, Spark adds the blocks, and the driver solves systems of a few numbers per fold and setting.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import trees as T
from .keys import unit_folds
from .refit import FoldsOut, Weightings, fold_words, weightings
from .resample import _matrix, _sliced, _vector

#: Inverse penalties, shrinkages and thresholds that are tried.
PENALTIES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
SHRINKAGES = ("auto", 0.1, 0.3, 0.5, 0.7, 0.9)
THRESHOLDS = np.linspace(0.2, 0.8, 61)
MODELS = ("logistic", "tree", "lda")


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def settings(features: list[str]) -> list[dict]:
    """All settings, in the order in which ties are broken: few features and moderate penalties, small trees first."""
    none = {"features": tuple(features), "c": None, "balanced": False, "shrinkage": None, "depth": None, "leaf": None, "alpha": None}
    sets = [s for n in (1, 2, 3) for s in combinations(features, n)]
    by_ease = sorted(((s, c) for s in sets for c in PENALTIES), key=lambda x: (len(x[0]), abs(np.log10(x[1]))))
    logistic = [none | {"model": "logistic", "features": s, "c": c, "balanced": w} for s, c in by_ease for w in (False, True)]
    tree = [none | {"model": "tree", "depth": d, "leaf": n, "alpha": a, "balanced": w} for d in T.DEPTHS for n in sorted(T.LEAVES, reverse=True) for a in T.ALPHAS for w in (False, True)]
    return logistic + tree + [none | {"model": "lda", "shrinkage": str(s)} for s in SHRINKAGES]


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def fit_discriminants(w: Weightings, shrinkages=SHRINKAGES) -> dict[int, np.ndarray]:
    """Coefficients by shrinkage; "auto" is the Ledoit-Wolf shrinkage of each class's standardised features."""
    ids, n_f = w.fitted(), len(w.features)
    scale = np.sqrt(np.where(np.diagonal(w.covs, axis1=2, axis2=3) > 0, np.diagonal(w.covs, axis1=2, axis2=3), 1.0))
    means = w.means

    def fourth(k, x, y, weight, role):
        return np.array([(weight[y == c] * ((((x[y == c] - means[k, c]) / scale[k, c]) ** 2).sum(axis=1) ** 2)).sum() for c in (0, 1)])

    fours = w.summed(fourth, ids) if "auto" in shrinkages else {}
    out = {}
    for k in ids.tolist():
        (n0, n1), (m0, m1), (c0, c1) = w.counts[k], w.means[k], w.covs[k]
        auto = []
        for n, cov, s, four in zip((n0, n1), (c0, c1), scale[k], fours.get(k, (0.0, 0.0)), strict=True):
            z = cov / np.outer(s, s)
            spread, mu = (z**2).sum(), np.trace(z) / n_f
            off = (spread - 2 * mu * np.trace(z) + n_f * mu**2) / n_f
            err = min((four / n - spread) / (n_f * n), off)
            a = err / off if off > 0 and err > 0 else 0.0
            auto.append(((1 - a) * z + a * mu * np.eye(n_f)) * np.outer(s, s))
        pooled = (n0 * c0 + n1 * c1) / (n0 + n1)
        betas = []
        for shrink in shrinkages:
            cov = (n0 * auto[0] + n1 * auto[1]) / (n0 + n1) if shrink == "auto" else (1 - float(shrink)) * pooled + float(shrink) * np.trace(pooled) / n_f * np.eye(n_f)
            v = np.linalg.lstsq(cov, m1 - m0, rcond=None)[0]
            betas.append(np.append(v, -v @ (m0 + m1) / 2 + np.log(n1 / n0)))
        out[k] = np.array(betas)
    return out


def fit_logistics(w: Weightings, tried: list[dict], steps: int = 60) -> tuple[dict[int, np.ndarray], set[int]]:
    """Coefficients by setting and the weightings that did not settle: Newton steps of all that still move, together.

    The first weighting settles alone; the others start from its coefficients, which are near theirs.
    """
    p = len(w.features) + 1
    mask = np.array([[f in s["features"] for f in w.features] + [True] for s in tried], float)
    ridge = np.array([[1 / s["c"]] * (p - 1) + [0.0] for s in tried])
    balanced = np.array([s["balanced"] for s in tried])
    upper = np.triu_indices(p)
    beta = {k: np.zeros((len(tried), p)) for k in w.fitted().tolist()}
    if len(beta) > 1:
        lead = min(beta)
        unsettled = _newton(w, {lead: beta[lead]}, mask, ridge, balanced, upper, steps, found := {})
        if not unsettled:
            beta = {k: found[lead].copy() for k in beta}
    unsettled = _newton(w, beta, mask, ridge, balanced, upper, steps, beta)
    return beta, unsettled


def _newton(w: Weightings, start: dict[int, np.ndarray], mask, ridge, balanced, upper, steps: int, beta: dict[int, np.ndarray]) -> set[int]:
    """Newton steps from ``start``; coefficients go to ``beta``, the weightings that still move after ``steps`` are returned."""
    beta |= start
    p = mask.shape[1]
    counts, moving = w.counts, set(start)
    for _ in range(steps):
        if not moving:
            break
        now = {k: beta[k].copy() for k in moving}

        def sums(k, x, y, weight, role, now=now):
            own = np.flatnonzero(weight)
            x, y = _with_one(x[own]), y[own]
            out = np.empty((len(balanced), p + len(upper[0])))
            pairs = x[:, upper[0]] * x[:, upper[1]]
            for kind, v in ((False, weight[own]), (True, weight[own] * (counts[k].sum() / (2 * counts[k]))[y])):
                at = balanced == kind
                mu = probability(x @ now[k][at].T)
                out[at, :p] = (y[:, None] - mu).T @ (v[:, None] * x)
                mu *= 1 - mu
                out[at, p:] = mu.T @ (v[:, None] * pairs)
            return out.ravel()

        for k, v in w.summed(sums, np.array(sorted(moving), np.int64)).items():
            v = v.reshape(len(mask), -1)
            h = np.zeros((len(mask), p, p))
            h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = v[:, p:]
            h = h * mask[:, :, None] * mask[:, None, :] + np.eye(p) * (ridge + 1e-9)[:, :, None]
            step = np.linalg.solve(h, (mask * v[:, :p] - ridge * beta[k])[:, :, None])[:, :, 0]
            step *= np.minimum(1, 5 / np.maximum(np.linalg.norm(step, axis=1), 1e-12))[:, None]
            beta[k] = beta[k] + step
            if np.abs(step).max() < 1e-7:
                moving.discard(k)
    return moving


def _recall(right, n):
    return right / n if n else np.full_like(right, np.nan, float)


def _accuracy(ones, n1, zeros, n0):
    return np.nanmean([_recall(ones, n1), _recall(zeros, n0)], axis=0)


class Tuned:
    """What all folds learned: ``accuracy`` by (rep, target) and setting, and the chosen models with their thresholds.

    ``chosen`` has (rep, target, model, setting, threshold, coefficients or tree); ``left_out`` names targets without a
    result and why.
    """

    def __init__(self, tried, accuracy, chosen, edges, left_out):
        self.tried, self.accuracy, self.chosen, self.edges, self.left_out = tried, accuracy, chosen, edges, left_out


def tune(w: Weightings) -> Tuned:
    """Settings judged by mean balanced accuracy over inner folds; thresholds by that of the pooled inner scores."""
    tried = settings(w.features)
    linear = [i for i, s in enumerate(tried) if s["model"] != "tree"]
    logistic, _ = fit_logistics(w, [s for s in tried if s["model"] == "logistic"])
    lda = fit_discriminants(w)
    beta = {k: np.vstack([logistic[k], lda[k]]) for k in lda}
    edges = T.bin_edges(w)
    grown = T.grow(w, edges, [(n, b) for n in T.LEAVES for b in (False, True)])
    kinds = {i: s for i, s in enumerate(tried) if s["model"] == "tree"}
    pruned = {k: T.pruned_trees(own, kinds) for k, own in grown.items()}
    keys, n = w.draw.keys, len(tried)
    # what a pair of folds tells: with role 1 (fold_a held) about target fold_b, and the other way round
    sides = {k: [(1, keys[k][2]), (2, keys[k][1])] for k in beta if keys[k][1] != keys[k][2]}

    def hits(k, x, y, weight, role):
        hit = probability(_with_one(x) @ beta[k].T) >= 0.5
        return np.concatenate([v for r in (1, 2) for m in [role == r] for v in (hit[m & (y == 1)].sum(0), (~hit[m & (y == 0)]).sum(0), [(m & (y == 1)).sum(), (m & (y == 0)).sum()])]).astype(float)

    inner = np.array(sorted(sides), np.int64)
    counted, leaf = w.summed(hits, inner), T.leaf_counts(w, edges, {k: grown[k] for k in sides})
    at = {}  # of every setting's tree: where the leaves of its whole tree stand, and what it says there
    for k in sides:
        place = {p: i for i, p in enumerate(leaf[k][0])}
        own = {kind: t.leaves() for kind, t in grown[k].items()}
        once: dict = {}
        at[k] = {}
        for i, t in pruned[k].items():
            kind = tried[i]["leaf"], tried[i]["balanced"]
            if (id(t), *own[kind]) not in once:
                once[(id(t), *own[kind])] = np.array([place[p] for p in own[kind]]), np.array([t.probability(t.stop(p)) for p in own[kind]])
            at[k][i] = once[(id(t), *own[kind])]
    folds: dict[tuple, list] = {}
    for k, v in counted.items():
        for (r, target), own in zip(sides[k], v.reshape(2, -1), strict=True):
            m = len(linear)
            n1, n0 = own[2 * m :]
            ba = np.empty(n)
            ba[linear] = _accuracy(own[:m], n1, own[m : 2 * m], n0)
            held = leaf[k][1][:, r - 1]
            for i, (where, p) in at[k].items():
                ba[i] = _accuracy(held[where, 1] @ (p >= 0.5), n1, held[where, 0] @ (p < 0.5), n0)
            folds.setdefault((keys[k][0], target), []).append(ba)
    outer = {(keys[k][0], keys[k][1]): k for k in range(w.count) if keys[k][1] == keys[k][2]}
    wanted = {t: sum(1 for k in range(w.count) if keys[k][0] == t[0] and keys[k][1] != keys[k][2] and t[1] in keys[k][1:]) for t in outer}
    left_out = {t: w.failed.get(k) or "inner fold without a fit" for t, k in outer.items() if k not in beta or len(folds.get(t, ())) < wanted[t]}
    accuracy = {t: np.mean(v, axis=0) for t, v in folds.items() if t in outer and t not in left_out}
    best = {t: {m: max((i for i, s in enumerate(tried) if s["model"] == m), key=lambda i: (round(v[i], 12), -i)) for m in MODELS} for t, v in accuracy.items()}
    place = {i: j for j, i in enumerate(linear)}

    def above(k, x, y, weight, role):
        out = []
        for r, target in sides[k]:
            own, m = best.get((keys[k][0], target)), role == r
            score = probability(_with_one(x[m]) @ beta[k][[place[own[name]] for name in ("logistic", "lda")]].T) if own else np.zeros((m.sum(), 2))
            over = score[:, :, None] >= THRESHOLDS
            out += [over[y[m] == 1].sum(0).ravel(), (~over[y[m] == 0]).sum(0).ravel(), [(y[m] == 1).sum(), (y[m] == 0).sum()]]
        return np.concatenate(out).astype(float)

    size = 4 * len(THRESHOLDS)
    pooled: dict[tuple, np.ndarray] = {t: np.zeros((3, 2, len(THRESHOLDS))) for t in best}
    ns: dict[tuple, np.ndarray] = {t: np.zeros(2) for t in best}
    for k, v in w.summed(above, inner).items():
        for (r, target), own in zip(sides[k], v.reshape(2, -1), strict=True):
            t = (keys[k][0], target)
            if t in best:
                pooled[t][[0, 2]] += own[:size].reshape(2, 2, -1).swapaxes(0, 1)
                where, p = at[k][best[t]["tree"]]
                held, over = leaf[k][1][where, r - 1], p[:, None] >= THRESHOLDS
                pooled[t][1] += [(held[:, 1, None] * over).sum(0), (held[:, 0, None] * ~over).sum(0)]
                ns[t] += own[size:]
    chosen = []
    for t, own in sorted(best.items()):
        for model, (ones, zeros) in zip(MODELS, pooled[t], strict=True):
            ba = _accuracy(ones, ns[t][0], zeros, ns[t][1])
            ties = np.flatnonzero(np.abs(ba - ba.max()) < 1e-12)
            threshold = min(THRESHOLDS[ties], key=lambda v: abs(v - 0.5))
            i, k = own[model], outer[t]
            chosen.append((int(t[0]), int(t[1]), model, tried[i], float(threshold), pruned[k][i] if model == "tree" else beta[k][place[i]]))
    return Tuned(tried, accuracy, chosen, edges, left_out)


def prepared(df: DataFrame, parts, library, folds_n: int = 5, repeats: int = 20, zero_c: float = 0.5, group: str = "state") -> Weightings:
    """Units with every pair of folds out, prepared without the units left out."""
    if folds_n < 3:
        raise ValueError("inner folds need three folds or more")
    folds = unit_folds(df.groupBy("unit_id").agg(F.min("label").alias("label")), folds_n, repeats)
    draw = FoldsOut(folds_n, repeats)
    return weightings(df, parts, library, draw, len(draw.keys), fold_words(folds), group, zero_c)


def tuning_table(df: DataFrame, parts, library, folds_n: int = 5, repeats: int = 20, zero_c: float = 0.5) -> DataFrame:
    """``rep, target`` and every setting with its mean inner balanced accuracy, whether it is chosen, and the threshold then."""
    w = prepared(df, parts, library, folds_n, repeats, zero_c)
    try:
        tuned = tune(w)
    finally:
        w.close()
    chosen = {(rep, t, id(s)): threshold for rep, t, _, s, threshold, _ in tuned.chosen}
    rows = [
        (int(rep), int(t), s["model"], "+".join(s["features"]), s["c"], s["balanced"], s["shrinkage"], s["depth"], s["leaf"], s["alpha"], float(v), (rep, t, id(s)) in chosen, chosen.get((rep, t, id(s))))
        for (rep, t), accuracy in sorted(tuned.accuracy.items())
        for s, v in zip(tuned.tried, accuracy, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "rep int, target int, model string, features string, c double, balanced boolean, shrinkage string, depth int, leaf int, alpha double, balanced_accuracy double, chosen boolean, threshold double")


def out_of_fold(w: Weightings, tuned: Tuned) -> DataFrame:
    """``rep, fold, unit_id, y, model, score, threshold``: every unit once per repeat and model, scored by its own fold's models."""
    outer = {(r, a): k for k, (r, a, b) in enumerate(w.draw.keys) if a == b}
    models: dict[int, list] = {}
    for rep, t, model, _, threshold, fit in tuned.chosen:
        models.setdefault(rep, []).append((t, outer[rep, t], model, threshold, fit))
    turn, draw, edges = w.turn, w.draw, tuned.edges
    schema = "rep int, fold int, unit_id long, y int, model string, score double, threshold double"

    def judge(batches):
        for batch in _sliced(batches):
            x, y, a = _matrix(batch, "x"), *(_vector(batch, c) for c in ("y", "a_"))
            ids = batch.column(batch.schema.get_field_index("unit_id"))
            for rep, own in models.items():
                fold = draw.folds(a, np.array([outer[rep, 0]]))[:, 0]
                for t, k, model, threshold, fit in own:
                    at = np.flatnonzero(fold == t)
                    z = x[at] @ turn[k]
                    score = fit.score(z, edges) if model == "tree" else probability(_with_one(z) @ fit)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int32)) for v in (rep, t)] + [ids.take(pa.array(at)), pa.array(y[at].astype(np.int32)), pa.array([model] * n, pa.string()), pa.array(score), pa.array(np.full(n, threshold))], names=["rep", "fold", "unit_id", "y", "model", "score", "threshold"])

    return w.units.select(F.col("unit_id").cast("long"), "y", "a_", "x").mapInArrow(judge, schema)


def cross_validate(df: DataFrame, parts, library, folds_n: int = 5, repeats: int = 20, zero_c: float = 0.5) -> tuple[DataFrame, Tuned]:
    """The out-of-fold table, written to the shared folder, and what the folds learned.

    An error if a fold has no model, or a unit does not occur exactly once in every repeat and model.
    """
    w = prepared(df, parts, library, folds_n, repeats, zero_c)
    try:
        tuned = tune(w)
        if tuned.left_out:
            raise ValueError(f"folds without a model: {tuned.left_out}")
        out = materialise(out_of_fold(w, tuned), "oof")
        n = w.units.count()
    finally:
        w.close()
    once = out.groupBy("rep", "model").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("units")).collect()
    if len(once) != repeats * len(MODELS) or any(r["n"] != n or r["units"] != n for r in once):
        raise ValueError("a unit does not occur exactly once in every repeat")
    return out, tuned


def nested_cv(df: DataFrame, parts, library, folds_n: int = 5, repeats: int = 20, zero_c: float = 0.5) -> DataFrame:
    """Out-of-fold table ``rep, fold, unit_id, y, model, score, threshold``: every unit once per repeat and model.

    Preparation, setting and threshold of a fold come from the other folds alone.
    """
    return cross_validate(df, parts, library, folds_n, repeats, zero_c)[0]
