"""Resampling from unit sums against plain loops over the rows of a replicate."""

import numpy as np
import pandas as pd
import pytest

from partwise.functions.expressions import helmert
from partwise.operators import effect, network
from partwise.operators import resample as R

PARTS = ("a", "b", "c", "d")
BASIS = np.array(helmert(len(PARTS)))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for unit in range(60):
        label = "K" if unit % 3 else "PB"
        for _ in range(int(rng.integers(1, 6))):
            x = np.exp(rng.normal(0, 1, 4) + (np.arange(4) * 0.3 if label == "K" else 0)).round(2)
            x[rng.random(4) < 0.2] = 0
            x = [None if rng.random() < 0.25 else float(v) for v in x]
            rows.append((len(rows), unit, label, "W" if (unit + rng.integers(0, 2)) % 2 else "U", *x))
    return spark.createDataFrame(rows, "point_id long, unit_id long, label string, state string, a double, b double, c double, d double").repartition(3)


def prepared(x):
    """Parts of a replicate's rows, filled with medians and with zeros replaced."""
    medians = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), medians, x)
    deltas = np.array([0.5 * c[c > 0].min() for c in x.T])
    return np.where(x == 0, deltas, x), medians, deltas


def words(spark, points, salt):
    rows = points.select("unit_id").distinct().select("unit_id", R.word(salt, "unit_id", 0).alias("a"), R.word(salt, "unit_id", 1).alias("b")).toPandas().set_index("unit_id")
    return rows.index, lambda reps: R.drawn(rows.a.to_numpy(), rows.b.to_numpy(), np.arange(reps)), rows


def rhos(x, units, copies):
    logs = np.log(x)
    means = pd.DataFrame(logs - logs.mean(axis=1, keepdims=True)).groupby(units).mean()
    y = means.loc[np.repeat(means.index, [copies[u] for u in means.index])].to_numpy()
    cov = np.cov(y.T)
    v = np.diag(cov)
    return 2 * cov / (v[:, None] + v)


@pytest.mark.parametrize("reach", [R.REACH, 1.5])
def test_bootstrap_equals_copied_rows(spark, points, monkeypatch, reach):
    """With a short reach some medians lie outside the first bracket and all values are ranked."""
    monkeypatch.setattr(R, "REACH", reach)
    reps = 260
    rows = points.toPandas()
    index, numbers, _ = words(spark, points, "boot")
    m = pd.DataFrame(np.searchsorted(R.Poisson.cuts, numbers(reps), "right"), index=index)
    found = R.resample(points, PARTS, reps, R.effect_sums(PARTS))
    a, b = R.effects(found, PARTS)
    rho = R.edge_rhos(R.resample(points, PARTS, reps, R.edge_sums(PARTS), squares=True), PARTS)
    for g, label in enumerate(found.groups):
        own = rows[rows.label == label]
        weight = 1 / own.groupby("unit_id").unit_id.transform("size")
        for r in (0, 1, 249, 250, 259):
            k = m.loc[own.unit_id, r].to_numpy()
            x, medians, deltas = prepared(np.repeat(own[list(PARTS)].to_numpy(float), k, axis=0))
            assert np.allclose(found.medians[g, r], medians) and np.allclose(found.deltas[g, r], deltas)
            z, s, w = np.log(x) @ BASIS.T, np.repeat(own.state.to_numpy(), k), np.repeat(weight.to_numpy(), k)
            mean = {t: np.average(z[s == t], axis=0, weights=w[s == t]) for t in "UW"}
            assert np.allclose(a[g, r], mean["U"]) and np.allclose(b[g, r], mean["W"] - mean["U"])
            once = np.cumsum(k)[k > 0] - 1
            assert np.allclose(rho[g, r], rhos(x[once], own[k > 0].unit_id.to_numpy(), m[r]))


def test_permutation_deals_labels_to_units(spark, points):
    reps = 255
    rows = points.toPandas()
    label = rows.groupby("unit_id").label.first()
    index, numbers, both = words(spark, points, "perm")
    rho = R.edge_rhos(R.resample(points, PARTS, reps, R.edge_sums(PARTS), squares=True, permute=True, salt="perm"), PARTS)
    x = numbers(reps)
    for r in (0, 7, 254):
        order = sorted(range(len(index)), key=lambda i: (x[i, r], both.b.iloc[i]))
        dealt = pd.Series("PB", index=index)
        dealt.iloc[order[: (label == "K").sum()]] = "K"
        for g, name in enumerate(("K", "PB")):
            own = rows[dealt.loc[rows.unit_id].to_numpy() == name]
            clean, _, _ = prepared(own[list(PARTS)].to_numpy(float))
            assert np.allclose(rho[g, r], rhos(clean, own.unit_id.to_numpy(), pd.Series(1, index=index)))


def test_permuted_states_keep_their_number(spark, points):
    ready = effect.prepared_points(points, PARTS).persist()
    told = {r["label"]: r for r in effect.perm_state(ready, PARTS, 300).collect()}
    means = effect.unit_means(ready, PARTS).toPandas().set_index("unit_id")
    index, numbers, both = words(spark, points, "perm")
    x = pd.DataFrame(numbers(300), index=index)
    z = [f"ilr_{i}" for i in range(1, len(PARTS))]
    for label, own in means.groupby("label"):
        exceed = 0
        for r in range(300):
            order = sorted(own.index, key=lambda u: (x.loc[u, r], both.b.loc[u]))
            k = (own.state == "W").sum()
            d = own.loc[order[:k], z].mean() - own.loc[order[k:], z].mean()
            exceed += np.linalg.norm(d) >= told[label]["observed"] - 1e-12
        assert told[label]["exceed"] == exceed and abs(told[label]["p"] - (exceed + 1) / 301) < 1e-12


def test_counterfactual_quantiles_equal_loops(spark, points):
    params = effect.replicate_parameters(points, PARTS, 120)
    out = effect.counterfactual_intervals(points, params, PARTS).toPandas().set_index(["point_id", "part"])
    rows = points.where("state = 'W'").toPandas()
    assert len(out) == len(rows) * len(PARTS)
    for r in rows.itertuples():
        est = []
        for med, delta, shift in zip(params.medians[r.label], params.deltas[r.label], params.shifts[r.label], strict=True):
            x = np.array([r.a, r.b, r.c, r.d], float)
            x = np.where(np.isnan(x), med, x)
            x = np.where(x == 0, delta, x) * np.exp(-shift)
            est.append(x / x.sum() * 100)
        low, mid, high = np.quantile(est, [0.025, 0.5, 0.975], axis=0)
        for i, p in enumerate(PARTS):
            assert np.allclose(out.loc[(r.point_id, p)], [low[i], mid[i], high[i]])


def test_differences_of_edges_use_all_replicates(points):
    boot, perm, main = network.boot_edges(points, PARTS, 50), network.perm_edges(points, PARTS, 99), network.main_edges(points, PARTS)
    out = network.diff_edges(main, boot, perm, 99).toPandas()
    d = perm.toPandas().pivot_table(index=["rep", "part_j", "part_k"], columns="label", values="rho")
    d = (d.K - d.PB).reset_index(name="delta")
    for r in out.itertuples():
        null = d[(d.part_j == r.part_j) & (d.part_k == r.part_k)].delta
        assert len(null) == 99 and abs(r.p - ((null.abs() >= abs(r.delta) - 1e-12).sum() + 1) / 100) < 1e-12


def test_radius_is_computed_once_a_pattern(spark, points, monkeypatch):
    ready = effect.prepared_points(points, PARTS)
    point = effect.counterfactual(ready, effect.state_effect(ready, PARTS, ["label"]), PARTS)
    params = effect.replicate_parameters(points, PARTS, 80)
    rows = points.where("state = 'W'").toPandas().merge(point.select("point_id", *[f"cf_{p}" for p in PARTS]).toPandas(), on="point_id")
    few, sizes = effect.few_rows, []
    monkeypatch.setattr(effect, "few_rows", lambda df: few(df) if sizes.append(df.count()) is None else None)
    told = effect.uncertainty_radius(points, point, params, PARTS).toPandas().set_index("point_id").radius
    assert len(told) == len(rows) and max(sizes) <= 2 * 3 ** len(PARTS)
    for label, own in rows.groupby("label"):
        gap = np.log(params.estimates(label, own[list(PARTS)].to_numpy(float))) - np.log(own[[f"cf_{p}" for p in PARTS]].to_numpy(float))[:, None, :]
        gap -= gap.mean(axis=2, keepdims=True)
        assert np.allclose(told[own.point_id], np.quantile(np.sqrt((gap * gap).sum(axis=2)), 0.95, axis=1), atol=1e-9)


def test_estimates_by_part_and_their_quantiles():
    rng = np.random.default_rng(5)
    medians, deltas, shifts = rng.random((41, 3)), rng.random((41, 3)) / 10, rng.normal(0, 1, (41, 3))
    medians[:9, 1] = 0
    params = effect.ShiftReplicates(("a", "b", "c"), {"K": medians}, {"K": deltas}, {"K": shifts})
    values = np.array([[1.0, np.nan, 3.0], [0.0, 2.0, np.nan], [np.nan, np.nan, 5.0], [4.0, 5.0, 6.0]])
    plain, own = params.estimates("K", values), params.by_part("K", values)
    assert np.allclose(own.transpose(0, 2, 1), plain, rtol=1e-13)
    shares = (0.025, 0.5, 0.975)
    assert np.allclose(effect.sorted_quantiles(own, shares), np.quantile(plain, shares, axis=1), rtol=1e-12)


def test_ranked_weights_are_bounded(spark, points, monkeypatch):
    whole = network.boot_edges(points, PARTS, 60).toPandas()
    monkeypatch.setattr(R, "WEIGHTS", 200)
    again = network.boot_edges(points, PARTS, 60).toPandas()
    keys = ["rep", "label", "part_j", "part_k"]
    both = whole.merge(again, on=keys)
    assert len(both) == len(whole) and np.allclose(both.rho_x, both.rho_y, rtol=0, atol=1e-12)
