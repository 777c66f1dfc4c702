"""Nested cross-validation against plain loops over folds, settings and thresholds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.functions.expressions import uniform
from partwise.operators import classify, nested, trees
from partwise.operators.keys import unit_folds

PARTS = ("a", "b", "c")
LIBRARY = {"one": (("a",), ("b",)), "two": (("a", "b"), ("c",))}


@pytest.fixture(scope="module")
def points(spark):
    """90 points of 45 units; the label moves part a, some values are missing or zero."""
    rows = spark.range(90).select(F.col("id").alias("point_id"), (F.col("id") % 45).alias("unit_id"))
    u = lambda s: uniform(F.lit(s), "point_id")
    rows = rows.withColumn("label", F.when(uniform(F.lit("l"), "unit_id") < 0.4, "PB").otherwise("K"))
    rows = rows.withColumn("state", F.when(u("s") < 0.5, "W").otherwise("U"))
    return rows.withColumns({
        "a": F.when(u("m") < 0.1, None).otherwise(20 + 30 * u("a") + F.when(F.col("label") == "PB", 12.0).otherwise(0.0)),
        "b": F.when(u("z") < 0.1, 0.0).otherwise(10 + 20 * u("b")),
        "c": 15 + 20 * u("c"),
    })


def features(points, train, units):
    """Standardised balances of ``units``, prepared by the points of ``train``."""
    own = points[points.unit_id.isin(train)]
    medians = own.groupby("state")[list(PARTS)].median()
    filled = points.copy()
    for p in PARTS:
        filled[p] = filled[p].fillna(filled.state.map(medians[p]))
    seen = filled[filled.unit_id.isin(train)]
    for p in PARTS:
        filled.loc[filled[p] == 0, p] = 0.5 * seen.loc[seen[p] > 0, p].min()
    logs = np.log(filled[list(PARTS)])
    for name, (num, den) in LIBRARY.items():
        filled[name] = math.sqrt(len(num) * len(den) / (len(num) + len(den))) * (logs[list(num)].mean(axis=1) - logs[list(den)].mean(axis=1))
    by = filled.groupby("unit_id")[list(LIBRARY)].mean()
    mean, sd = by.loc[train].mean(), by.loc[train].std(ddof=0)
    return ((by.loc[units] - mean) / sd).to_numpy()


def logistic(x, y, s):
    use = [list(LIBRARY).index(f) for f in s["features"]]
    z = np.column_stack([x[:, use], np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if s["balanced"] else np.ones(len(y))
    ridge = np.diag([1 / s["c"]] * len(use) + [0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z * (w * mu * (1 - mu))[:, None]).T @ z + ridge, z.T @ (w * (y - mu)) - ridge @ beta)
        beta += step
    out = np.zeros(x.shape[1] + 1)
    out[use], out[-1] = beta[:-1], beta[-1]
    return out


def discriminant(x, y, s):
    cov, means = np.zeros((x.shape[1],) * 2), []
    for c in (0, 1):
        own = x[y == c]
        n, p = own.shape
        means.append(own.mean(0))
        if s["shrinkage"] == "auto":
            sd = own.std(0)
            z = (own - means[-1]) / sd
            emp = z.T @ z / n
            mu = np.trace(emp) / p
            off = ((emp - mu * np.eye(p)) ** 2).sum() / p
            err = min(sum(((np.outer(r, r) - emp) ** 2).sum() for r in z) / n**2 / p, off)
            a = err / off
            one = ((1 - a) * emp + a * mu * np.eye(p)) * np.outer(sd, sd)
        else:
            a, emp = float(s["shrinkage"]), np.cov(own.T, bias=True)
            one = (1 - a) * emp + a * np.trace(emp) / p * np.eye(p)
        cov += n / len(y) * one
    w = np.linalg.solve(cov, means[1] - means[0])
    return np.append(w, -w @ (means[0] + means[1]) / 2 + np.log(y.sum() / (1 - y).sum()))


def plain_tree(x, y, edges, depth, leaf, alpha, balanced):
    """A tree grown by trying every cut of every feature, then pruned; nested dictionaries."""
    w = np.array([len(y) / (2 * (y == 0).sum()), len(y) / (2 * (y == 1).sum())]) if balanced else np.ones(2)
    mass = lambda rows: np.array([(y[rows] == c).sum() for c in (0, 1)]) * w
    total = mass(np.arange(len(y))).sum()
    risk = lambda rows: (mass(rows).sum() - (mass(rows) ** 2).sum() / mass(rows).sum()) / total

    def build(rows, left_depth):
        node = {"p": mass(rows)[1] / mass(rows).sum(), "risk": risk(rows)}
        best = None
        if left_depth and len(set(y[rows])) == 2 and len(rows) >= 2 * leaf:
            for f in range(x.shape[1]):
                for e in edges[f]:
                    a, b = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                    if min(len(a), len(b)) >= leaf:
                        worth = round((mass(a) ** 2).sum() / mass(a).sum() + (mass(b) ** 2).sum() / mass(b).sum(), 9)
                        if best is None or worth > best[0]:
                            best = worth, f, e, a, b
        if best:
            node |= {"f": best[1], "e": best[2], "kids": [build(r, left_depth - 1) for r in best[3:]]}
        return node

    def leaves(n):
        return [n] if "kids" not in n else [v for k in n["kids"] for v in leaves(k)]

    def inner(n):
        return [] if "kids" not in n else [n, *[v for k in n["kids"] for v in inner(k)]]

    tree = build(np.arange(len(y)), depth)
    while alpha and inner(tree):
        gain = lambda n: (n["risk"] - sum(v["risk"] for v in leaves(n))) / (len(leaves(n)) - 1)
        weakest = min(inner(tree), key=gain)
        if gain(weakest) > alpha:
            break
        del weakest["kids"]

    def score(row, n):
        return n["p"] if "kids" not in n else score(row, n["kids"][int(row[n["f"]] > n["e"])])

    return lambda z: np.array([score(r, tree) for r in z])


def accuracy(y, hit):
    return (hit[y == 1].mean() + (~hit[y == 0]).mean()) / 2


def test_nested_equals_loops(spark, points):
    folds = unit_folds(points.groupBy("unit_id").agg(F.min("label").alias("label")), 4, 2).toPandas()
    plain = points.toPandas().astype({p: float for p in PARTS})
    y_of = (folds.drop_duplicates("unit_id").set_index("unit_id").label == "PB").astype(float)
    told = nested.tuning_table(points, PARTS, LIBRARY, 4, 2).toPandas()
    oof = nested.nested_cv(points, PARTS, LIBRARY, 4, 2).toPandas()
    assert len(oof) == 3 * 2 * 45 and not oof.duplicated(["rep", "unit_id", "model"]).any()
    tried = nested.settings(list(LIBRARY))
    assert len(tried) == 3 * 7 * 2 + 120 + 6
    w = nested.prepared(points, PARTS, LIBRARY, 4, 2)
    edges = trees.bin_edges(w)
    w.close()
    score = lambda b, x: 1 / (1 + np.exp(-(x @ b[:-1] + b[-1])))

    def fit(s, x, y):
        if s["model"] == "tree":
            return plain_tree(x, y, edges, s["depth"], s["leaf"], s["alpha"], s["balanced"])
        beta = (logistic if s["model"] == "logistic" else discriminant)(x, y, s)
        return lambda z: score(beta, z)

    for rep, target in ((0, 0), (1, 2)):
        fold = folds[folds.rep == rep].set_index("unit_id").fold
        results, pooled = [], []
        for j in [f for f in range(4) if f != target]:
            train, held = [sorted(fold.index[m]) for m in (~fold.isin([target, j]), fold == j)]
            x, v = features(plain, train, train), features(plain, train, held)
            scores = [fit(s, x, y_of[train].to_numpy())(v) for s in tried]
            results.append([accuracy(y_of[held].to_numpy(), p >= 0.5) for p in scores])
            pooled.append((y_of[held].to_numpy(), scores))
        means = np.mean(results, axis=0)
        own = told[(told.rep == rep) & (told.target == target)]
        assert np.allclose(own.balanced_accuracy, means)
        train, held = [sorted(fold.index[m]) for m in (fold != target, fold == target)]
        for model in nested.MODELS:
            mine = [i for i, s in enumerate(tried) if s["model"] == model]
            best = max(mine, key=lambda i: (round(means[i], 12), -i))
            assert own.chosen.to_numpy()[best]
            y = np.concatenate([p[0] for p in pooled])
            p = np.concatenate([q[1][best] for q in pooled])
            gains = np.array([accuracy(y, p >= t) for t in nested.THRESHOLDS])
            want = min(nested.THRESHOLDS[gains >= gains.max() - 1e-12], key=lambda t: abs(t - 0.5))
            last = fit(tried[best], features(plain, train, train), y_of[train].to_numpy())
            got = oof[(oof.rep == rep) & (oof.fold == target) & (oof.model == model)].sort_values("unit_id")
            assert np.allclose(got.threshold, want)
            assert np.allclose(got.score, last(features(plain, train, held)), atol=1e-6)


def test_nested_needs_three_folds(points):
    with pytest.raises(ValueError):
        nested.nested_cv(points, PARTS, LIBRARY, 2, 1)


def test_no_unit_is_lost_by_unseen_rare_or_null_states(spark):
    """States that a fold's training units lack, have fewer than five values of, or that are null take the global median."""
    rows = [(i, i, "K" if i % 2 else "PB", "W" if i < 30 else "U", 10.0 + i, None if i % 3 == 0 else 20.0 + i % 7, 30.0) for i in range(40)]
    rows += [(100, 100, "K", "X", 11.0, None, 30.0), (101, 101, "PB", None, 12.0, None, 30.0), (102, 102, "K", "R", 13.0, 99.0, 30.0), (103, 103, "K", "R", 13.0, None, 30.0)]
    df = spark.createDataFrame(rows, "point_id long, unit_id long, label string, state string, a double, b double, c double")
    tagged = df.withColumns({"k": F.lit(1), "role": F.when(F.col("unit_id").isin(100, 101), "held").otherwise("train")})
    told = {r["unit_id"]: r for r in classify.fold_features(tagged, ["k"], PARTS, LIBRARY).collect()}
    assert set(told) == {r[0] for r in rows}
    middle = float(np.median([r[5] for r in rows if r[5] is not None and r[0] < 100 or r[0] == 102]))
    for u, a in ((100, 11.0), (101, 12.0), (103, 13.0)):
        assert told[u]["one"] == pytest.approx(math.sqrt(0.5) * math.log(a / middle))


def test_weightings_fill_like_the_features(spark, points):
    """The engine's features under one weighting equal those of the plain preparation, for every unit."""
    from partwise.operators import pipelines, refit

    words = points.select("unit_id").distinct().withColumns({"a_": F.lit(0).cast("long"), "b_": F.lit(0).cast("long")})
    w = refit.weightings(points, PARTS, LIBRARY, pipelines.Every(), 1, words)
    units = w.units.select("unit_id", "x").toPandas().sort_values("unit_id")
    got = np.array(units.x.tolist()) @ w.turn[0]
    w.close()
    ids = sorted(units.unit_id)
    assert np.allclose(got, features(points.toPandas().astype({p: float for p in PARTS}), ids, ids), atol=1e-9)


def test_training_medians_of_few_folds_gather_no_group(spark, monkeypatch):
    rows = spark.range(40).selectExpr("cast(id % 2 as int) as k", "cast(null as string) as state", "'train' as role", "id as unit_id", "'K' as label", "if(id % 5 = 0, null, cast(id + 1 as double)) as a", "cast(id % 7 as double) as b")
    monkeypatch.setattr(classify.F, "percentile", lambda *args: pytest.fail("a task would hold a group"))
    told = {r["k"]: r for r in classify.train_medians(rows, ["k"], ["a", "b"], "g", True).collect()}
    for k in (0, 1):
        a = [i + 1 for i in range(40) if i % 2 == k and i % 5]
        assert told[k]["g_a"] == np.median(a) and told[k]["n_a"] == len(a)


def test_folds_start_from_the_first_ones_coefficients(spark, monkeypatch):
    from types import SimpleNamespace

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x[:, 0] - 1))).astype(int)
    weights = {k: (np.arange(400) % 5 != k).astype(float) for k in range(5)}
    passes = []

    def summed(each, ids):
        passes.append(len(ids))
        return {k: each(k, x, y, weights[k], None) for k in ids.tolist()}

    counts = np.array([[weights[k][y == c].sum() for c in (0, 1)] for k in range(5)])
    w = SimpleNamespace(features=["a", "b"], fitted=lambda: np.arange(5), counts=counts, summed=summed)
    tried = [{"features": ("a", "b"), "c": c, "balanced": b} for c in (0.1, 10.0) for b in (False, True)]
    beta, unsettled = nested.fit_logistics(w, tried)
    assert not unsettled and sum(n > 1 for n in passes) <= 4 < sum(n == 1 for n in passes)
    for k in range(5):
        for s, b in zip(tried, beta[k], strict=True):
            v = weights[k] * ((counts[k].sum() / (2 * counts[k]))[y] if s["balanced"] else 1.0)
            z = np.hstack([x, np.ones((400, 1))])
            slope = z.T @ (v * (y - 1 / (1 + np.exp(-z @ b)))) - np.append(b[:2], 0) / s["c"]
            assert np.abs(slope).max() < 1e-6
