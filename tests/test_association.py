"""Exact and Monte-Carlo tests of tables, and penalised models with bootstrap intervals, against plain loops."""

import math

import numpy as np
import pytest

from partwise.operators import association as A
from partwise.operators.audit import contingency

TABLE = np.array([[12, 5], [3, 14], [7, 7]])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("abc"[i], "xy"[j], float(i == 1), float(i == 2), j) for (i, j), n in np.ndenumerate(TABLE) for _ in range(n)], "a string, b string, f1 double, f2 double, y int")


def test_many_tables_equal_one_by_one():
    rng = np.random.default_rng(4)
    tables = np.array([rng.multinomial(20, [0.4, 0.05, 0.05, 0.2, 0.2, 0.1]).reshape(3, 2) for _ in range(200)] + [[[5, 0], [3, 0], [2, 0]]], float)
    assert np.allclose(A.chi2_of_many(tables)[:-1], [A.chi2_of(t) for t in tables[:-1]])
    assert np.allclose(A.v_of_many(tables), [A.v_of(t) for t in tables], equal_nan=True)


def test_permutation_p_is_near_the_exact_one(spark, rows):
    """Tables of these margins have known probabilities: the share of those at least as extreme is the exact p."""
    told = A.perm_p(contingency(rows, "a", "b"), 4000).first()
    rows_, columns = TABLE.sum(1), TABLE.sum(0)
    exact = total = 0.0
    for i in range(rows_[0] + 1):
        for j in range(rows_[1] + 1):
            k = columns[0] - i - j
            if 0 <= k <= rows_[2]:
                p = math.comb(rows_[0], i) * math.comb(rows_[1], j) * math.comb(rows_[2], k)
                total += p
                exact += p * (A.chi2_of(np.array([[i, rows_[0] - i], [j, rows_[1] - j], [k, rows_[2] - k]])) >= A.chi2_of(TABLE) - 1e-12)
    assert abs(told["p"] - exact / total) < 5 * told["se"] + 1 / 4000


def _fit(x, y, c):
    z = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(z.shape[1]), np.diag([1 / c] * x.shape[1] + [1e-9])
    for _ in range(80):
        mu = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z + ridge, z.T @ (y - mu) - ridge @ beta)
    return beta


def test_ridge_and_its_bootstrap_equal_copied_rows(spark, rows):
    plain = rows.toPandas()
    told = A.logistic_ridge(rows, "y", ["f1", "f2"], 10.0, reps=40).toPandas().set_index("term")
    assert np.allclose(told.beta[["f1", "f2", "intercept"]], _fit(plain[["f1", "f2"]].to_numpy(), plain.y.to_numpy(), 10.0), atol=1e-7)
    cells = plain.groupby(["y", "f1", "f2"]).size().reset_index(name="n").sort_values(["y", "f1", "f2"])
    drawn = A._multinomial(cells.n.to_numpy(), range(40), 1).astype(int)
    betas = []
    for t in drawn:
        own = cells.loc[cells.index.repeat(t)]
        betas.append(_fit(own[["f1", "f2"]].to_numpy(), own.y.to_numpy(), 10.0))
    betas = np.array(betas)
    for i, term in enumerate(["f1", "f2", "intercept"]):
        assert told.se[term] == pytest.approx(betas[:, i].std(ddof=1), abs=1e-6)
        assert told.ci_low[term] == pytest.approx(math.exp(np.quantile(betas[:, i], 0.025)), rel=1e-6)
    assert (told.success == 1).all()


def test_glm_equals_a_plain_fit(spark, rows):
    plain = rows.toPandas()
    told = {r["term"]: r for r in A.logistic_glm(rows, "y", ["f1", "f2"]).collect()}
    beta = _fit(plain[["f1", "f2"]].to_numpy(), plain.y.to_numpy(), 1e9)
    assert [told[t]["beta"] for t in ("f1", "f2", "intercept")] == pytest.approx(beta.tolist(), abs=1e-5)
    assert not told["f1"]["separated"]


def test_fisher_equals_enumeration(spark):
    df = spark.createDataFrame([("ab"[i], "xy"[j]) for (i, j), n in np.ndenumerate(np.array([[8, 2], [1, 5]])) for _ in range(n)], "a string, b string")
    p = [math.comb(10, x) * math.comb(6, 9 - x) / math.comb(16, 9) for x in range(3, 10)]
    assert A.fisher_exact(contingency(df, "a", "b")).first()["p"] == pytest.approx(sum(v for v in p if v <= p[8 - 3] * (1 + 1e-7)))


def test_one_class_tables_have_no_part_in_intervals(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 0), (0.0, 0)], "f double, y int")
    told = A.logistic_ridge(df, "y", ["f"], 1.0, reps=60).first()
    assert 0 < told["success"] < 1
