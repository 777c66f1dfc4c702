"""Association of two categories: tests on contingency tables, their resampling, logistic models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import odds_ratio
from .audit import contingency


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom, by the finite recursions."""
    from ..functions.expressions import erfc_p

    half = x / 2
    even_terms = F.aggregate(F.sequence(F.lit(1), F.greatest((df / 2).cast("int"), F.lit(1))), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * half / k).alias("t")))["s"]
    odd_terms = F.aggregate(F.sequence(F.lit(1), F.greatest(((df - 1) / 2).cast("int"), F.lit(1))), F.struct(F.lit(0.0).alias("s"), F.sqrt(x).alias("t")), lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * x / (2 * k + 1)).alias("t")))["s"]
    odd = erfc_p(F.sqrt(x)) + F.when(df > 1, F.sqrt(F.lit(2 / math.pi)) * F.exp(-half) * odd_terms).otherwise(0.0)
    return F.when(df % 2 == 0, F.exp(-half) * even_terms).otherwise(odd)


def chi2_test(cells: DataFrame, by=()) -> DataFrame:
    """Pearson chi-square without correction, degrees of freedom, p, and whether the table is too sparse for it."""
    gap = (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("expected")
    out = cells.groupBy(*by).agg(F.sum(gap).alias("chi2"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).cast("int").alias("df"), F.sum("observed").alias("n"), (F.min("expected") < 1).alias("tiny"), F.avg((F.col("expected") < 5).cast("int")).alias("small_share"))
    out = out.withColumn("p", chi2_tail(F.col("chi2"), F.col("df"))).withColumn("sparse", F.col("tiny") | (F.col("small_share") > 0.2))
    return out.drop("tiny", "small_share")


def cramers_v(cells: DataFrame, by=()) -> DataFrame:
    """Bias-corrected Cramer's V."""
    gap = (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("expected")
    base = cells.groupBy(*by).agg(F.sum(gap).alias("chi2"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("k"), F.sum("observed").alias("n"))
    return base.select(*by, _corrected(F.col("chi2"), F.col("r"), F.col("k"), F.col("n")).alias("v"))


def _corrected(chi2: Column, r: Column, k: Column, n: Column) -> Column:
    phi = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / (n - 1))
    least = F.least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)
    return F.when(least > 0, F.sqrt(phi / least)).otherwise(0.0)


def loo_v(cells: DataFrame) -> DataFrame:
    """Per non-empty cell: V without one of its units; all units of a cell give the same table."""
    full = cells.where("observed > 0").select(F.col("a").alias("da"), F.col("b").alias("db"), F.col("observed").alias("units"))
    grid = full.withColumn("k_", F.lit(1)).join(cells.select("a", "b", "observed").withColumn("k_", F.lit(1)), "k_").drop("k_")
    less = grid.withColumn("observed", F.col("observed") - ((F.col("a") == F.col("da")) & (F.col("b") == F.col("db"))).cast("int"))
    rows, columns = less.groupBy("da", "db", "a").agg(F.sum("observed").alias("rn")), less.groupBy("da", "db", "b").agg(F.sum("observed").alias("cn"))
    whole = less.groupBy("da", "db").agg(F.sum("observed").alias("tn"))
    full_ = less.join(rows, ["da", "db", "a"]).join(columns, ["da", "db", "b"]).join(whole, ["da", "db"]).where("rn > 0 and cn > 0")
    return cramers_v(full_.withColumn("expected", F.col("rn") * F.col("cn") / F.col("tn")), ["da", "db"]).join(full, ["da", "db"]).select(F.col("da").alias("a"), F.col("db").alias("b"), "units", "v")


def _table(cells: DataFrame, most: int = 10_000) -> np.ndarray:
    """The table of a contingency frame as a matrix; an error if it has more than ``most`` cells."""
    rows = cells.select("a", "b", "observed").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} cells")
    a, b = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    out = np.zeros((len(a), len(b)), np.int64)
    for r in rows:
        out[a.index(r["a"]), b.index(r["b"])] = r["observed"]
    return out


def fisher_exact(cells: DataFrame) -> DataFrame:
    """Two-sided exact p of a 2 x 2 table: the tables with its margins that are at most as likely."""
    (a, b), (c, d) = _table(cells).tolist()
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    low, high = max(0, a - d), min(a + b, a + c)
    logs = [log_choose(a + b, x) + log_choose(c + d, a + c - x) - log_choose(a + b + c + d, a + c) for x in range(low, high + 1)]
    p = sum(math.exp(v) for v in logs if v <= logs[a - low] + 1e-7)
    return cells.sparkSession.createDataFrame([(min(1.0, p),)], "p double")


def chi2_of(t: np.ndarray) -> float:
    t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0]
    e = t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True) / t.sum()
    return float(((t - e) ** 2 / e).sum())


def v_of(t: np.ndarray) -> float:
    t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0]
    n, (r, k) = t.sum(), t.shape
    if min(r, k) < 2 or n < 2:
        return float("nan")
    phi = max(0.0, chi2_of(t) / n - (k - 1) * (r - 1) / (n - 1))
    least = min(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1
    return math.sqrt(phi / least) if least > 0 else 0.0


#: Cells of a table of counts that a task holds at most.
MOST_CELLS = 10_000


def chi2_of_many(t: np.ndarray) -> np.ndarray:
    """Chi-square of tables (table, row, column) of equal total, empty rows and columns left out."""
    with np.errstate(divide="ignore", invalid="ignore"):
        e = t.sum(axis=2, keepdims=True) * t.sum(axis=1, keepdims=True) / t.sum(axis=(1, 2), keepdims=True)
        return np.where(e > 0, (t - e) ** 2 / e, 0.0).sum(axis=(1, 2))


def v_of_many(t: np.ndarray) -> np.ndarray:
    """Corrected V of every table; NaN where fewer than two rows or columns are left."""
    n, r, k = t.sum(axis=(1, 2)), (t.sum(axis=2) > 0).sum(axis=1), (t.sum(axis=1) > 0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.maximum(0.0, chi2_of_many(t) / n - (k - 1) * (r - 1) / (n - 1))
        least = np.minimum(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1
        return np.where((np.minimum(r, k) < 2) | (n < 2), np.nan, np.where(least > 0, np.sqrt(phi / np.where(least > 0, least, 1.0)), 0.0))


def _by_replicate(spark, reps: int, each, schema: str) -> DataFrame:
    """``each(replicates)`` in tasks, for runs of 256 replicates: the rows that were counted are never drawn again."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                own = batch.id.to_numpy()[at : at + 256]
                yield pd.DataFrame({"rep": own} | each(own))

    return spark.range(reps).mapInPandas(run, schema)


def perm_chi2(cells: DataFrame, reps: int = 10_000, seed: int = 1) -> DataFrame:
    """``rep, chi2`` of random tables with the observed margins; tasks draw replicates, never rows."""
    table = _table(cells)
    rows, columns = table.sum(axis=1), table.sum(axis=0)

    def each(ids):
        out = []
        for rep in ids.tolist():
            rng, left, t = np.random.default_rng([seed, rep]), columns.copy(), []
            for n in rows[:-1]:
                t.append(rng.multivariate_hypergeometric(left, n))
                left = left - t[-1]
            out.append([*t, left])
        return {"chi2": chi2_of_many(np.array(out, float))}

    return _by_replicate(cells.sparkSession, reps, each, "rep long, chi2 double")


def perm_p(cells: DataFrame, reps: int = 10_000, seed: int = 1) -> DataFrame:
    """Monte-Carlo p = (b + 1) / (B + 1) and its standard error."""
    observed = chi2_of(_table(cells))
    p = (F.sum((F.col("chi2") >= observed - 1e-12).cast("int")) + 1) / (reps + 1)
    return perm_chi2(cells, reps, seed).agg(p.alias("p")).withColumn("se", F.sqrt(F.col("p") * (1 - F.col("p")) / reps))


def _multinomial(counts: np.ndarray, ids, seed: int) -> np.ndarray:
    """Bootstrap tables: resampled rows are a multinomial draw over the cells, one seed a replicate."""
    n, share = int(counts.sum()), counts / counts.sum()
    return np.array([np.random.default_rng([seed, int(rep)]).multinomial(n, share) for rep in ids], float)


def boot_v(cells: DataFrame, reps: int = 1_000, seed: int = 1) -> DataFrame:
    """Interval of V over bootstrap tables, and the share of tables that have one."""
    table = _table(cells)
    drawn = _by_replicate(cells.sparkSession, reps, lambda ids: {"v": v_of_many(_multinomial(table.ravel(), ids, seed).reshape(-1, *table.shape))}, "rep long, v double")
    good = F.when(~F.isnan("v"), F.col("v"))
    return drawn.agg(F.percentile(good, 0.025).alias("ci_low"), F.percentile(good, 0.975).alias("ci_high"), F.avg((~F.isnan("v")).cast("int")).alias("success"))


def ridge_newton(x: np.ndarray, y: np.ndarray, weights: np.ndarray, c: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (table, feature and intercept) of L2-penalised logistic models, all tables together; and which settled.

    ``x`` and ``y`` belong to the cells, ``weights`` (table, cell) are their counts; the intercept is not penalised.
    """
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1], 1 / c), 1e-9)
    beta, step = np.zeros((len(weights), z.shape[1])), np.full((len(weights), 1), np.inf)
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-np.clip(beta @ z.T, -30, 30)))
        grad = (weights * (y - mu)) @ z - ridge * beta
        hess = np.einsum("bc,ci,cj->bij", weights * mu * (1 - mu), z, z) + np.diag(ridge)
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        step *= np.minimum(1, 5 / np.maximum(np.linalg.norm(step, axis=1), 1e-12))[:, None]
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta, np.abs(step).max(axis=1) < 1e-6


def logistic_glm(df: DataFrame, label: str, features) -> DataFrame:
    """Coefficients, errors, odds ratios with intervals, p; ``separated`` marks huge errors or coefficients."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    counted = df.groupBy(label, *features).agg(F.count("*").cast("double").alias("weight_"))
    rows = VectorAssembler(inputCols=list(features), outputCol="x_").transform(counted)
    model = GeneralizedLinearRegression(family="binomial", labelCol=label, featuresCol="x_", weightCol="weight_", maxIter=50).fit(rows)
    s = model.summary
    names = [*features, "intercept"]
    beta = [*model.coefficients.toArray().tolist(), model.intercept]
    told = [(n, float(b), float(e), math.exp(max(-30, min(30, b))), math.exp(max(-30, min(30, b - 1.96 * e))), math.exp(max(-30, min(30, b + 1.96 * e))), float(p), bool(e > 100 or abs(b) > 10)) for n, b, e, p in zip(names, beta, s.coefficientStandardErrors, s.pValues, strict=True)]
    return df.sparkSession.createDataFrame(told, "term string, beta double, se double, odds_ratio double, ci_low double, ci_high double, p double, separated boolean")


def logistic_ridge(df: DataFrame, label: str, features, c: float = 100.0, reps: int = 1_000, seed: int = 1) -> DataFrame:
    """``term, beta, se, odds_ratio, ci_low, ci_high, success``: L2-penalised coefficients with bootstrap intervals.

    Rows are counted by label and features once; every replicate is a multinomial table of these counts and is fitted by
    Newton steps on the counts.  Tables of one class, and those that do not settle, have no part in the interval.
    """
    features = list(features)
    counted = df.groupBy(label, *features).agg(F.count("*").alias("n_")).limit(MOST_CELLS + 1).collect()
    if len(counted) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    counted = sorted(counted, key=lambda r: [r[f] for f in (label, *features)])
    x, y, n = np.array([[r[f] for f in features] for r in counted], float), np.array([r[label] for r in counted], float), np.array([r["n_"] for r in counted])
    main, _ = ridge_newton(x, y, n[None, :].astype(float), c)

    def each(ids):
        tables = _multinomial(n, ids, seed)
        beta, fine = ridge_newton(x, y, tables, c)
        fine &= (tables @ y > 0) & (tables @ (1 - y) > 0)
        return {"beta": [b.tolist() if f else None for b, f in zip(beta, fine, strict=True)]}

    drawn = _by_replicate(df.sparkSession, reps, each, "rep long, beta array<double>").where("beta is not null")
    by = drawn.select(F.posexplode("beta").alias("at", "b")).groupBy("at").agg(F.stddev_samp("b").alias("se"), F.percentile("b", 0.025).alias("low"), F.percentile("b", 0.975).alias("high"), (F.count("*") / F.lit(reps)).alias("success"))
    terms = df.sparkSession.createDataFrame([(i, t, float(b)) for i, (t, b) in enumerate(zip([*features, "intercept"], main[0], strict=True))], "at int, term string, beta double")
    return terms.join(by, "at", "left").select("term", "beta", "se", odds_ratio(F.col("beta")).alias("odds_ratio"), odds_ratio(F.col("low")).alias("ci_low"), odds_ratio(F.col("high")).alias("ci_high"), F.coalesce("success", F.lit(0.0)).alias("success"))


def assoc_scenarios(scenarios: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """Chi-square, df and V of each scenario."""
    out = None
    for name, df in scenarios.items():
        cells = contingency(df, a, b)
        one = chi2_test(cells).select("chi2", "df", "n").withColumn("one_", F.lit(1)).join(cramers_v(cells).withColumn("one_", F.lit(1)), "one_").drop("one_").withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
