"""Leak-free features by fold, batched logistic and discriminant models, metrics, calibration, selection, freezing."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import logit, odds_ratio, total
from ..sources.shared import materialise
from .audit import auc
from .evidence import table_fingerprint
from .logratio import balances, closure, few_rows
from .ranks import joined_back
from .selection import MOST_GROUPS, select


def split_features(df: DataFrame, folds: DataFrame, parts, library, group: str = "state", zero_c: float = 0.5) -> DataFrame:
    """``rep, target, role, unit_id, label`` and the units' balances, once per (rep, target) fold.

    Medians (by ``group``, never the label) and zero replacements come from the units outside the target fold and
    are applied to all: every fold is a group key, so all folds are fitted by the same two aggregations.
    """
    k = folds.agg(F.max("fold")).first()[0] + 1
    rows = materialise(df.select("unit_id", "label", group, *parts).join(folds.select("unit_id", "rep", "fold"), "unit_id"), "folds").withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = rows.withColumn("role", F.when(F.col("fold") == F.col("target"), "validation").otherwise("train"))
    return fold_features(rows, ["rep", "target"], parts, library, group, zero_c)


def fold_features(rows: DataFrame, keys: list[str], parts, library, group: str = "state", zero_c: float = 0.5, min_obs: int = 5) -> DataFrame:
    """Unit balances of points with ``keys`` and ``role``, prepared by the points in role ``train`` of the same keys.

    A level of ``group`` with fewer than ``min_obs`` values of a part, one that the training points lack, and a null one
    take the median of all training points; no point is lost.
    """
    train = F.col("role") == "train"
    few = rows.select(*keys, group).distinct().limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    own, over = (train_medians(rows.where(train), by, parts, name, few) for by, name in (([*keys, group], "m"), (keys, "g")))
    filled = joined_back(rows, own, [*keys, group], [f"{x}_{p}" for p in parts for x in ("m", "n")])
    filled = joined_back(filled, over, keys, [f"g_{p}" for p in parts])
    level = lambda p: F.when(F.col(group).isNotNull() & (F.col(f"n_{p}") >= min_obs), F.col(f"m_{p}"))
    filled = filled.withColumns({p: F.coalesce(F.col(p), level(p), F.col(f"g_{p}")) for p in parts}).drop(*[f"{x}_{p}" for p in parts for x in ("m", "n", "g")])
    deltas = filled.where(train).groupBy(*keys).agg(*[(zero_c * F.min(F.when(F.col(p) > 0, F.col(p)))).alias(f"d_{p}") for p in parts])
    deltas = few_rows(deltas) if few else deltas
    closed = closure(joined_back(filled, deltas, keys, [f"d_{p}" for p in parts]).withColumns({p: F.when(F.col(p) == 0, F.col(f"d_{p}")).otherwise(F.col(p)) for p in parts}), parts)
    return balances(closed, library).groupBy(*keys, "role", "unit_id", "label").agg(F.count("*").alias("n_points"), *[F.avg(b).alias(b) for b in library])


def train_medians(df: DataFrame, by, parts, name: str, few: bool) -> DataFrame:
    """``by``, and of every part the median ``name_part`` and the number ``n_part`` of its values.

    ``few`` groups are selected by sketches and counts, so no task holds a group's values; with many, a group is a small
    part of the rows and is read by one task.
    """
    if not few:
        return df.groupBy(*by).agg(*[x for p in parts for x in (F.percentile(p, 0.5).alias(f"{name}_{p}"), F.count(p).alias(f"n_{p}"))])
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in by], *[f"{x}_{p} {t}" for p in parts for x, t in ((name, "double"), ("n", "long"))]])
    rows = [(*level, *[v for p in parts for v in (own[p][1][0], own[p][0])]) for level, own in select(df.select(*by, *[F.col(p).cast("double").alias(p) for p in parts]), parts, by, [0.5], cached=True).items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def joined(df: DataFrame, table: list[tuple], keys: list[str], names: list[str]) -> DataFrame:
    """``df`` with a small table of numbers by key, which the driver made (one row a key)."""
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} double" for n in names])
    return df.join(F.broadcast(df.sparkSession.createDataFrame(table, schema)), keys)


def batched_logistic(df: DataFrame, keys: list[str], features: list[str], y: str = "y", weight: str | None = None, c: str | None = None, steps: int = 8) -> dict[tuple, np.ndarray]:
    """Penalised logistic coefficients (features, then intercept) of every key at once.

    A step is one aggregation of gradient and Hessian sums by key; only those sums (a few numbers a key) are solved
    outside.  ``c`` is a column of inverse penalties (constant within a key), without it the penalty is tiny; keys
    whose labels are all equal are left out.  Features should be standardised.
    """
    p = len(features) + 1
    x = [*[F.col(f) for f in features], F.lit(1.0)]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    beta: dict[tuple, np.ndarray] = {}
    both = df.groupBy(*keys).agg(F.min(y).alias("lo"), F.max(y).alias("hi")).where("lo < hi").collect()
    beta = {tuple(r[k] for k in keys): np.zeros(p) for r in both}
    names = [f"beta_{i}" for i in range(p)]
    for _ in range(steps):
        if not beta:
            return {}
        now = joined(df, [(*k, *map(float, b)) for k, b in beta.items()], keys, names)
        mu = 1 / (1 + F.exp(-F.greatest(F.least(total([F.col(n) * v for n, v in zip(names, x, strict=True)]), F.lit(30.0)), F.lit(-30.0))))
        now = now.withColumn("mu_", mu)
        grad = [F.sum(w * (F.col(y) - F.col("mu_")) * v).alias(f"g{i}") for i, v in enumerate(x)]
        hess = [F.sum(w * F.col("mu_") * (1 - F.col("mu_")) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i, p)]
        penalty = F.lit(1e-6) if c is None else F.first(1 / F.col(c))
        for r in now.groupBy(*keys).agg(*grad, *hess, penalty.alias("l_")).collect():
            key = tuple(r[k] for k in keys)
            h = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            ridge = r["l_"] * np.diag([1.0] * (p - 1) + [0.0])
            g = np.array([r[f"g{i}"] for i in range(p)]) - ridge @ beta[key]
            beta[key] = beta[key] + np.linalg.solve(h + ridge + 1e-9 * np.eye(p), g)
    return beta


def standardised(df: DataFrame, keys: list[str], features: list[str], where: str = "role = 'train'") -> DataFrame:
    """Features less their mean over their population deviation, both of the rows that satisfy ``where``."""
    s = df.where(where).groupBy(*keys).agg(*[v for f in features for v in (F.avg(f).alias(f"a_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    return df.join(F.broadcast(s), keys).withColumns({f: (F.col(f) - F.col(f"a_{f}")) / F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(1.0) for f in features}).drop(*[f"{x}_{f}" for f in features for x in ("a", "s")])


def lda(df: DataFrame, keys: list[str], features: list[str], y: str = "y", shrink: float = 0.1) -> dict[tuple, np.ndarray]:
    """Discriminant coefficients (features, then intercept) of every key: class moments by one aggregation."""
    n = len(features)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    rows = df.groupBy(*keys, y).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"a{i}") for i, f in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    by: dict[tuple, dict] = {}
    for r in rows:
        cov = np.zeros((n, n))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        by.setdefault(tuple(r[k] for k in keys), {})[r[y]] = (r["n"], np.array([r[f"a{i}"] for i in range(n)]), cov)
    out = {}
    for key, cls in by.items():
        if len(cls) == 2:
            (n0, m0, c0), (n1, m1, c1) = cls[0], cls[1]
            pooled = (n0 * c0 + n1 * c1) / (n0 + n1)
            pooled = (1 - shrink) * pooled + shrink * np.trace(pooled) / n * np.eye(n)
            w = np.linalg.solve(pooled, m1 - m0)
            out[key] = np.append(w, -w @ (m0 + m1) / 2 + np.log(n1 / n0))
    return out


def score(df: DataFrame, keys: list[str], features: list[str], beta: dict[tuple, np.ndarray]) -> DataFrame:
    """``df`` with ``score``, the probability by the coefficients of its key."""
    names = [f"beta_{i}" for i in range(len(features) + 1)]
    out = joined(df, [(*k, *map(float, b)) for k, b in beta.items()], keys, names)
    z = total([F.col(n) * v for n, v in zip(names, [*[F.col(f) for f in features], F.lit(1.0)], strict=True)])
    return out.withColumn("score", 1 / (1 + F.exp(-z))).drop(*names)


def class_metrics(oof: DataFrame, threshold: float | Column = 0.5) -> DataFrame:
    """Per rep and model: balanced accuracy, macro F1, Brier score, area under the curve."""
    hit = F.col("score") >= threshold
    count = lambda y, h: F.sum(((F.col("y") == y) & (hit if h else ~hit)).cast("double"))
    by = oof.groupBy("rep", "model").agg(count(1, True).alias("tp"), count(1, False).alias("fn"), count(0, True).alias("fp"), count(0, False).alias("tn"), F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier"))
    f1 = (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")) + 2 * F.col("tn") / (2 * F.col("tn") + F.col("fp") + F.col("fn"))) / 2
    ba = (F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp"))) / 2
    return by.join(auc(oof, ["rep", "model"]), ["rep", "model"]).select("rep", "model", ba.alias("balanced_accuracy"), f1.alias("macro_f1"), "brier", "auc")


def calibration_fit(oof: DataFrame, keys: list[str]) -> DataFrame:
    """Intercept and slope of the labels on the scores' logits, per key."""
    rows = oof.withColumn("z_", logit(F.col("score")))
    beta = batched_logistic(rows, keys, ["z_"])
    kinds = dict(oof.dtypes)
    return oof.sparkSession.createDataFrame([(*k, float(b[1]), float(b[0])) for k, b in beta.items()], ", ".join([f"{k} {kinds[k]}" for k in keys] + ["intercept double", "slope double"]))


def confusion(oof: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts of all four cells per model, zeros included."""
    hit = (F.col("score") >= threshold).cast("int")
    cells = oof.select("model").distinct().withColumn("y", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("predicted", F.explode(F.array(F.lit(0), F.lit(1))))
    counts = oof.groupBy("model", F.col("y").cast("int").alias("y"), hit.alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["model", "y", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def model_comparison(metrics: DataFrame, names=("balanced_accuracy", "brier")) -> DataFrame:
    """Mean paired difference between two models per metric, with its quantiles over replicates."""
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    rows = metrics.select("rep", "model", F.explode(each).alias("m")).select("rep", "model", "m.*")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.rep") == F.col("b.rep")) & (F.col("a.metric") == F.col("b.metric")) & (F.col("a.model") < F.col("b.model")))
    d = F.col("a.value") - F.col("b.value")
    return pairs.groupBy(F.col("a.metric").alias("metric"), F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(F.avg(d).alias("mean"), F.percentile(d, 0.025).alias("ci_low"), F.percentile(d, 0.975).alias("ci_high"))


def select_model(metrics: DataFrame, simplicity: dict[str, int]) -> DataFrame:
    """Models within one standard error of the best accuracy and .02 of the best Brier score; the simplest is chosen."""
    by = metrics.groupBy("model").agg(F.avg("balanced_accuracy").alias("accuracy"), (F.stddev_samp("balanced_accuracy") / F.sqrt(F.count("*"))).alias("se"), F.avg("brier").alias("brier"))
    best = by.agg(F.max(F.struct("accuracy", "se")).alias("b"), F.min("brier").alias("least_brier")).select(F.col("b.accuracy").alias("top"), F.coalesce(F.col("b.se"), F.lit(0.0)).alias("top_se"), "least_brier", F.lit(1).alias("one_"))
    order = F.create_map(*[F.lit(x) for k, v in simplicity.items() for x in (k, v)])
    told = by.withColumn("one_", F.lit(1)).join(best, "one_").withColumn("eligible", (F.col("accuracy") >= F.col("top") - F.col("top_se")) & (F.col("brier") <= F.col("least_brier") + 0.02)).withColumn("rank_", order[F.col("model")])
    first = told.where("eligible").agg(F.min("rank_").alias("first_"), F.lit(1).alias("one_"))
    return told.join(first, "one_").select("model", "accuracy", "brier", "eligible", (F.col("eligible") & (F.col("rank_") == F.col("first_"))).alias("selected"))


def freeze(spark: SparkSession, pipeline: dict, path: str) -> str:
    """Write a pipeline as a parameter table with its fingerprint (no time is part of it); returns the fingerprint."""
    rows = spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(pipeline.items())], "name string, value string")
    mark = table_fingerprint(rows).first()["fingerprint"]
    rows.write.mode("overwrite").parquet(f"{path}/parameters")
    spark.createDataFrame([(mark,)], "fingerprint string").write.mode("overwrite").parquet(f"{path}/manifest")
    return mark


def load_frozen(spark: SparkSession, path: str) -> dict:
    """Read a frozen pipeline; an error if its parameters do not give the manifest's fingerprint."""
    rows = spark.read.parquet(f"{path}/parameters")
    want = spark.read.parquet(f"{path}/manifest").first()["fingerprint"]
    if table_fingerprint(rows).first()["fingerprint"] != want:
        raise ValueError("frozen parameters have changed")
    return {r["name"]: json.loads(r["value"]) for r in rows.collect()}


def unit_features(df: DataFrame, pipeline: dict) -> DataFrame:
    """Standardised balances of the units of ``df`` by a frozen pipeline: literals only, one aggregation by unit."""
    from .logratio import Prep, transform

    group = pipeline["group"] or "all_"
    df = df if pipeline["group"] else df.withColumn("all_", F.lit("all"))
    prep = Prep(group, tuple(pipeline["parts"]), pipeline["medians"], pipeline["counts"], pipeline["global"], 5, pipeline["delta"])
    library = {k: tuple(map(tuple, v)) for k, v in pipeline["library"].items()}
    seen = F.coalesce(F.col(group).isin(*pipeline["medians"]), F.lit(False))
    units = balances(transform(df, prep), library).groupBy("unit_id").agg(F.max((~seen).cast("int")).alias("unseen_group"), F.max((~F.col("valid")).cast("int")).alias("invalid"), *[F.avg(b).alias(b) for b in library])
    s = pipeline["scale"]
    return units.withColumns({f: (F.col(f) - s[f"a_{f}"]) / (s[f"s_{f}"] or 1.0) for f in library})


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def linear_score(features, beta):
    z = total([float(b) * F.col(f) for b, f in zip(beta, features, strict=False)]) + float(beta[-1])
    return 1 / (1 + F.exp(-z))


def reject_reasons(df: DataFrame, pipeline: dict, fuzzy: float = 0.1, least_majority: float = 0.8) -> DataFrame:
    """``reasons`` joined by ``;`` and ``rejected``, from scores, interval, votes, domain and flags of a unit."""
    selected = pipeline["selected"]
    p, threshold = F.col(f"p_{selected}"), pipeline["thresholds"][selected]
    labels = [F.col(f"label_{m}") for m in sorted(pipeline["models"])]
    tests = {
        "low_majority": F.col("majority").isNull() | (F.col("majority") < least_majority),
        "interval_crosses_threshold": (F.col("p_low") <= threshold) & (F.col("p_high") >= threshold),
        "models_disagree": F.least(*labels) != F.greatest(*labels),
        "out_of_domain": F.col("outside"),
        "unseen_group": F.col("unseen_group") == 1,
        "fuzzy_zone": p.between(max(0.0, threshold - fuzzy), min(1.0, threshold + fuzzy)),
        "invalid_sum": F.col("invalid") == 1,
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return df.withColumn("reasons", F.array_join(found, ";")).withColumn("rejected", F.size(found) > 0)


def coef_table(spark: SparkSession, pipeline: dict) -> DataFrame:
    """Coefficients with the balance they belong to and the odds ratio per standard deviation."""
    rows = [(m, name, "+".join(num) + " / " + "+".join(den), float(b)) for m, beta in pipeline["models"].items() if isinstance(beta, list) for (name, (num, den)), b in zip(pipeline["library"].items(), beta, strict=False)]
    return spark.createDataFrame(rows, "model string, feature string, definition string, coef double").withColumn("odds_ratio", odds_ratio(F.col("coef")))


