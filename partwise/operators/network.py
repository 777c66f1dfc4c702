"""Proportionality networks of parts: edges, their resampling, differences between labels."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import total
from .audit import bh_fdr_few, set_jaccard
from .logratio import few_rows, ilr, prepare_by, unit_centers
from .refit import Drawn, drawn_words, weightings
from .resample import Replicates, edge_rhos, edge_sums, resample


def log_centers(df: DataFrame, parts, keys=(), carry=("label",)) -> DataFrame:
    """Units' centres with ``l_*``, centred log parts (the same scale for observed and permuted edges)."""
    centers = unit_centers(df, parts, carry=carry, keys=keys)
    mean = total([F.log(p) for p in parts]) / len(parts)
    return centers.withColumn("mean_", mean).withColumns({f"l_{p}": F.log(p) - F.col("mean_") for p in parts}).drop("mean_")


def edges(centers: DataFrame, parts, by, weight: str | None = None) -> DataFrame:
    """``by, part_j, part_k, variation, rho``: log-ratio variance and rho = 2 cov / (var + var) of every pair.

    One aggregation of sums, squares and products; ``weight`` counts copies of a unit.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pairs = list(combinations(parts, 2))
    sums = [F.sum(w).alias("n_"), *[F.sum(w * F.col(f"l_{p}")).alias(f"s_{p}") for p in parts], *[F.sum(w * F.col(f"l_{p}") * F.col(f"l_{p}")).alias(f"q_{p}") for p in parts], *[F.sum(w * F.col(f"l_{j}") * F.col(f"l_{k}")).alias(f"x_{j}_{k}") for j, k in pairs]]
    m = centers.groupBy(*by).agg(*sums)
    var = lambda p: (F.col(f"q_{p}") - F.col(f"s_{p}") * F.col(f"s_{p}") / F.col("n_")) / (F.col("n_") - 1)
    cov = lambda j, k: (F.col(f"x_{j}_{k}") - F.col(f"s_{j}") * F.col(f"s_{k}") / F.col("n_")) / (F.col("n_") - 1)
    each = F.array(*[F.struct(F.lit(j).alias("part_j"), F.lit(k).alias("part_k"), (var(j) + var(k) - 2 * cov(j, k)).alias("variation"), (2 * cov(j, k) / (var(j) + var(k))).alias("rho")) for j, k in pairs])
    return m.select(*by, F.explode(each).alias("e")).select(*by, "e.*")


def fitted(df: DataFrame, parts, keys=("label",), zero_c: float = 0.5, weight: str | None = None) -> DataFrame:
    return ilr(prepare_by(df, keys, parts, zero_c, weight), parts)


def main_edges(df: DataFrame, parts, zero_c: float = 0.5) -> DataFrame:
    """Edges over all units: a row a label and pair, read at once, so that no later join computes them again."""
    return few_rows(edges(log_centers(fitted(df, parts, zero_c=zero_c), parts), parts, ["label"]))


def _edge_rows(spark, found: Replicates, parts) -> DataFrame:
    rho = edge_rhos(found, parts)
    pairs = list(combinations(range(len(parts)), 2))
    n, (g, r) = len(pairs), np.nonzero(np.isfinite(rho).all(axis=(2, 3)))
    names, label = np.array(parts, object), np.array(found.groups, object)
    j, k = (np.array([p[i] for p in pairs]) for i in (0, 1))
    rows = pd.DataFrame({"rep": np.repeat(r, n).astype(np.int32), "label": np.repeat(label[g], n), "part_j": np.tile(names[j], len(r)), "part_k": np.tile(names[k], len(r)), "rho": rho[g, r][:, j, k].ravel()})
    return spark.createDataFrame(rows, "rep int, label string, part_j string, part_k string, rho double")


def boot_edges(df: DataFrame, parts, reps: int) -> DataFrame:
    """``rep, label, part_j, part_k, rho`` of every bootstrap replicate, prepared anew in it."""
    return _edge_rows(df.sparkSession, resample(df, parts, reps, edge_sums(parts), squares=True), parts)


def edge_table(main: DataFrame, boot: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges with interval, selection and direction frequency, and the core gate of all three."""
    signed = boot.join(main.select("label", "part_j", "part_k", F.col("rho").alias("main_")), ["label", "part_j", "part_k"])
    by = signed.groupBy("label", "part_j", "part_k").agg(F.percentile("rho", 0.025).alias("ci_low"), F.percentile("rho", 0.975).alias("ci_high"), F.avg((F.abs("rho") >= least).cast("int")).alias("selection_frequency"), F.avg((F.signum("rho") == F.signum("main_")).cast("int")).alias("direction_frequency"), F.count("*").alias("successes"))
    core = (F.abs("rho") >= least) & (F.col("selection_frequency") >= 0.7) & (F.col("direction_frequency") >= 0.8)
    return main.join(by, ["label", "part_j", "part_k"]).withColumn("core", core)


def adjusted_edges(df: DataFrame, parts, state: str = "unit_state") -> DataFrame:
    """Edges of log parts less their mean within label and state."""
    centers = log_centers(fitted(df, parts), parts, carry=("label", state))
    means = centers.groupBy("label", state).agg(*[F.avg(f"l_{p}").alias(f"a_{p}") for p in parts])
    rest = centers.join(means, ["label", state]).withColumns({f"l_{p}": F.col(f"l_{p}") - F.col(f"a_{p}") for p in parts})
    return edges(rest, parts, ["label"])


def shrunk_partial(s: np.ndarray, fourth: float, n: float) -> tuple[np.ndarray, float]:
    """Partial correlations of a covariance with Ledoit-Wolf shrinkage, and the shrinkage; ``fourth`` is the mean of the
    fourth power of the norm of ``n`` centred rows."""
    p = len(s)
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    shrink = 0.0 if delta == 0 else max(0.0, min((fourth - (s**2).sum()) / (p * n), delta) / delta)
    inverse = np.linalg.pinv((1 - shrink) * s + shrink * mu * np.eye(p), hermitian=True)
    d = np.sqrt(np.diag(inverse))
    return -inverse / np.outer(d, d), shrink


def partial_corr(centers: DataFrame, parts) -> DataFrame:
    """Partial correlations of centred log parts with Ledoit-Wolf shrinkage: moments by Spark, a small inverse after."""
    n = len(parts)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    means = centers.groupBy("label").agg(*[F.avg(f"l_{p}").alias(f"a_{p}") for p in parts])
    x = centers.join(means, "label").withColumns({f"l_{p}": F.col(f"l_{p}") - F.col(f"a_{p}") for p in parts})
    square = total([F.col(f"l_{p}") * F.col(f"l_{p}") for p in parts])
    moments = x.groupBy("label").agg(F.count("*").alias("n"), F.avg(square * square).alias("fourth"), *[F.avg(F.col(f"l_{parts[i]}") * F.col(f"l_{parts[j]}")).alias(f"c{i}_{j}") for i, j in pairs])

    def invert(batches):
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                s = np.zeros((n, n))
                for i, j in pairs:
                    s[i, j] = s[j, i] = r[f"c{i}_{j}"]
                partial, shrink = shrunk_partial(s, r["fourth"], r["n"])
                rows += [(r["label"], parts[i], parts[j], float(partial[i, j]), float(shrink)) for i, j in combinations(range(n), 2)]
            yield pd.DataFrame(rows, columns=["label", "part_j", "part_k", "partial", "shrinkage"])

    return moments.mapInPandas(invert, "label string, part_j string, part_k string, partial double, shrinkage double")


def boot_partials(df: DataFrame, parts, reps: int = 1_000, zero_c: float = 0.5, salt: str = "boot") -> DataFrame:
    """``rep, label, part_j, part_k, partial, shrinkage``: preparation, covariance and shrinkage fitted anew in each replicate.

    A unit's centred logs are linear in its sums (see ``refit``), so a replicate costs one small matrix; its second
    moments and the mean fourth power of the norm are summed over units, and small inverses follow.
    """
    parts, rows = list(parts), []
    for label in sorted(r["label"] for r in df.select("label").distinct().collect()):
        own = df.where(F.col("label") == label)
        w = weightings(own, parts, None, Drawn(), reps, drawn_words(own, salt), "label", zero_c, None)
        try:
            ids, means, scale = w.fitted(), w.means[:, 1], w.scale

            def fourth(k, x, y, weight, role, means=means, scale=scale):
                z = (x - means[k]) * scale[k]
                return np.array([weight @ (z * z).sum(axis=1) ** 2])

            fours = w.summed(fourth, ids)
            for k in ids.tolist():
                n, s = w.counts[k, 1], w.covs[k, 1] * np.outer(scale[k], scale[k])
                if n < 2:
                    continue
                partial, shrink = shrunk_partial(s, fours[k][0] / n, n)
                rows += [(k, label, parts[i], parts[j], float(partial[i, j]), shrink) for i, j in combinations(range(len(parts)), 2)]
        finally:
            w.close()
    return df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["rep", "label", "part_j", "part_k", "partial", "shrinkage"]), "rep int, label string, part_j string, part_k string, partial double, shrinkage double")


def partial_table(main: DataFrame, boot: DataFrame) -> DataFrame:
    """Partial correlations with their bootstrap interval, the share of replicates of the same sign, and their number."""
    both = boot.select("rep", "label", "part_j", "part_k", F.col("partial").alias("p_")).join(main, ["label", "part_j", "part_k"])
    by = both.groupBy("label", "part_j", "part_k").agg(F.percentile("p_", 0.025).alias("ci_low"), F.percentile("p_", 0.975).alias("ci_high"), F.avg((F.signum("p_") == F.signum("partial")).cast("int")).alias("direction_frequency"), F.count("*").alias("successes"))
    return main.join(by, ["label", "part_j", "part_k"])


def deltas(edge_rows: DataFrame, keys=()) -> DataFrame:
    """Difference of rho between the two labels (the first less the second in sorted order), paired by ``keys``."""
    a, b = edge_rows.alias("a"), edge_rows.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "part_j", "part_k")] + [F.col("a.label") < F.col("b.label")]
    return a.join(b, on).select(*[F.col(f"a.{c}").alias(c) for c in (*keys, "part_j", "part_k")], (F.col("a.rho") - F.col("b.rho")).alias("delta"))


def perm_edges(df: DataFrame, parts, reps: int) -> DataFrame:
    """``rep, label, part_j, part_k, rho`` with labels dealt anew to units: medians, closure and centres of the dealt label."""
    return _edge_rows(df.sparkSession, resample(df, parts, reps, edge_sums(parts), squares=True, permute=True, salt="perm"), parts)


def diff_edges(main: DataFrame, boot: DataFrame, perm: DataFrame, reps: int) -> DataFrame:
    """Differential edges: delta, interval over replicates paired by id, direction, permutation p, adjusted p, core gate."""
    d = deltas(main)
    own = d.select("part_j", "part_k", F.col("delta").alias("main_"))
    over = deltas(boot, ("rep",)).join(own, ["part_j", "part_k"]).groupBy("part_j", "part_k").agg(F.percentile("delta", 0.025).alias("ci_low"), F.percentile("delta", 0.975).alias("ci_high"), F.avg((F.signum("delta") == F.signum("main_")).cast("int")).alias("direction_frequency"))
    null = deltas(perm, ("rep",)).join(own, ["part_j", "part_k"]).groupBy("part_j", "part_k").agg(((F.sum((F.abs("delta") >= F.abs("main_") - 1e-12).cast("int")) + 1) / (reps + 1)).alias("p"))
    out = bh_fdr_few(d.join(over, ["part_j", "part_k"]).join(null, ["part_j", "part_k"]).withColumn("all_", F.lit(1)), "p", ["all_"], tie="part_j").drop("all_")
    return out.withColumn("core", (F.col("p_fdr") < 0.05) & (F.abs("delta") >= 0.2) & (F.col("direction_frequency") >= 0.8))


def network_stability(main: DataFrame, boot: DataFrame, parts, least: float = 0.5) -> DataFrame:
    """Per replicate and label: edges, density, Jaccard with the main network."""
    kept = boot.where(F.abs("rho") >= least)
    reps = boot.select("rep", "label").distinct()
    whole = reps.join(main.where(F.abs("rho") >= least).select("label", "part_j", "part_k"), "label")
    n = len(parts) * (len(parts) - 1) / 2
    counts = reps.join(kept.groupBy("rep", "label").agg(F.count("*").alias("n_edges")), ["rep", "label"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    alike = set_jaccard(kept, whole, ["part_j", "part_k"], ["rep", "label"]).select("rep", "label", "jaccard")
    return counts.join(alike, ["rep", "label"], "left").select("rep", "label", "n_edges", (F.col("n_edges") / n).alias("density"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))


def network_sensitivity(scenarios: dict[str, tuple[DataFrame, float]], parts) -> DataFrame:
    """Per scenario (points, edge threshold) and label: edges, Jaccard with ``main``, agreement of signs."""
    out = None
    for name, (df, least) in scenarios.items():
        one = df.withColumns({"scenario": F.lit(name), "edge": F.abs("rho") >= least})
        out = one if out is None else out.unionByName(one)
    base = out.where("scenario = 'main'").select("label", "part_j", "part_k", F.col("rho").alias("r_"), F.col("edge").alias("e_"))
    both = out.join(base, ["label", "part_j", "part_k"])
    any_, all_ = F.sum((F.col("edge") | F.col("e_")).cast("int")), F.sum((F.col("edge") & F.col("e_")).cast("int"))
    same: Column = F.avg((F.signum("rho") == F.signum("r_")).cast("int"))
    return both.groupBy("scenario", "label").agg(F.sum(F.col("edge").cast("int")).alias("n_edges"), F.when(any_ == 0, 1.0).otherwise(all_ / any_).alias("jaccard"), same.alias("sign_agreement"))
