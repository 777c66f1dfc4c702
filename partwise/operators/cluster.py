"""Sub-classes of units: clustering, its metrics, stability and profiles."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import total
from . import kmeans, mixture
from .audit import avg_rank, unpivot
from .logratio import few_rows
from .resample import Poisson, word
from .selection import select


def clr_spearman(centers: DataFrame, parts, by: str = "label") -> DataFrame:
    """``by, part_j, part_k, rho``: correlation of average ranks of centred log parts over units."""
    cells = avg_rank(unpivot(centers.select(by, "unit_id", *[F.col(f"l_{p}").alias(p) for p in parts]), [by, "unit_id"], parts), "value", [by, "part"])
    wide = cells.where(F.col(by).isNotNull()).groupBy(by, "unit_id").agg(*[F.max(F.when(F.col("part") == p, F.col("rank"))).alias(f"r_{p}") for p in parts])
    pairs = list(combinations(sorted(parts), 2))
    told = wide.groupBy(by).agg(*[F.corr(f"r_{j}", f"r_{k}").alias(f"c_{i}") for i, (j, k) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(j).alias("part_j"), F.lit(k).alias("part_k"), F.col(f"c_{i}").alias("rho")) for i, (j, k) in enumerate(pairs)])
    return told.select(by, F.explode(each).alias("c")).select(by, "c.*")


def part_groups(corr: dict[tuple[str, str], float], order: list[str], cut: float = 0.5) -> list[list[str]]:
    """Groups of average linkage on 1 - abs(rho) up to a distance of ``cut``, in the order of their first part.

    The matrix is one number per pair of parts (at most 14 parts), so it is grouped on the driver.
    """
    groups = [[p] for p in order]
    gap = lambda a, b: 1 - abs(corr.get((a, b), corr.get((b, a))) or 0.0)
    while len(groups) > 1:
        d, i, j = min((float(np.mean([gap(a, b) for a in groups[i] for b in groups[j]])), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > cut:
            break
        groups[i] += groups.pop(j)
    return groups


def representative_parts(corr: dict[tuple[str, str], float], order: dict[str, tuple], cut: float = 0.5) -> list[str]:
    """One part of each group of ``part_groups``, the first by ``order``; all if fewer than two are left."""
    picked = sorted(min(g, key=lambda p: order[p]) for g in part_groups(corr, list(order), cut))
    return picked if len(picked) >= 2 else sorted(order)


def variable_selection(points: DataFrame, centers: DataFrame, parts, by: str = "label", cut: float = 0.5) -> DataFrame:
    """``by, part_group, part, representative, detection_rate, mad``: one part stands for each group of correlated parts.

    Parts of a group rank by the share of points that have them, then by the median absolute deviation of their centred
    logs over units, then by the order given; with fewer than two representatives all parts are ones.
    """
    parts = list(parts)
    rho: dict = {}
    for r in clr_spearman(centers, parts, by).collect():
        rho.setdefault(r[by], {})[r["part_j"], r["part_k"]] = r["rho"]
    seen = {r[by]: r for r in points.groupBy(by).agg(*[(F.count(p) / F.count("*")).alias(p) for p in parts]).collect()}
    logs = [f"l_{p}" for p in parts]
    middle = {g: own for (g,), own in select(centers, logs, [by], [0.5]).items()}
    fall = lambda p: F.coalesce(*[F.when(F.col(by) == g, F.abs(F.col(f"l_{p}") - own[f"l_{p}"][1][0])) for g, own in middle.items() if g is not None], F.lit(None).cast("double"))
    mads = {g: own for (g,), own in select(centers.select(by, *[fall(p).alias(p) for p in parts]), parts, [by], [0.5]).items()}
    rows = []
    for g in sorted(rho):
        rate, mad = {p: float(seen[g][p]) for p in parts}, {p: float(mads[g][p][1][0]) for p in parts}
        order = {p: (-rate[p], -mad[p], i) for i, p in enumerate(parts)}
        picked = representative_parts(rho[g], order, cut)
        for k, group in enumerate(part_groups(rho[g], parts, cut), 1):
            rows += [(g, k, p, p in picked, rate[p], mad[p]) for p in group]
    kind = dict(centers.dtypes)[by]
    return centers.sparkSession.createDataFrame(rows, f"{by} {kind}, part_group int, part string, representative boolean, detection_rate double, mad double")


def cluster_units(df: DataFrame, columns, k: int, method: str = "bisecting", weight: str | None = None, seed: int = 7) -> DataFrame:
    """``df`` with ``cluster``: bisecting k-means, k-means or a Gaussian mixture."""
    kind = {"bisecting": BisectingKMeans, "kmeans": KMeans, "gmm": GaussianMixture}[method]
    model = kind(k=k, seed=seed, featuresCol="x_", predictionCol="cluster", **({"weightCol": weight} if weight else {}))
    rows = VectorAssembler(inputCols=list(columns), outputCol="x_").transform(df)
    return model.fit(rows).transform(rows).drop("x_", "probability")


def cluster_metrics(df: DataFrame, columns, label: str = "cluster") -> DataFrame:
    """One row: Calinski-Harabasz, Davies-Bouldin, smallest size, from sums by cluster."""
    by = few_rows(df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns]))
    all_ = df.agg(*[F.avg(c).alias(f"g_{c}") for c in columns], F.count("*").alias("total"), F.lit(1).alias("one_"))
    gap = lambda a, b: total([(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in columns])
    within = few_rows(df.join(by, label).groupBy(label, "n", *[f"m_{c}" for c in columns]).agg(F.sum(gap("", "m_")).alias("w"), F.avg(F.sqrt(gap("", "m_"))).alias("s")))
    between = within.withColumn("one_", F.lit(1)).join(all_, "one_").agg(F.sum(F.col("n") * gap("m_", "g_")).alias("b"), F.sum("w").alias("w"), F.count("*").alias("k"), F.min("n").alias("smallest"), F.max("total").alias("n"))
    x = within.select(*[F.col(c).alias(f"x_{c}") for c in (label, "s", *[f"m_{c}" for c in columns])])
    y = within.select(*[F.col(c).alias(f"y_{c}") for c in (label, "s", *[f"m_{c}" for c in columns])])
    worst = x.join(y, F.col(f"x_{label}") != F.col(f"y_{label}")).groupBy(f"x_{label}").agg(F.max((F.col("x_s") + F.col("y_s")) / F.sqrt(gap("x_m_", "y_m_"))).alias("r")).agg(F.avg("r").alias("davies_bouldin"), F.lit(1).alias("one_"))
    ch = F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))
    return between.withColumn("one_", F.lit(1)).join(worst, "one_").select("k", ch.alias("calinski_harabasz"), "davies_bouldin", "smallest")


def silhouette(df: DataFrame, columns) -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = VectorAssembler(inputCols=list(columns), outputCol="x_").transform(df)
    return ClusteringEvaluator(featuresCol="x_", predictionCol="cluster").evaluate(rows)


def ari(df: DataFrame, a: str, b: str, by=(), weight: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labelings, from pair counts of their contingency table."""
    n = F.sum(F.lit(1.0) if weight is None else F.col(weight).cast("double"))
    cells = df.groupBy(*by, a, b).agg(n.alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    whole = cells.groupBy(*by).agg(pairs("n").alias("s"), F.sum("n").alias("t"))
    rows = cells.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs("n").alias("sa"))
    columns = cells.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs("n").alias("sb"))
    keys = list(by)
    if not keys:
        whole, rows, columns, keys = whole.withColumn("one_", F.lit(1)), rows.withColumn("one_", F.lit(1)), columns.withColumn("one_", F.lit(1)), ["one_"]
    told = whole.join(rows, keys).join(columns, keys)
    expected = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    best = (F.col("sa") + F.col("sb")) / 2
    return told.select(*by, F.when(best == expected, 1.0).otherwise((F.col("s") - expected) / (best - expected)).alias("ari"))


def align_labels(cells: dict[tuple[int, int], int], k: int) -> dict[int, int]:
    """The renaming of ``k`` labels that maximises the overlap with the reference (k is at most 6)."""
    best = max(permutations(range(k)), key=lambda p: sum(cells.get((i, p[i]), 0) for i in range(k)))
    return dict(enumerate(best))


def cluster_grid(df: DataFrame, columns, ks, method: str, by: str = "label", seed: int = 7) -> DataFrame:
    """``by, k, unit_id, cluster`` of every group and number of clusters."""
    if method == "gmm":
        return mixture.grid(df, columns, ks, by, seed)
    kind = {"bisecting": BisectingKMeans, "kmeans": KMeans}[method]
    rows = VectorAssembler(inputCols=list(columns), outputCol="x_").transform(df.select(by, "unit_id", *columns))
    kept = rows.persist()
    out = None
    try:
        for group in sorted(r[0] for r in kept.select(by).distinct().collect()):
            own, told = kept.where(F.col(by) == group), rows.where(F.col(by) == group)
            for k in ks:
                told = kind(k=k, seed=seed, featuresCol="x_", predictionCol=f"c_{k}").fit(own).transform(told)
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c_{k}").alias("cluster")) for k in ks]))
            one = told.select(by, "unit_id", each.alias("e")).select(by, "e.k", "unit_id", "e.cluster")
            out = one if out is None else out.unionByName(one)
    finally:
        kept.unpersist()
    return out


def _units(df: DataFrame, columns, salt: str, by: str = "label") -> tuple[list[str], DataFrame]:
    groups = sorted(r[0] for r in df.select(by).distinct().collect())
    code = F.array_position(F.array(*map(F.lit, groups)), F.col(by)).cast("int") - 1
    return groups, df.select(code.alias("g_"), word(salt, "unit_id", 0).alias("a_"), word(salt, "unit_id", 1).alias("b_"), F.array(*columns).alias("x"))


def _long(spark, groups, found: dict, name: str, rep: str) -> DataFrame:
    rows = [(groups[c], k, r, float(v)) for (c, k), values in sorted(found.items()) for r, v in enumerate(values)]
    return spark.createDataFrame(rows, f"label string, k int, {rep} int, {name} double")


def prediction_strength(df: DataFrame, columns, ks, splits: int = 20) -> DataFrame:
    """``label, k, split, strength``: the weakest test cluster's share of pairs that a clustering of the other half keeps."""
    groups, units = _units(df, columns, "half")
    units = units.persist()
    try:
        near, far = (kmeans.fit(units, kmeans.Half(len(groups), other), splits, ks) for other in (False, True))
        told = kmeans.tables(units, kmeans.Half(len(groups), False), splits, ks, near, far)
    finally:
        units.unpersist()
    return _long(df.sparkSession, groups, {key: kmeans.strength(t) for key, t in told.items()}, "strength", "split")


def cluster_stability(df: DataFrame, columns, ks, reps: int) -> DataFrame:
    """``label, k, rep, ari``: each bootstrap replicate's clustering against the main one, over the units it draws."""
    groups, units = _units(df, columns, "boot")
    units = units.persist()
    try:
        main = kmeans.fit(units, kmeans.Whole(len(groups)), 1, ks, passes=30)
        boot = kmeans.fit(units, Poisson(len(groups)), reps, ks)
        told = kmeans.tables(units, Poisson(len(groups)), reps, ks, main, boot)
    finally:
        units.unpersist()
    return _long(df.sparkSession, groups, {key: kmeans.rand_index(t) for key, t in told.items()}, "ari", "rep")


def main_sizes(df: DataFrame, columns, ks) -> DataFrame:
    """``label, k, smallest``: the smallest cluster of each main clustering."""
    groups, units = _units(df, columns, "boot")
    units = units.persist()
    try:
        main = kmeans.fit(units, kmeans.Whole(len(groups)), 1, ks, passes=30)
        told = kmeans.tables(units, kmeans.Whole(len(groups)), 1, ks, main, main)
    finally:
        units.unpersist()
    return _long(df.sparkSession, groups, {key: t.sum(axis=2).min(axis=1) for key, t in told.items()}, "smallest", "one_").drop("one_")


def consensus(assign: DataFrame, label: str = "main") -> DataFrame:
    """Mean share of replicates in which two units of a cluster (within) or of two (between) fall together.

    Pairs are counted from contingency tables, so none is listed: pairs together and pairs present per replicate.
    """
    cells = assign.groupBy("rep", label, "cluster").agg(F.count("*").cast("double").alias("n"))
    within = cells.groupBy("rep", label).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("together"), (F.sum("n") * (F.sum("n") - 1) / 2).alias("present"))
    of_cluster = cells.groupBy("rep", "cluster").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("x"))
    sizes = cells.groupBy("rep", label).agg(F.sum("n").alias("n")).groupBy("rep").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("all_"))
    between = of_cluster.groupBy("rep").agg(F.sum("x").alias("x")).join(sizes, "rep").agg((F.sum("x") / F.sum("all_")).alias("value")).select(F.lit("between").alias("kind"), "value")
    return within.agg((F.sum("together") / F.sum("present")).alias("value")).select(F.lit("within").alias("kind"), "value").unionByName(between)


def stability_gate(metrics: DataFrame, least_ari: float = 0.6, least_p10: float = 0.4, least_size: int = 3) -> DataFrame:
    """Which ``k`` pass the joint gate, and the choice: the smallest that passes, else the best ARI as exploratory."""
    ok = (F.col("ari_median") >= least_ari) & (F.col("ari_p10") >= least_p10) & (F.col("smallest") >= least_size)
    rn = F.row_number().over(Window.partitionBy("label").orderBy(F.when(ok, 0).otherwise(1), F.when(ok, F.col("k").cast("double")).otherwise(-F.col("ari_median")), "k"))
    return metrics.withColumns({"passes": ok, "position": rn}).select("label", "k", "passes", (F.col("position") == 1).alias("chosen"), F.when(F.col("position") == 1, F.when(F.col("passes"), "stable").otherwise("exploratory")).alias("status"))


def profiles(df: DataFrame, parts, by) -> DataFrame:
    """Per cluster and part: geometric-mean centre closed to 100, median, quartiles, units."""
    by = list(by)
    df = df.select(*by, *[F.col(p).cast("double").alias(p) for p in parts]).persist()
    try:
        told = select(df, parts, by, [0.5, 0.25, 0.75], cached=True)
        means = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.exp(F.avg(F.log(p))).alias(p) for p in parts]).collect()
    finally:
        df.unpersist()
    rows = []
    for r in means:
        level = tuple(r[b] for b in by)
        whole = sum(r[p] or 0.0 for p in parts)
        rows += [(*level, p, *told[level][p][1], r["n"], None if r[p] is None else r[p] / whole * 100) for p in parts]
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "part string, median double, q25 double, q75 double, n long, center double"])
    return df.sparkSession.createDataFrame(rows, schema)
