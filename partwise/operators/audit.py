"""Audits of parts and keys, ranks, folds, curves and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import total
from ..sources.shared import materialise
from . import ranks
from .selection import select


def unpivot(df: DataFrame, keys, parts) -> DataFrame:
    """``keys, part, value`` with nulls."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("value")) for p in parts])).alias("c")).select(*keys, "c.part", "c.value")


def part_audit(df: DataFrame, parts) -> DataFrame:
    """Per part: rows, observed, missing, rate, explicit zeros, least positive, quartiles, largest."""
    told = select(df, parts, [], [0.25, 0.5, 0.75]).get((), {p: (0, [None] * 3) for p in parts})
    quartiles = df.sparkSession.createDataFrame([(p, *own[1]) for p, own in told.items()], "part string, q25 double, median double, q75 double")
    by = unpivot(df, [], parts).groupBy("part").agg(
        F.count("*").alias("n"), F.count("value").alias("observed"), (F.count("*") - F.count("value")).alias("missing"), (1 - F.count("value") / F.count("*")).alias("missing_rate"),
        F.count(F.when(F.col("value") == 0, 1)).alias("explicit_zero"), F.min(F.when(F.col("value") > 0, F.col("value"))).alias("min_positive"), F.max("value").alias("max"),
    )
    return by.join(F.broadcast(quartiles), "part").select("part", "n", "observed", "missing", "missing_rate", "explicit_zero", "min_positive", "q25", "median", "q75", "max")


def imputation_rationale(df: DataFrame, parts, group: str) -> DataFrame:
    """Per group and part: rows, missing, median, median absolute deviation, range of medians between groups."""
    told = select(df, parts, [group], [0.5])
    kind = dict(df.dtypes)[group]
    rows = [(level, p, own[p][1][0]) for (level,), own in told.items() for p in parts]
    medians = df.sparkSession.createDataFrame(rows, f"{group} {kind}, part string, median double")
    wide = df.sparkSession.createDataFrame([(level, *[own[p][1][0] for p in parts]) for (level,), own in told.items()], ", ".join([f"{group} {kind}", *[f"m_{p} double" for p in parts]]))
    gaps = ranks.joined_back(df.select(group, *parts), F.broadcast(wide), [group], [f"m_{p}" for p in parts]).select(group, *[F.abs(F.col(p) - F.col(f"m_{p}")).alias(p) for p in parts])
    mads = [(level, p, own[p][1][0]) for (level,), own in select(gaps, parts, [group], [0.5]).items() for p in parts]
    mad = df.sparkSession.createDataFrame(mads, f"{group} {kind}, part string, mad double")
    by = unpivot(df, [group], parts).groupBy(group, "part").agg(F.count("*").alias("n"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing"))
    spread = medians.groupBy("part").agg((F.max("median") - F.min("median")).alias("median_range"))
    out = ranks.joined_back(ranks.joined_back(by, F.broadcast(medians), [group, "part"], ["median"]), F.broadcast(mad), [group, "part"], ["mad"])
    return out.join(spread, "part")


def repeat_audit(df: DataFrame, key: str = "unit_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_points"), (F.count("*") > 1).alias("multiple"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts and row shares of all pairs of levels, zeros included (levels are few)."""
    seen = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, columns = seen.groupBy("a").agg(F.sum("n").alias("row_n")), seen.groupBy("b").agg(F.sum("n").alias("column_n"))
    grid = rows.withColumn("k_", F.lit(1)).join(columns.withColumn("k_", F.lit(1)), "k_").drop("k_")
    whole = F.sum("row_n").over(Window.partitionBy("b"))
    full = grid.withColumn("total_n", whole).join(seen, ["a", "b"], "left").withColumn("observed", F.coalesce("n", F.lit(0)))
    return full.select("a", "b", "observed", (F.col("row_n") * F.col("column_n") / F.col("total_n")).alias("expected"), (F.col("observed") / F.col("row_n")).alias("row_share"), "row_n", "column_n", "total_n")


def key_validation(points: DataFrame, units: DataFrame, key: str = "unit_id", point: str = "point_id") -> DataFrame:
    """One row: counts, uniqueness of both keys, points with a unit, valid points and their units."""
    u = units.select(F.col(key).alias("u_"), F.lit(1).alias("has_"))
    joined = points.join(u, F.col(key) == F.col("u_"), "left")
    told = joined.agg(F.count("*").alias("n_points"), F.countDistinct(point).alias("n_point_keys"), F.sum(F.coalesce("has_", F.lit(0))).alias("n_matched"), F.countDistinct(key).alias("n_units_used"), F.sum(F.col("valid").cast("int")).alias("n_valid"), F.countDistinct(F.when(F.col("valid"), F.col(key))).alias("n_valid_units"))
    have = units.agg(F.count("*").alias("n_units"), (F.count("*") == F.countDistinct(key)).alias("unit_key_unique"))
    return told.withColumn("k_", F.lit(1)).join(have.withColumn("k_", F.lit(1)), "k_").drop("k_")


def detection_nodes(df: DataFrame, parts, group: str, least: float = 0.3, min_obs: int = 5) -> DataFrame:
    """Per group and part: detection rate (zeros are detected), whether it is a node, and why not."""
    by = unpivot(df, [group], parts).groupBy(group, "part").agg(F.count("value").alias("observed"), (F.count("value") / F.count("*")).alias("rate"))
    reason = F.when(F.col("observed") < min_obs, f"lt{min_obs}_observed").when(F.col("rate") < least, f"detection_rate_lt_{least:.2f}")
    return by.withColumn("reason", reason).withColumn("node", F.col("reason").isNull())


def unit_state(df: DataFrame, key: str = "unit_id") -> DataFrame:
    """The state that half or more of a unit's points have: W from a share of one half."""
    return df.groupBy(key).agg(F.avg((F.col("state") == "W").cast("int")).alias("share"), F.when(F.avg((F.col("state") == "W").cast("int")) >= 0.5, "W").otherwise("U").alias("majority_state"))


def mode_config(configs: DataFrame, by: str, config: str, order: str) -> DataFrame:
    """The most frequent configuration of each ``by``; of equals, the one seen first."""
    counts = configs.groupBy(by, config).agg(F.count("*").alias("n"), F.min(order).alias("first_"))
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first_"))
    return counts.withColumn("rn_", rn).where("rn_ = 1").select(by, config, "n")


def feature_stability(coefs: DataFrame, by=("feature",)) -> DataFrame:
    """Selection share, sign frequency and median size of coefficients over replicates."""
    up, down = F.avg((F.col("coef") >= 0).cast("int")), F.avg((F.col("coef") <= 0).cast("int"))
    return coefs.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.abs("coef") > 1e-10).cast("int")).alias("selected"), F.greatest(up, down).alias("sign_frequency"), F.percentile(F.abs("coef"), 0.5).alias("median_abs"))


def median_ratio(df: DataFrame, parts, by: str) -> DataFrame:
    """Median of state W over median of state U per part; null if the latter is 0."""
    told = select(df, parts, [by, "state"], [0.5])
    of = lambda level, s, p: told[level, s][p][1][0] if (level, s) in told else None
    rows = [(level, p, of(level, "W", p), of(level, "U", p)) for level in sorted({k[0] for k in told}, key=str) for p in parts]
    table = df.sparkSession.createDataFrame(rows, f"{by} {dict(df.dtypes)[by]}, part string, median_w double, median_u double")
    return table.withColumn("ratio", F.when(F.col("median_u") != 0, F.col("median_w") / F.col("median_u")))


def bh_fdr(df: DataFrame, p: str, by, out: str = "p_fdr", tie: str | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted values within a family; null or non-finite ones stay null.

    Equal values are one row with the rank of their last, so ``tie`` changes nothing; the least value from a rank on is the least of the ranges after
    it and of its own, so a family may span tasks.  Rows are written once, as in ``avg_rank``.
    """
    fine = F.col(p).isNotNull() & ~F.isnan(p)
    df = materialise(df, "family")
    told = ranks.value_counts(df.where(fine), p, by)
    size = ranks.joined_back(told, told.groupBy(*by).agg(F.sum("n").alias("size_")), by, ["size_"], "inner")
    least = ranks.running_least(size.withColumn("raw_", F.col(p) * F.col("size_") / (F.col("below_n") + F.col("n"))), by, [F.desc(p)], "raw_")
    told = least.select(*by, p, F.least(F.lit(1.0), "least_raw_").alias(out))
    return ranks.joined_back(df, told, [*by, p], [out])


def bh_fdr_few(df: DataFrame, p: str, by, tie: str, out: str = "p_fdr") -> DataFrame:
    """The same in one window, for families that hold a row per part or pair of parts, whose number the parts bound."""
    fine = F.col(p).isNotNull() & ~F.isnan(p)
    family = Window.partitionBy(*by, fine)
    order = family.orderBy(p, tie)
    raw = F.col(p) * F.count("*").over(family) / F.row_number().over(order)
    df = df.withColumn("raw_", F.when(fine, raw))
    back = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(out, F.when(fine, F.least(F.lit(1.0), F.min("raw_").over(back)))).drop("raw_")


def avg_rank(df: DataFrame, column: str, by, out: str = "rank") -> DataFrame:
    """Ranks from 1, equal values sharing their mean.

    Rows are written once: ranks join back by value, and a mean that is evaluated again may differ in its last bit.
    """
    df = materialise(df, "ranked")
    told = ranks.value_counts(df, column, by)
    return ranks.joined_back(df, told.withColumn(out, F.col("below_n") + (F.col("n") + 1) / 2), [*by, column], [out])


def tune_threshold(scored: DataFrame, by=()) -> DataFrame:
    """The threshold (0.20 to 0.80) of the best balanced accuracy; of equals, that nearest to one half.

    Scores fall into 62 bins first, so every row is counted once instead of once per threshold.
    """
    bins = scored.groupBy(*by, F.least(F.greatest(F.floor(F.col("score") * 100 + 1e-9), F.lit(19)), F.lit(80)).cast("int").alias("bin")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    cut = bins.withColumn("t", F.explode(F.sequence(F.lit(20), F.lit(80))))
    sums = cut.groupBy(*by, "t").agg(F.sum(F.when(F.col("bin") >= F.col("t"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("bin") < F.col("t"), F.col("n")).otherwise(0)).alias("tn"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = sums.withColumn("balanced_accuracy", F.round((F.col("tp") / F.col("p") + F.col("tn") / F.col("n")) / 2, 9))
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("balanced_accuracy"), F.abs(F.col("t") - 50), "t"))
    return sums.withColumn("rn_", rn).where("rn_ = 1").select(*by, (F.col("t") / 100).alias("threshold"), "balanced_accuracy")


def roc(scored: DataFrame, by: str) -> DataFrame:
    """Cumulative true and false positives by falling score; equal scores are one point."""
    points = scored.groupBy(by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    told = ranks.running_totals(points, [by], [F.desc("score")], ["p", "n"])
    return told.select(by, "score", (F.col("below_p") + F.col("p")).alias("tp"), (F.col("below_n") + F.col("n")).alias("fp"))


def auc(scored: DataFrame, by) -> DataFrame:
    """Area under the curve by the rank sum of positives."""
    told = ranks.value_counts(scored, "score", by, p=F.col("y"))
    ranked = told.withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return sums.select(*by, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def calibration_curve(scored: DataFrame, bins: int = 8) -> DataFrame:
    """Quantile bins of the score: mean prediction against observed rate."""
    edges = scored.agg(F.percentile("score", F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0] or []
    bin_ = total([(F.col("score") > e).cast("int") for e in edges] or [F.lit(0)])
    return scored.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("y").alias("rate"))


def assignment_freq(assign: DataFrame, key: str = "unit_id", label: str = "cluster") -> DataFrame:
    """Shares of a unit's first and second most frequent label, and whether it is near a boundary."""
    counts = assign.groupBy(key, label).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), label))
    two = counts.withColumns({"share": share, "rn": rn}).where("rn <= 2").groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col("share"))).alias("top1"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("share"))), F.lit(0.0)).alias("top2"))
    return two.withColumn("boundary", (F.col("top1") < 0.8) | (F.col("top1") - F.col("top2") < 0.2))


def rank_configs(scores: DataFrame, by, order) -> DataFrame:
    return scores.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_changes(df: DataFrame, n: int, by, change: str, tie: str) -> DataFrame:
    """The ``n`` rows of each group with the largest absolute change."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(change)), tie))
    return df.withColumn("position", rn).where(F.col("position") <= n)


def set_jaccard(a: DataFrame, b: DataFrame, keys, by) -> DataFrame:
    """Jaccard similarity of two sets of keys per group; two empty sets are equal."""
    x, y = a.select(*by, *keys).distinct().withColumn("x_", F.lit(1)), b.select(*by, *keys).distinct().withColumn("y_", F.lit(1))
    both = x.join(y, [*by, *keys], "full").groupBy(*by).agg(F.count(F.col("x_") + F.col("y_")).alias("shared"), F.count("*").alias("all"))
    return both.withColumn("jaccard", F.when(F.col("all") == 0, 1.0).otherwise(F.col("shared") / F.col("all")))


def common_nodes(nodes: DataFrame, group: str, part: str = "part") -> DataFrame:
    """Pairs ``j < k`` of the parts that are nodes in every group."""
    n = nodes.select(group).distinct().count()
    common = nodes.where("node").groupBy(part).agg(F.countDistinct(group).alias("n")).where(F.col("n") == n).select(part)
    return common.select(F.col(part).alias("part_j")).join(common.select(F.col(part).alias("part_k")), F.col("part_j") < F.col("part_k"))
