"""Imputation, zero replacement, closure and log-ratio coordinates."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import combine, helmert, total, uniform
from ..sources.shared import materialise
from .nearest import nearest_shared
from .ranks import joined_back, quantiles, running_totals
from .resample import folded, replicate_medians
from .selection import select

#: Sets of parameters (keys of a fit) that are broadcast at most; each is a few numbers a part.
MOST_KEYS = 20_000


@dataclass(frozen=True)
class Prep:
    """Fitted parameters: a few numbers per group and part, so they are literals of the transforming projection."""

    group: str
    parts: tuple[str, ...]
    medians: dict[str, dict[str, float]]
    counts: dict[str, dict[str, int]]
    global_medians: dict[str, float]
    min_obs: int = 5
    delta: dict[str, float] = field(default_factory=dict)

    def level(self, group: str, part: str) -> str:
        return "group" if self.counts[group][part] >= self.min_obs else "global"

    def value(self, group: str, part: str) -> float:
        return self.medians[group][part] if self.level(group, part) == "group" else self.global_medians[part]


def fit_prep(df: DataFrame, parts, group: str, min_obs: int = 5, zero_c: float = 0.5, fixed_active=None, accuracy: int | None = None) -> Prep:
    """Medians by group with the global one where a group has too few values, and the zero replacement of each part.

    Active parts have ``min_obs`` values.  The zero replacement is ``zero_c`` times the least positive value after
    filling, over all groups.  Medians are exact (see ``selection``), or with ``accuracy`` those of one sketch.
    """
    df = df.select(group, *parts).persist()
    try:
        if accuracy is None:
            over = select(df, parts, [], [0.5], cached=True).get((), {p: (0, [None]) for p in parts})
            by = select(df, parts, [group], [0.5], cached=True)
        else:
            stats = [x for p in parts for x in (F.percentile_approx(p, 0.5, accuracy).alias(f"m_{p}"), F.count(p).alias(f"n_{p}"))]
            read = lambda r: {p: (r[f"n_{p}"], [r[f"m_{p}"]]) for p in parts}
            over, by = read(df.agg(*stats).first()), {(r[group],): read(r) for r in df.groupBy(group).agg(*stats).collect()}
        active = tuple(fixed_active or [p for p in parts if over[p][0] >= min_obs])
        if len(active) < 2:
            raise ValueError("fewer than two active parts")
        named = {str(g): told for (g,), told in sorted(by.items(), key=lambda x: str(x[0]))}
        prep = Prep(group, active, {g: {p: t[p][1][0] for p in active} for g, t in named.items()}, {g: {p: t[p][0] for p in active} for g, t in named.items()}, {p: over[p][1][0] for p in active}, min_obs)
        low = fill(df, prep).agg(*[F.min(F.when(F.col(p) > 0, F.col(p))).alias(p) for p in active]).first()
    finally:
        df.unpersist()
    if any(low[p] is None for p in active):
        raise ValueError("a part has no positive value")
    prep.delta.update({p: zero_c * low[p] for p in active})
    return prep


def fill(df: DataFrame, prep: Prep) -> DataFrame:
    """Nulls as the group's median; ``fallback_*`` tells that the value is not one."""
    new = {}
    for p in prep.parts:
        value, other = F.lit(prep.global_medians[p]), F.lit(True)
        for g in prep.medians:
            mine = F.col(prep.group) == g
            value, other = F.when(mine, prep.value(g, p)).otherwise(value), F.when(mine, prep.level(g, p) != "group").otherwise(other)
        new |= {p: F.coalesce(F.col(p), value), f"fallback_{p}": F.col(p).isNull() & other}
    return df.withColumns(new)


def zero_replace(df: DataFrame, prep: Prep) -> DataFrame:
    fine = lambda p: F.when(F.col(p) < 0, F.raise_error(F.lit(f"negative {p}")).cast("double")).when(F.col(p) == 0, prep.delta[p]).otherwise(F.col(p))
    return df.withColumns({p: fine(p) for p in prep.parts})


def closure(df: DataFrame, parts) -> DataFrame:
    """Parts that sum to 100, and ``closure_error``."""
    df = df.withColumn("sum_", total([F.col(p) for p in parts])).withColumns({p: F.col(p) / F.col("sum_") * 100 for p in parts}).drop("sum_")
    return df.withColumn("closure_error", F.abs(total([F.col(p) for p in parts]) - 100))


def clr(df: DataFrame, parts) -> DataFrame:
    """``clr_*``: log parts less their mean."""
    df = df.withColumn("mean_", total([F.log(p) for p in parts]) / len(parts))
    return df.withColumns({f"clr_{p}": F.log(p) - F.col("mean_") for p in parts}).drop("mean_")


def ilr(df: DataFrame, parts, prefix: str = "ilr_") -> DataFrame:
    """``ilr_1 ...``: coordinates in the Helmert basis."""
    logs = [F.log(p) for p in parts]
    return df.withColumns({f"{prefix}{i}": combine(row, logs) for i, row in enumerate(helmert(len(parts)), 1)})


def inverse_ilr(df: DataFrame, coordinates, parts, prefix: str = "") -> DataFrame:
    """Parts that sum to 100 from coordinates; the largest exponent is taken out first.

    Exponents are an array, as one expression a part made a method too large for the JVM to compile.
    """
    basis = helmert(len(parts))
    z = [c if isinstance(c, Column) else F.col(c) for c in coordinates]
    df = df.withColumn("e_", F.array(*[combine([row[k] for row in basis], z) for k, _ in enumerate(parts)]))
    df = df.withColumn("top_", F.array_max("e_")).withColumn("e_", F.transform("e_", lambda e: F.exp(e - F.col("top_"))))
    df = df.withColumn("sum_", F.aggregate("e_", F.lit(0.0), lambda a, e: a + e))
    return df.withColumns({f"{prefix}{p}": F.col("e_")[k] / F.col("sum_") * 100 for k, p in enumerate(parts)}).drop("top_", "sum_", "e_")


def transform(df: DataFrame, prep: Prep) -> DataFrame:
    """Filled, replaced, closed parts with clr and ilr coordinates: one projection, no shuffle."""
    return ilr(clr(closure(zero_replace(fill(df, prep), prep), prep.parts), prep.parts), prep.parts)


def balances(df: DataFrame, library: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """A column for each balance (numerator, denominator); null if a side has no part among the columns."""
    out = {}
    for name, sides in library.items():
        num, den = ([p for p in side if p in df.columns] for side in sides)
        mean = lambda ps: total([F.log(p) for p in ps]) / len(ps)
        out[name] = math.sqrt(len(num) * len(den) / (len(num) + len(den))) * (mean(num) - mean(den)) if num and den else F.lit(None).cast("double")
    return df.withColumns(out)


def prepare_by(df: DataFrame, keys, parts, zero_c: float = 0.5, weight: str | None = None) -> DataFrame:
    """Filled, replaced and closed parts with each set of keys fitted by itself (a label, or replicate and label).

    ``weight`` is a whole number of copies of each row: medians take it as a frequency, so that a bootstrap
    replicate is fitted without copying rows.  Parameters are a row a key, of a checked number, and join back as a
    broadcast: the points are not shuffled.  A null key is a key of its own.
    """
    keys = list(keys)
    if weight is None:
        told = select(df, parts, keys, [0.5])
        kinds = ", ".join([*[f"{k} {dict(df.dtypes)[k]}" for k in keys], *[f"m_{p} double" for p in parts]])
        medians = F.broadcast(df.sparkSession.createDataFrame([(*level, *[own[p][1][0] for p in parts]) for level, own in told.items()], kinds))
    else:
        medians = few_rows(df.groupBy(*keys).agg(*[F.percentile(p, 0.5, F.col(weight)).alias(f"m_{p}") for p in parts]))
    filled = joined_back(df, medians, keys, [f"m_{p}" for p in parts]).withColumns({p: F.coalesce(F.col(p), F.col(f"m_{p}")) for p in parts}).drop(*[f"m_{p}" for p in parts])
    deltas = few_rows(filled.groupBy(*keys).agg(*[(zero_c * F.min(F.when(F.col(p) > 0, F.col(p)))).alias(f"d_{p}") for p in parts]))
    replaced = joined_back(filled, deltas, keys, [f"d_{p}" for p in parts]).withColumns({p: F.when(F.col(p) == 0, F.col(f"d_{p}")).otherwise(F.col(p)) for p in parts}).drop(*[f"d_{p}" for p in parts])
    return closure(replaced, parts)


def few_rows(df: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """A table of parameters for broadcast joins: read at once, and an error if it has more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sets of parameters")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def aitchison_center(df: DataFrame, parts, by) -> DataFrame:
    """Geometric means of a set's parts, closed again."""
    out = df.groupBy(*by).agg(*[F.exp(F.avg(F.log(p))).alias(p) for p in parts])
    return closure(out, parts).drop("closure_error")


def unit_centers(df: DataFrame, parts, key: str = "unit_id", carry=("label",), keys=()) -> DataFrame:
    """Mean ilr of each unit's points and its composition, with the number of points."""
    n = len(parts) - 1
    by = [*keys, key]
    means = df.groupBy(*by).agg(F.count("*").alias("n_points"), *[F.min(c).alias(c) for c in carry], *[F.avg(f"ilr_{i}").alias(f"ilr_{i}") for i in range(1, n + 1)])
    return inverse_ilr(means, [f"ilr_{i}" for i in range(1, n + 1)], parts)


def parameter_table(spark, prep: Prep) -> DataFrame:
    """Fitted parameters as rows: group, part, observations, median, level, zero replacement."""
    rows = [(g, p, prep.counts[g][p], prep.value(g, p), prep.level(g, p), prep.delta[p]) for g in prep.medians for p in prep.parts]
    return spark.createDataFrame(rows, "group_name string, part string, n_observed long, median_value double, fallback_level string, delta double")


def prep_audit(df: DataFrame, parts) -> DataFrame:
    """One row: rows, rows that do not close to 100, coordinates that are not finite."""
    bad = total([(F.isnan(f"ilr_{i}") | F.col(f"ilr_{i}").isNull() | (F.abs(f"ilr_{i}") == float("inf"))).cast("int") for i in range(1, len(parts))])
    return df.agg(F.count("*").alias("n_rows"), F.sum((F.col("closure_error") > 1e-8).cast("long")).alias("not_closed"), F.sum(bad).alias("not_finite"))


def knn_impute(df: DataFrame, donors: DataFrame, parts, k: int = 5, key: str = "point_id") -> DataFrame:
    """``key, part, value`` for each null part: the mean of the ``k`` nearest donors that have it, at least 0.

    Distances are Euclidean over parts that both have, scaled up to all parts, after standardising by the donors
    (population deviation, 0 counts as 1).  All donors are searched, exactly, in ranges of the parts that both have.
    """
    s = donors.agg(*[x for p in parts for x in (F.avg(p).alias(f"a_{p}"), F.stddev_pop(p).alias(f"s_{p}"))]).first()
    z = lambda p: (F.col(p) - (s[f"a_{p}"] or 0.0)) / (s[f"s_{p}"] or 1.0)
    left = df.where(" or ".join(f"{p} is null" for p in parts)).select(key, *[z(p).alias(p) for p in parts])
    right = donors.select(F.col(key).alias("donor_id"), *[z(p).alias(p) for p in parts], F.array(*[F.col(p) for p in parts]).alias("raw"))
    return nearest_shared(left, right, parts, k, key).groupBy(key, "part").agg(F.greatest(F.avg("value"), F.lit(0.0)).alias("value"))


def hidden_cells(cells: DataFrame, reps: int, share: float, key: str) -> DataFrame:
    """``key, part, mask``: bit r says that the cell is hidden in repeat r.

    Of each part with ten observed positive cells or more, ``max(1, round(share n))`` of them are hidden, those of the
    smallest hashes.  Hashes are uniform, so only those near the expected place are ranked, by ranges in many tasks.
    """
    sizes = {r["part"]: r["n"] for r in cells.where("value > 0").groupBy("part").agg(F.count("*").alias("n")).collect() if r["n"] >= 10}
    if not sizes:
        return cells.select(key, "part", F.lit(0).cast("long").alias("mask")).limit(0)
    wanted = {p: max(1, math.floor(n * share + 0.5)) for p, n in sizes.items()}
    of = lambda values: F.create_map(*[x for p, v in values.items() for x in (F.lit(p), F.lit(v))])[F.col("part")]
    limit = of({p: (wanted[p] + 10 * math.sqrt(wanted[p]) + 10) / n for p, n in sizes.items()})
    some = cells.where((F.col("value") > 0) & F.col("part").isin(*sizes)).select(key, "part", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    near = some.withColumn("u", uniform(F.lit("mask"), "rep", "part", key)).where(F.col("u") <= limit)
    ranked = running_totals(near.withColumn("one", F.lit(1)), ["rep", "part"], ["u", key], ["one"]).where(F.col("below_one") < of(wanted))
    return ranked.groupBy(key, "part").agg(F.sum(F.expr("shiftleft(1L, rep)")).alias("mask"))


class _Seen:
    """Weights of the cells that a repeat does not hide: the first word is the cell's mask."""

    groups = 1

    def __call__(self, g, a, b, reps):
        yield 0, np.arange(len(a)), ((a[:, None] >> reps[None, :]) & 1 == 0).astype(float)


def _seen_sums(cells: DataFrame, names, codes, lows, reps: int) -> dict[int, np.ndarray]:
    """Of every (group, part) and repeat, over the cells that it does not hide: number, number below ``lows``, and sum."""

    def add(batches):
        out = np.zeros((len(codes), reps, 3))
        for batch in batches:
            for at in range(0, len(batch), 1 << 14):
                part, group, value, mask = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, 1 << 14).columns)
                seen = ((mask.astype(np.int64)[:, None] >> np.arange(reps)) & 1 == 0).astype(float)
                for i, (g, p) in enumerate(codes):
                    rows = np.flatnonzero((part == p) & ((group == g) if g is not None else True))
                    out[i] += seen[rows].T @ np.column_stack([np.ones(len(rows)), value[rows] < lows[i], value[rows]])
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(codes)), pa.int32()), "x": pa.array([v.tobytes() for v in out], pa.binary())})

    return {r["k"]: np.frombuffer(bytes(r["x"])).reshape(reps, 3) for r in folded(cells.mapInArrow(add, "k int, x binary"), ["k"]).collect()}


def mask_validation(df: DataFrame, parts, group: str, reps: int = 20, share: float = 0.1, key: str = "point_id", min_obs: int = 5) -> DataFrame:
    """Errors of imputation methods on hidden cells: ``rep, part, method, n, mae, rmse, median_ae``.

    In each repeat (62 at most) a share of a part's observed positive cells is hidden (see ``hidden_cells``) and predicted
    from the others: global mean, global median, zero and group median, which is the global one in groups with fewer than
    ``min_obs`` cells left.  Cells are not copied by repeat: a word tells in which they are hidden, medians come from a
    narrow band of values under all repeats' weights, the rest is counted.
    """
    parts = list(parts)
    if reps > 62:
        raise ValueError("a word holds 62 repeats")
    cells = df.select(key, group, F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("value")) for p in parts])).alias("c")).select(key, group, "c.part", "c.value").where("value is not null")
    hidden = hidden_cells(cells, reps, share, key)
    cells = joined_back(cells, hidden, [key, "part"], ["mask"]).withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))).persist()
    try:
        groups = sorted(r[0] for r in cells.select(group).distinct().limit(MOST_KEYS + 1).collect() if r[0] is not None)
        if len(groups) > 256:
            raise ValueError("more than 256 groups")
        names = [(g, p) for g in [None, *groups] for p in parts]
        mine = {(g, p): (F.col("part") == p) & (F.lit(True) if g is None else F.col(group).eqNullSafe(g)) for g, p in names}
        number = lambda c, values: F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for i, v in enumerate(values)], F.lit(-1)).alias(f"{c}_")
        base = cells.agg(*[x for i, k in enumerate(names) for x in (F.count_if(mine[k]).alias(f"n_{i}"), F.count_if(mine[k] & (F.col("value") > 0)).alias(f"p_{i}"))]).first()
        for reach in (8.0, 32.0, 128.0, None):
            spots = []
            for i, _ in enumerate(names):
                n, positive = base[f"n_{i}"], max(1, base[f"p_{i}"])
                h, zeros = share * positive, n - base[f"p_{i}"]
                left = (n - h) / 2
                place = left if left <= zeros else zeros + (left - zeros) / (1 - share)
                half = n if reach is None else reach * math.sqrt(h + 1) + 10
                spots.append([min(max(v / max(n, 1), 0.0), 1.0) for v in (place - half, place + half)])
            found = cells.agg(*[F.percentile_approx(F.when(mine[k], F.col("value")), F.array(*map(F.lit, spots[i])), 10_000).alias(f"q_{i}") for i, k in enumerate(names)]).first()
            ends = [(found[f"q_{i}"] or (0.0, 0.0)) for i in range(len(names))]
            ends = [(-1.7e308 if spots[i][0] <= 0 else e[0], 1.7e308 if spots[i][1] >= 1 else e[1]) for i, e in enumerate(ends)]
            told = _seen_sums(cells.select(number("part", parts), number(group, groups), "value", "mask"), names, [(groups.index(g) if g is not None else None, parts.index(p)) for g, p in names], [e[0] for e in ends], reps)
            total, below, sums = (np.stack([told[i][:, j] for i in range(len(names))], axis=1)[None] for j in range(3))
            near = F.array_compact(F.array(*[F.when(mine[k] & F.col("value").between(*ends[i]), F.lit(i)) for i, k in enumerate(names)]))
            rows = cells.select("mask", "value", F.explode(near).alias("part_")).select(F.lit(0).alias("s_"), F.lit(0).alias("g_"), F.col("mask").alias("a_"), F.lit(0).cast("long").alias("b_"), "part_", "value")
            medians = replicate_medians(rows, _Seen(), reps, below, total)
            if not (np.isnan(medians) & (total > 0)).any():
                break
        middle, total, sums = medians[0], total[0], sums[0]
        whole = {p: names.index((None, p)) for p in parts}
        table = []
        for r in range(reps):
            for p in parts:
                i = whole[p]
                if total[r, i]:
                    table += [(r, g, p, float(sums[r, i] / total[r, i]), float(middle[r, i]), float(middle[r, j] if total[r, j] >= min_obs else middle[r, i])) for g in groups for j in [names.index((g, p))]]
                    table.append((r, None, p, float(sums[r, i] / total[r, i]), float(middle[r, i]), float(middle[r, i])))
        kind = dict(df.dtypes)[group]
        known = df.sparkSession.createDataFrame(table, f"rep int, {group} {kind}, part string, mean double, median double, own double")
        each = cells.where("mask <> 0").select(group, "part", "value", "mask", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).where(F.expr("shiftright(mask, rep) & 1 = 1"))
        errors = joined_back(each, F.broadcast(known), ["rep", group, "part"], ["mean", "median", "own"], "inner")
        methods = {"global_mean": F.col("mean"), "global_median": F.col("median"), "zero": F.lit(0.0), "group_median": F.col("own")}
        long = errors.select("rep", "part", "value", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), e.alias("estimate")) for m, e in methods.items()])).alias("m")).select("rep", "part", "m.method", (F.col("m.estimate") - F.col("value")).alias("error"))
        by = ["rep", "part", "method"]
        means = long.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
        middle_ = quantiles(long.select(*by, F.abs("error").alias("e")), "e", by, {"median_ae": 0.5})
        return materialise(means.join(middle_, by).select(*by, "n", "mae", "rmse", "median_ae"), "masked")
    finally:
        cells.unpersist()


def mask_summary(detail: DataFrame, base: str = "group_median") -> DataFrame:
    """By method: mean error, its 2.5 and 97.5 per cent quantiles, and the difference from the ``base`` method."""
    by = detail.groupBy("method").agg(F.avg("mae").alias("mean_mae"), F.percentile("mae", 0.025).alias("mae_low"), F.percentile("mae", 0.975).alias("mae_high"))
    ref = by.where(F.col("method") == base).select(F.col("mean_mae").alias("base_"), F.lit(1).alias("one_"))
    return by.withColumn("one_", F.lit(1)).join(ref, "one_").withColumn("delta", F.col("mean_mae") - F.col("base_")).drop("one_", "base_")


def logratio_pca(df: DataFrame, columns, k: int = 2):
    """First ``k`` principal axes of centred coordinates: rows of loadings, the largest of each positive.

    The library subtracts means itself, so no pass of ours does.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    model = PCA(k=k, inputCol="v", outputCol="s").fit(VectorAssembler(inputCols=list(columns), outputCol="v").transform(df.select(*columns)))
    axes = model.pc.toArray().T
    rows = []
    for i, axis in enumerate(axes):
        sign = 1.0 if axis[abs(axis).argmax()] > 0 else -1.0
        rows += [(i + 1, c, float(sign * w), float(model.explainedVariance[i])) for c, w in zip(columns, axis, strict=True)]
    return df.sparkSession.createDataFrame(rows, "axis int, coordinate string, loading double, explained double")
