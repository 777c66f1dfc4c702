"""Keys, states, validity, coding and joins of points and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import total, uniform
from .ranks import running_totals


def normalise_keys(df: DataFrame, source: str, target: str, width: int = 2) -> DataFrame:
    """Leading digits of a trimmed text, padded with zeros to ``width`` (longer ones stay whole); null if there are none."""
    digits = F.regexp_extract(F.trim(F.col(source)), r"^(\d+)", 1)
    return df.withColumn(target, F.when(digits != "", F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, failing at run time on the first row that breaks ``condition``."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def point_state(df: DataFrame, fresh: str = "unweathered point", severe: str = "severe", text: str = "priority", unit_state: str = "unit_state") -> DataFrame:
    """A point's own state where its text names one, else its unit's, and where it comes from."""
    says = F.col(text)
    return df.withColumns({
        "state": F.when(says.contains(fresh), "U").when(says.contains(severe), "W").otherwise(F.col(unit_state)),
        "state_source": F.when(says.contains(fresh), "point_unweathered").when(says.contains(severe), "point_severe").otherwise("unit"),
    })


def validity(df: DataFrame, parts, low: float, high: float) -> DataFrame:
    """Row total of the parts without nulls, whether it lies in ``[low, high]``, and why not."""
    df = df.withColumn("raw_sum", total([F.coalesce(F.col(p), F.lit(0.0)) for p in parts]))
    ok = F.col("raw_sum").between(low, high)
    return df.withColumns({"valid": ok, "exclusion_reason": F.when(ok, None).when(F.col("raw_sum") < low, f"sum_below_{low:g}").otherwise(f"sum_above_{high:g}")})


def cell_flags(df: DataFrame, parts) -> DataFrame:
    """``miss_*`` and ``zero_*`` as 0 or 1: nulls are missing, zeros are observed."""
    return df.withColumns({f"miss_{p}": F.col(p).isNull().cast("int") for p in parts} | {f"zero_{p}": F.coalesce(F.col(p) == 0, F.lit(False)).cast("int") for p in parts})


def valid_points(df: DataFrame, label: str | None = None, min_units: int = 5) -> DataFrame:
    """Valid points of a label, or none of a label in which a state has fewer than ``min_units`` units."""
    df = df.where("valid") if label is None else df.where(F.col("valid") & (F.col("label") == label))
    per = df.groupBy("label", "state").agg(F.countDistinct("unit_id").alias("n"))
    full = per.where(F.col("n") >= min_units).groupBy("label").agg(F.count("*").alias("states")).where("states = 2").select("label")
    return df.join(full, "label", "left_semi")


def unknown_level(df: DataFrame, column: str, complete: bool = False) -> DataFrame:
    """Nulls of a category as the level ``unknown``, or without their rows."""
    return df.where(F.col(column).isNotNull()) if complete else df.fillna("unknown", [column])


def merge_rare(df: DataFrame, column: str, min_n: int = 3) -> DataFrame:
    """Levels of fewer than ``min_n`` rows as ``other``."""
    counts = df.groupBy(column).agg(F.count("*").alias("n_"))
    rare = counts.where(F.col("n_") < min_n).select(F.col(column).alias("level_"), F.lit(True).alias("rare_"))
    return df.join(rare, F.col(column) == F.col("level_"), "left").withColumn(column, F.when(F.col("rare_"), "other").otherwise(F.col(column))).drop("level_", "rare_")


def encode_binary(df: DataFrame, column: str, levels: dict[str, int], target: str) -> DataFrame:
    out = F.lit(None).cast("int")
    for level, code in levels.items():
        out = F.when(F.col(column) == level, code).otherwise(out)
    return df.withColumn(target, out)


def dummy_code(df: DataFrame, column: str) -> DataFrame:
    """0/1 columns for all levels but the first in sorted order; an error beyond 1,000 levels, since they become columns."""
    levels = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(1001).collect())
    if len(levels) > 1000:
        raise ValueError(f"{column} has more than 1000 levels")
    return df.withColumns({f"{column}_{x.lower().replace(' ', '_')}": (F.col(column) == x).cast("int") for x in levels[1:]})


def perturb(df: DataFrame, parts, share: float, phase: int, key: str | None = None) -> DataFrame:
    """Observed positive parts times 1 plus or minus ``share``; the sign alternates by part, phase and key's hash."""
    shift = F.lit(0) if key is None else F.floor(uniform(F.lit("perturb"), key) * 2)
    sign = lambda k: F.when((F.lit(k + phase) + shift) % 2 == 0, 1.0).otherwise(-1.0)
    return df.withColumns({p: F.when(F.col(p) > 0, F.col(p) * (1 + share * sign(k))).otherwise(F.col(p)) for k, p in enumerate(parts)})


def join_units(points: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """Every point with its unit's attributes (many to one)."""
    return points.join(units, key, "left")


def join_check(points: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """One row: keys that repeat in ``units`` and points without a unit; both must be 0."""
    twice = units.groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated_keys"), F.lit(1).alias("one"))
    lost = points.join(units, key, "left_anti").agg(F.count("*").alias("unmatched_points"), F.lit(1).alias("one"))
    return twice.join(lost, "one").drop("one")


def semi_split(df: DataFrame, held: DataFrame, key: str = "unit_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose unit is not held out, and rows whose unit is."""
    held = held.select(key).distinct()
    return df.join(held, key, "left_anti"), df.join(held, key, "left_semi")


def unit_weights(df: DataFrame, key: str = "unit_id") -> DataFrame:
    """Each point weighs one over its unit's points, so each unit weighs one."""
    return df.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(key)))


def unit_rows(df: DataFrame, key: str = "unit_id", order: str = "point_id") -> DataFrame:
    """The first row of each unit in the order given."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("rn_ = 1").drop("rn_")


def unit_folds(units: DataFrame, folds: int, repeats: int, key: str = "unit_id", label: str = "label") -> DataFrame:
    """``rep, fold``: units of a label dealt to folds in the order of their hash, again for each repeat."""
    many = units.select(key, label).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = running_totals(many.withColumns({"place": uniform(F.lit("fold"), "rep", key), "one": F.lit(1)}), ["rep", label], ["place", key], ["one"])
    return ranked.select(key, label, "rep", (F.col("below_one") % folds).cast("int").alias("fold"))


def traceability(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``table, row_id`` of all source rows."""
    out = None
    for name, (df, key) in tables.items():
        part = df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("row_id"))
        out = part if out is None else out.unionByName(part)
    return out


def upsert_source(df: DataFrame, new: DataFrame, prefix: str, key: str = "row_id") -> DataFrame:
    """``df`` with the rows of a source replaced: adding the same rows again changes nothing."""
    return df.where(~F.col(key).startswith(prefix)).unionByName(new)
