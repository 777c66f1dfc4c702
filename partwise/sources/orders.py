"""Compositions from the order tables: an order is a point, its customer the unit, part types are the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise
from .tables import TableSpec, read_table

PARTS = ("economy", "large", "medium", "promo", "small", "standard")
LOW, HIGH = 85.0, 105.0

SPECS = {
    s.name: s
    for s in (
        TableSpec("lineitem", ("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax")),
        TableSpec("orders", ("o_orderkey", "o_custkey", "o_orderpriority")),
        TableSpec("part", ("p_partkey", "p_type")),
        TableSpec("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
        TableSpec("nation", ("n_nationkey", "n_name", "n_regionkey")),
        TableSpec("region", ("r_regionkey", "r_name")),
    )
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, SPECS[name])


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``point_id, unit_id, priority`` and the parts in per cent; null: no line of that type, 0: only zero discounts."""
    lines = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    amount = F.col("l_extendedprice") * F.col("l_discount")
    whole = F.sum(amount)
    shares = [F.round(100 * F.sum(F.when((F.col("p_type") == p.upper()) & (F.col("l_tax") > 0), amount)) / F.when(whole != 0, whole), 6).alias(p) for p in PARTS]
    by_order = lines.groupBy("l_orderkey").agg(*shares)
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("unit_id"), F.col("o_orderpriority").alias("priority"))
    return by_order.join(orders, F.col("l_orderkey") == F.col("point_id")).select("point_id", "unit_id", "priority", *PARTS)


def raw_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders: ``unit_id, name, label, state, pattern, color``."""
    customers = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    with_orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(with_orders, "c_custkey", "left_semi").select(
        F.col("c_custkey").alias("unit_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "K").otherwise("PB").alias("label"),
        F.when((F.col("c_acctbal") < 0) | (F.col("c_custkey") % 3 == 0), "W").otherwise("U").alias("state"),
        F.col("r_name").alias("pattern"),
        F.when(F.col("c_nationkey") % 10 != 7, F.col("n_name")).alias("color"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points with their units' attributes, the point's own state, row total and validity."""
    from ..operators.keys import join_units, point_state, validity

    return validity(point_state(join_units(raw_points(spark, sf_dir), raw_units(spark, sf_dir).withColumnRenamed("state", "unit_state")), "1-URGENT", "5-LOW"), PARTS, LOW, HIGH)


def known_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid points of units whose label is known."""
    return points(spark, sf_dir).where("valid and unit_id % 50 <> 0")


#: Columns of points that fits and resampling read.
KEPT = ("point_id", "unit_id", "label", "state", "unit_state", "pattern", "color", "raw_sum", "valid", *PARTS)


def written_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``known_points`` as a table written once: a job of several passes joins the order lines once, not in each pass."""
    return materialise(known_points(spark, sf_dir).select(*KEPT), "known")


def written_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of units whose label is known, valid or not, as a table written once."""
    return materialise(points(spark, sf_dir).where("unit_id % 50 <> 0").select(*KEPT), "labelled")


def unknown_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of units whose label is hidden."""
    return points(spark, sf_dir).where("unit_id % 50 = 0").drop("label")


_SHARES = ",\n  ".join(f"round(100 * sum(case when p_type = '{p.upper()}' and l_tax > 0 then l_extendedprice * l_discount end) / nullif(sum(l_extendedprice * l_discount), 0), 6) as {p}" for p in PARTS)

#: The same tables as common table expressions for DuckDB.
BASE_SQL = f"""
raw as materialized (select l_orderkey as point_id, any_value(o_custkey) as unit_id, any_value(o_orderpriority) as priority,
  {_SHARES}
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by l_orderkey),
units as materialized (select c_custkey as unit_id, c_name as name, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'K' else 'PB' end as label,
  case when c_acctbal < 0 or c_custkey % 3 = 0 then 'W' else 'U' end as state, r_name as pattern,
  case when c_nationkey % 10 <> 7 then n_name end as color
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where c_custkey in (select o_custkey from orders)),
pts as materialized (select raw.*, u.name, u.label, u.state as unit_state, u.pattern, u.color,
  case priority when '1-URGENT' then 'U' when '5-LOW' then 'W' else u.state end as state,
  case priority when '1-URGENT' then 'point_unweathered' when '5-LOW' then 'point_severe' else 'unit' end as state_source,
  {' + '.join(f'coalesce({p}, 0)' for p in PARTS)} as raw_sum
  from raw left join units u using (unit_id)),
allp as materialized (select *, raw_sum between 85 and 105 as valid, case when raw_sum between 85 and 105 then null when raw_sum < 85 then 'sum_below_85' else 'sum_above_105' end as exclusion_reason from pts),
known as materialized (select * from allp where valid and unit_id % 50 <> 0)"""
