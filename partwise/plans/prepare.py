"""Queries of reading, keys, audits and log-ratio preparation (inventory A, B, C, D, E, H, S)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.expressions import logit, odds_ratio, r6
from ..operators import audit, keys
from ..operators import logratio as lr
from ..sources import orders, tables
from ..sources.orders import PARTS
from . import sql as S

QUERIES, SQL = {}, {}


def register(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return keep


def rounded(df, *columns, digits: int = 6):
    """Rounded before they are compared; values that are exact to seven or eight digits keep eight."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def select6(df, plain, doubles, digits: int = 6):
    return df.select(*plain, *[F.round(c, digits).alias(c) for c in doubles])


SIX = ", ".join(S.r6(p, p) for p in PARTS)
EIGHT = ", ".join(f"round({p}, 8) + 0.0 as {p}" for p in PARTS)


@register(S.query(f"select point_id, unit_id, priority, {SIX} from raw"))
def a1_read_points(spark, d):
    return select6(orders.raw_points(spark, d), ["point_id", "unit_id", "priority"], PARTS)


@register("select o_orderkey as point_id, try_cast(trim(substr(o_orderpriority, 1, 1)) as double) as coded, try_cast(o_orderstatus as double) as bad from orders")
def a2_coerce(spark, d):
    raw = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("point_id"), F.substring("o_orderpriority", 1, 1).alias("coded"), F.col("o_orderstatus").alias("bad"))
    return tables.coerce_parts(raw, ["coded", "bad"])


@register(S.query("select unit_id, name, label, state, pattern, color from units"))
def a3_units(spark, d):
    return orders.raw_units(spark, d)


@register("select c_custkey as unit_id, case when length(cast(c_custkey as varchar)) >= 2 then cast(c_custkey as varchar) else lpad(cast(c_custkey as varchar), 2, '0') end as short_key, lpad(substr(c_name, 10), 9, '0') as long_key from customer")
def b1_keys(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("unit_id"), F.concat(F.lit(" "), F.col("c_custkey"), F.lit(" point")).alias("a"), F.substring("c_name", 10, 20).alias("b"))
    return keys.normalise_keys(keys.normalise_keys(c, "a", "short_key", 2), "b", "long_key", 9).select("unit_id", "short_key", "long_key")


@register(S.query("select point_id, unit_state, state, state_source from allp"))
def b2_point_state(spark, d):
    return orders.points(spark, d).select("point_id", "unit_state", "state", "state_source")


@register(S.query(f"select point_id, {S.r6('raw_sum', 'raw_sum')}, valid, exclusion_reason from allp"))
def b3_validity(spark, d):
    return select6(orders.points(spark, d), ["point_id", "valid", "exclusion_reason"], ["raw_sum"])


@register(S.query(f"select point_id, {S.each('cast({p} is null as int) as miss_{p}, cast(coalesce({p} = 0, false) as int) as zero_{p}')} from allp"))
def b4_cell_flags(spark, d):
    return keys.cell_flags(orders.points(spark, d), PARTS).select("point_id", *[f"{k}_{p}" for p in PARTS for k in ("miss", "zero")])


@register(S.query("select point_id, unit_id, label, state from known where label in (select label from (select label, state, count(distinct unit_id) n from known group by 1, 2) where n >= 5 group by label having count(*) = 2)"))
def b5_valid_points(spark, d):
    return keys.valid_points(orders.known_points(spark, d)).select("point_id", "unit_id", "label", "state")


@register(S.query("select unit_id, coalesce(color, 'unknown') as color, color is not null as complete from units"))
def b6_unknown_level(spark, d):
    u = orders.raw_units(spark, d)
    return keys.unknown_level(u.withColumn("complete", F.col("color").isNotNull()), "color").select("unit_id", "color", "complete")


@register(S.query("select unit_id, case when n < 62 then 'other' else color end as color from units left join (select color, count(*) n from units group by color) using (color)"))
def b7_merge_rare(spark, d):
    return keys.merge_rare(orders.raw_units(spark, d), "color", 62).select("unit_id", "color")


@register(S.query("select unit_id, case label when 'PB' then 1 else 0 end as y, case state when 'W' then 1 else 0 end as w from units"))
def b8_encode(spark, d):
    u = orders.raw_units(spark, d)
    return keys.encode_binary(keys.encode_binary(u, "label", {"K": 0, "PB": 1}, "y"), "state", {"U": 0, "W": 1}, "w").select("unit_id", "y", "w")


@register(S.query("select unit_id, cast(pattern = 'AMERICA' as int) as pattern_america, cast(pattern = 'ASIA' as int) as pattern_asia, cast(pattern = 'EUROPE' as int) as pattern_europe, cast(pattern = 'MIDDLE EAST' as int) as pattern_middle_east from units"))
def b9_dummy(spark, d):
    out = keys.dummy_code(orders.raw_units(spark, d), "pattern")
    return out.select("unit_id", *[c for c in out.columns if c.startswith("pattern_")])


_SHIFT = f"(cast(floor({S.uniform(chr(39) + 'perturb' + chr(39), 'point_id')} * 2) as bigint))"


@register(S.query("select point_id, " + ", ".join(f"round(case when {p} > 0 then {p} * (1 + 0.05 * (case when ({k} + {_SHIFT}) % 2 = 0 then 1.0 else -1.0 end)) else {p} end, 8) + 0.0 as {p}" for k, p in enumerate(PARTS)) + " from allp"))
def b10_perturb(spark, d):
    return select6(keys.perturb(orders.points(spark, d), PARTS, 0.05, 0, "point_id"), ["point_id"], PARTS, digits=8)


@register(S.query("select point_id, round(ln(q / (1 - q)), 6) + 0.0 as logit, round(exp(greatest(least(raw_sum - 90, 30.0), -30.0)), 4) + 0.0 as odds_ratio from (select *, greatest(least(raw_sum / 100, 1 - 1e-6), 1e-6) as q from allp)"))
def b11_logit(spark, d):
    return orders.points(spark, d).select("point_id", r6(logit(F.col("raw_sum") / 100)).alias("logit"), F.round(odds_ratio(F.col("raw_sum") - 90), 4).alias("odds_ratio"))


@register(S.query("select (select count(*) from (select unit_id from units group by 1 having count(*) > 1)) as repeated_keys, (select count(*) from raw where unit_id not in (select unit_id from units)) as unmatched_points"))
def c1_join_check(spark, d):
    return keys.join_check(orders.raw_points(spark, d), orders.raw_units(spark, d))


@register(S.query(f"select point_id, unit_id in (select unit_id from units where {S.uniform(chr(39) + 'hold' + chr(39), 'unit_id')} < 0.2) as held from known"))
def c2_semi_split(spark, d):
    from ..functions.expressions import uniform

    known = orders.known_points(spark, d)
    held = orders.raw_units(spark, d).where(uniform(F.lit("hold"), "unit_id") < 0.2)
    train, test = keys.semi_split(known, held)
    return train.select("point_id", F.lit(False).alias("held")).unionByName(test.select("point_id", F.lit(True).alias("held")))


_LONG = f"l as ({S.long('allp', 'label')})"


@register(S.query("select part, count(*) as n, count(value) as observed, count(*) - count(value) as missing, round(1 - count(value) / count(*), 8) + 0.0 as missing_rate, count(case when value = 0 then 1 end) as explicit_zero, round(min(case when value > 0 then value end), 8) as min_positive, round(quantile_cont(value, 0.25), 8) as q25, round(quantile_cont(value, 0.5), 8) as median, round(quantile_cont(value, 0.75), 8) as q75, round(max(value), 8) as max from l group by part", _LONG))
def d1_part_audit(spark, d):
    return rounded(audit.part_audit(orders.points(spark, d), PARTS), "missing_rate", "min_positive", "q25", "median", "q75", "max", digits=8)


@register(S.query("select m.label, m.part, n, missing, round(median, 8) as median, round(mad, 8) as mad, round(median_range, 8) as median_range from m join (select l.label, l.part, quantile_cont(abs(value - median), 0.5) mad from l join m using (label, part) group by 1, 2) using (label, part) join (select part, max(median) - min(median) median_range from m group by 1) using (part)", _LONG, "m as (select label, part, count(*) n, count(*) - count(value) missing, quantile_cont(value, 0.5) median from l group by 1, 2)"))
def d2_rationale(spark, d):
    return rounded(audit.imputation_rationale(orders.points(spark, d), PARTS, "label"), "median", "mad", "median_range", digits=8).select("label", "part", "n", "missing", "median", "mad", "median_range")


@register(S.query("select unit_id, count(*) as n_points, count(*) > 1 as multiple from allp group by unit_id"))
def d3_repeats(spark, d):
    return audit.repeat_audit(orders.points(spark, d))


_GRID = "select a, b, coalesce(n, 0) as observed, round(row_n * column_n / total_n, 6) as expected, round(coalesce(n, 0) / row_n, 6) as row_share from (select pattern a, count(*) row_n from units group by 1) cross join (select state b, count(*) column_n from units group by 1) cross join (select count(*) total_n from units) left join (select pattern a, state b, count(*) n from units group by 1, 2) using (a, b)"


@register(S.query(_GRID))
def d4_contingency(spark, d):
    return rounded(audit.contingency(orders.raw_units(spark, d), "pattern", "state"), "expected", "row_share").select("a", "b", "observed", "expected", "row_share")


@register(S.query("select count(*) as n_points, count(distinct point_id) as n_point_keys, cast(count(label) as bigint) as n_matched, count(distinct unit_id) as n_units_used, cast(sum(cast(valid as int)) as bigint) as n_valid, count(distinct case when valid then unit_id end) as n_valid_units, (select count(*) from units) as n_units, (select count(*) = count(distinct unit_id) from units) as unit_key_unique from allp"))
def d5_keys(spark, d):
    return audit.key_validation(orders.points(spark, d), orders.raw_units(spark, d))


@register(S.query("select label, part, count(value) as observed, round(count(value) / count(*), 6) as rate, case when count(value) < 5 then 'lt5_observed' when count(value) / count(*) < 0.46 then 'detection_rate_lt_0.46' end as reason, not (count(value) < 5 or count(value) / count(*) < 0.46) as node from l group by 1, 2", _LONG))
def d6_detection(spark, d):
    return rounded(audit.detection_nodes(orders.points(spark, d), PARTS, "label", 0.46), "rate")


@register(S.query("select unit_id, round(avg(cast(state = 'W' as int)), 6) as share, case when avg(cast(state = 'W' as int)) >= 0.5 then 'W' else 'U' end as majority_state from known group by unit_id"))
def d7_unit_state(spark, d):
    return rounded(audit.unit_state(orders.known_points(spark, d)), "share")


@register(S.query("select label, pattern, n from (select label, pattern, count(*) n, row_number() over (partition by label order by count(*) desc, min(unit_id)) rn from units group by 1, 2) where rn = 1"))
def d8_mode(spark, d):
    return audit.mode_config(orders.raw_units(spark, d), "label", "pattern", "unit_id")


@register(S.query("select part as feature, count(*) as n, round(avg(cast(abs(value) > 1e-10 as int)), 8) as selected, round(greatest(avg(cast(value >= 0 as int)), avg(cast(value <= 0 as int))), 8) as sign_frequency, round(quantile_cont(abs(value), 0.5), 8) as median_abs from (select part, value - 15 as value from l where value is not null) group by part", _LONG))
def d9_feature_stability(spark, d):
    cells = audit.unpivot(orders.points(spark, d), [], PARTS).where("value is not null")
    return rounded(audit.feature_stability(cells.select(F.col("part").alias("feature"), (F.col("value") - 15).alias("coef"))), "selected", "sign_frequency", "median_abs", digits=8)


@register(S.query("select label, part, round(mw, 8) as median_w, round(mu, 8) as median_u, round(mw / nullif(mu, 0), 8) as ratio from (select label, part, quantile_cont(value, 0.5) filter (where state = 'W') mw, quantile_cont(value, 0.5) filter (where state = 'U') mu from l2 group by 1, 2)", f"l2 as ({S.long('known', 'label, state')})"))
def d10_median_ratio(spark, d):
    return rounded(audit.median_ratio(orders.known_points(spark, d), PARTS, "label"), "median_w", "median_u", "ratio", digits=8)


@register(S.query("select point_id, unit_id, round(1.0 / count(*) over (partition by unit_id), 6) as weight from known"))
def e1_weights(spark, d):
    return select6(keys.unit_weights(orders.known_points(spark, d)), ["point_id", "unit_id"], ["weight"])


@register(S.query("select unit_id, min(point_id) as point_id from allp group by unit_id"))
def e2_unit_rows(spark, d):
    return keys.unit_rows(orders.points(spark, d)).select("unit_id", "point_id")


_P = f"f as (select unit_id, label, case when unit_id % 7 = 0 then null else round({S.uniform(chr(39) + 'p' + chr(39), 'unit_id')}, 3) end as p from units)"


@register(S.query("select unit_id, label, p, round(case when p is not null then least(1.0, min(raw) over (partition by label, p is null order by p, unit_id rows between current row and unbounded following)) end, 6) as p_fdr from (select *, p * count(*) over (partition by label, p is null) / row_number() over (partition by label, p is null order by p, unit_id) as raw from f)", _P))
def e3_bh_fdr(spark, d):
    from ..functions.expressions import uniform

    u = orders.raw_units(spark, d).select("unit_id", "label", F.when(F.col("unit_id") % 7 != 0, F.round(uniform(F.lit("p"), "unit_id"), 3)).alias("p"))
    return rounded(audit.bh_fdr(u, "p", ["label"]), "p_fdr")


@register(S.query("select point_id, label, state, economy, rank() over (partition by label order by economy) + (count(*) over (partition by label, economy) - 1) / 2 as rank from known where economy is not null"))
def e4_avg_rank(spark, d):
    return audit.avg_rank(orders.known_points(spark, d).where("economy is not null").select("point_id", "label", "state", "economy"), "economy", ["label"])


@register(S.query(f"select unit_id, label, rep, (row_number() over (partition by rep, label order by {S.uniform(chr(39) + 'fold' + chr(39), 'rep', 'unit_id')}, unit_id) - 1) % 5 as fold from units, (select unnest(range(3)) as rep)"))
def e5_folds(spark, d):
    return keys.unit_folds(orders.raw_units(spark, d), 5, 3)


def scored(spark, d):
    """Scores from the data: a unit's share of points in state W, shifted by its label."""
    return keys.join_units(audit.unit_state(orders.known_points(spark, d)), orders.raw_units(spark, d)).select("unit_id", "pattern", F.col("label").eqNullSafe("PB").cast("int").alias("y"), F.round(F.col("share") * 0.6 + F.when(F.col("label") == "PB", 0.25).otherwise(0.1), 4).alias("score"))


_SCORED = "scored as materialized (select unit_id, pattern, cast(label = 'PB' as int) as y, round(share * 0.6 + case when label = 'PB' then 0.25 else 0.1 end, 4) as score from (select unit_id, avg(cast(state = 'W' as int)) as share from known group by 1) join units using (unit_id))"


@register(S.query("select pattern, t / 100 as threshold, round(ba, 6) as balanced_accuracy from (select *, row_number() over (partition by pattern order by ba desc, abs(t - 50), t) rn from (select pattern, t, round((sum(cast(floor(score * 100 + 1e-9) >= t and y = 1 as int)) / sum(y) + sum(cast(floor(score * 100 + 1e-9) < t and y = 0 as int)) / sum(1 - y)) / 2, 9) ba from scored, range(20, 81) r(t) group by 1, 2)) where rn = 1", _SCORED))
def e6_threshold(spark, d):
    return rounded(audit.tune_threshold(scored(spark, d), ["pattern"]), "balanced_accuracy")


@register(S.query("select pattern, score, cast(sum(sum(y)) over (partition by pattern order by score desc) as bigint) as tp, cast(sum(sum(1 - y)) over (partition by pattern order by score desc) as bigint) as fp from scored group by pattern, score", _SCORED))
def e7_roc(spark, d):
    return audit.roc(scored(spark, d), "pattern")


@register(S.query("select pattern, round((sum(case when y = 1 then rk end) - p * (p + 1) / 2) / (p * q), 6) as auc from (select *, rank() over (partition by pattern order by score) + (count(*) over (partition by pattern, score) - 1) / 2 rk, sum(y) over (partition by pattern) p, sum(1 - y) over (partition by pattern) q from scored) group by pattern, p, q", _SCORED))
def e7_auc(spark, d):
    return rounded(audit.auc(scored(spark, d), ["pattern"]), "auc")


@register(S.query("select bin, count(*) as n, round(avg(score), 6) as mean_score, round(avg(y), 6) as rate from (select y, score, " + " + ".join(f"cast(score > e[{i}] as int)" for i in range(1, 8)) + " as bin from scored, (select quantile_cont(score, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as e from scored)) group by bin", _SCORED))
def e8_calibration(spark, d):
    return rounded(audit.calibration_curve(scored(spark, d)), "mean_score", "rate")


@register(S.query("select unit_id, round(max(case when rn = 1 then share end), 6) as top1, round(coalesce(max(case when rn = 2 then share end), 0), 6) as top2, max(case when rn = 1 then share end) < 0.8 or max(case when rn = 1 then share end) - coalesce(max(case when rn = 2 then share end), 0) < 0.2 as boundary from (select unit_id, priority, count(*) / sum(count(*)) over (partition by unit_id) share, row_number() over (partition by unit_id order by count(*) desc, priority) rn from allp group by 1, 2) where rn <= 2 group by unit_id"))
def e9_assignment(spark, d):
    return rounded(audit.assignment_freq(orders.points(spark, d), "unit_id", "priority"), "top1", "top2")


@register(S.query("select pattern, label, n, row_number() over (partition by label order by n desc, pattern) as position from (select label, pattern, count(*) n from units group by 1, 2)"))
def e10_rank(spark, d):
    return audit.rank_configs(orders.raw_units(spark, d).groupBy("label", "pattern").agg(F.count("*").alias("n")), ["label"], [F.desc("n"), "pattern"])


@register(S.query("select label, point_id, round(raw_sum - 95, 6) as change, position from (select label, point_id, raw_sum, row_number() over (partition by label order by abs(raw_sum - 95) desc, point_id) as position from allp) where position <= 10"))
def e11_top(spark, d):
    p = orders.points(spark, d).select("label", "point_id", (F.col("raw_sum") - 95).alias("change"))
    return rounded(audit.top_changes(p, 10, ["label"], "change", "point_id"), "change")


@register(S.query("select 'points' as \"table\", cast(point_id as varchar) as row_id from raw union all select 'units', cast(unit_id as varchar) from units"))
def s1_traceability(spark, d):
    return keys.traceability({"points": (orders.raw_points(spark, d), "point_id"), "units": (orders.raw_units(spark, d), "unit_id")})


@register(S.query("select 'points' as \"table\", cast(point_id as varchar) as row_id from raw where not starts_with(cast(point_id as varchar), '1') union all select 'points', cast(point_id as varchar) from raw where starts_with(cast(point_id as varchar), '1') and point_id % 2 = 0"))
def s2_upsert(spark, d):
    rows = keys.traceability({"points": (orders.raw_points(spark, d), "point_id")})
    new = rows.where(F.col("row_id").startswith("1") & (F.col("row_id").cast("long") % 2 == 0))
    return keys.upsert_source(keys.upsert_source(rows, new, "1"), new, "1")


@register(S.query("select pattern, count(case when a and b then 1 end) as shared, count(*) as \"all\", round(count(case when a and b then 1 end) / count(*), 6) as jaccard from (select pattern, color, bool_or(state = 'W') a, bool_or(state = 'U' and unit_id % 2 = 0) b from units where color is not null group by 1, 2) where a or b group by pattern"))
def s3_jaccard(spark, d):
    u = orders.raw_units(spark, d).where("color is not null")
    return rounded(audit.set_jaccard(u.where("state = 'W'"), u.where("state = 'U' and unit_id % 2 = 0"), ["color"], ["pattern"]), "jaccard")


@register(S.query("with n as (select part from (select label, part, count(value) / count(*) rate from l group by 1, 2) where rate >= 0.46 group by part having count(*) = 2) select a.part as part_j, b.part as part_k from n a join n b on a.part < b.part".replace("with n as", "select * from (with n as") + ")", _LONG))
def s4_common_nodes(spark, d):
    return audit.common_nodes(audit.detection_nodes(orders.points(spark, d), PARTS, "label", 0.46), "label")


PREP = S.prep_ctes()


def prepared(spark, d, zero_c: float = 0.5):
    known = orders.written_known(spark, d)
    return lr.transform(known, lr.fit_prep(known, PARTS, "label", zero_c=zero_c))


@register(S.query("select " + "grp as group_name, part, n_observed, round(median_value, 8) as median_value, fallback_level, round(delta, 8) as delta from (" + " union all ".join(f"select grp, '{p}' as part, n_{p} as n_observed, case when n_{p} >= 5 then m_{p} else g_{p} end as median_value, case when n_{p} >= 5 then 'group' else 'global' end as fallback_level, d_{p} as delta from med cross join overall cross join delta" for p in PARTS) + ")", PREP))
def h1_fit_prep(spark, d):
    return rounded(lr.parameter_table(spark, lr.fit_prep(orders.known_points(spark, d), PARTS, "label")), "median_value", "delta", digits=8)


@register(S.query(f"select point_id, {EIGHT}, {', '.join(f'fallback_{p}' for p in PARTS)} from fill", PREP))
def h2_fill(spark, d):
    known = orders.known_points(spark, d)
    return select6(lr.fill(known, lr.fit_prep(known, PARTS, "label")), ["point_id", *[f"fallback_{p}" for p in PARTS]], PARTS, digits=8)


@register(S.query(f"select point_id, {EIGHT} from rep", PREP))
def h3_zero_replace(spark, d):
    known = orders.known_points(spark, d)
    prep = lr.fit_prep(known, PARTS, "label")
    return select6(lr.zero_replace(lr.fill(known, prep), prep), ["point_id"], PARTS, digits=8)


@register(S.query(f"select point_id, {SIX}, 0.0 as closure_error from closed", PREP))
def h4_closure(spark, d):
    return select6(prepared(spark, d), ["point_id"], [*PARTS, "closure_error"])


@register(S.query(f"select point_id, {S.each('round(clr_{p}, 6) + 0.0 as clr_{p}')} from z", PREP))
def h5_clr(spark, d):
    return select6(prepared(spark, d), ["point_id"], [f"clr_{p}" for p in PARTS])


@register(S.query(f"select point_id, {', '.join(S.r6(c, c) for c in S.ILR)} from z", PREP))
def h6_ilr(spark, d):
    return select6(prepared(spark, d), ["point_id"], S.ILR)


@register(S.query(f"select point_id, {S.each('round({p}, 6) + 0.0 as back_{p}')} from closed", PREP))
def h7_inverse_ilr(spark, d):
    return select6(lr.inverse_ilr(prepared(spark, d), S.ILR, PARTS, "back_"), ["point_id"], [f"back_{p}" for p in PARTS])


LIBRARY = {"first": (("economy",), ("large", "medium")), "second": (("promo", "small"), ("standard", "economy")), "third": (("economy", "large"), ("medium", "promo", "small", "standard")), "absent": (("none",), ("economy",))}


def balance_sql(num, den) -> str:
    mean = lambda ps: "(" + " + ".join(f"ln({p})" for p in ps) + f") / {len(ps)}"
    return f"{math.sqrt(len(num) * len(den) / (len(num) + len(den)))!r} * ({mean(num)} - {mean(den)})"


BALANCES_SQL = ", ".join(f"{balance_sql(*LIBRARY[k])} as {k}" for k in ("first", "second", "third"))


@register(S.query("select point_id, " + ", ".join(S.r6(k, k) for k in ("first", "second", "third")) + f", cast(null as double) as absent from (select point_id, {BALANCES_SQL} from closed)", PREP))
def h8_balances(spark, d):
    return select6(lr.balances(prepared(spark, d), LIBRARY), ["point_id"], LIBRARY)


@register(S.query(f"select label, state, {SIX} from (select label, state, {S.closed_columns()} from (select label, state, {S.each('exp(avg(ln({p}))) as {p}')} from closed group by 1, 2))", PREP))
def h9_center(spark, d):
    return select6(lr.aitchison_center(prepared(spark, d), PARTS, ["label", "state"]), ["label", "state"], PARTS)


CENTERS = f"means as materialized (select unit_id, min(label) as label, min(unit_state) as unit_state, count(*) as n_points, {', '.join(f'avg({c}) as {c}' for c in S.ILR)} from z group by unit_id), expo as (select *, {S.inverse_columns(S.ILR)} from means), centers as materialized (select * exclude ({S.each('e_{p}')}), {S.closed_columns('e_')} from expo)"


def centers(spark, d, zero_c: float = 0.5):
    return lr.unit_centers(prepared(spark, d, zero_c), PARTS, carry=("label", "unit_state"))


@register(S.query(f"select unit_id, label, n_points, {SIX}, {', '.join(S.r6(c, c) for c in S.ILR)} from centers", PREP, CENTERS))
def h10_unit_centers(spark, d):
    return select6(centers(spark, d), ["unit_id", "label", "n_points"], [*PARTS, *S.ILR])


@register(S.query("select count(*) as n_rows, 0 as not_closed, 0 as not_finite from z", PREP))
def h11_prep_audit(spark, d):
    return lr.prep_audit(prepared(spark, d), PARTS)


REPS = ("economy", "promo", "standard")


@register(S.query(f"select point_id, ilr_1, ilr_2 from (select point_id, {', '.join(f'round({S.linear(row, [f'ln({p})' for p in REPS])}, 6) + 0.0 as ilr_{i}' for i, row in enumerate(S.helmert(3), 1))} from closed)", PREP))
def h12_subcomposition(spark, d):
    sub = lr.closure(prepared(spark, d).select("point_id", *REPS), REPS)
    return select6(lr.ilr(sub, REPS), ["point_id"], ["ilr_1", "ilr_2"])


_KNN = f"""st as materialized (select {S.each("avg({p}) as a_{p}, case when stddev_pop({p}) > 0 then stddev_pop({p}) else 1 end as s_{p}")} from known),
kz as materialized (select point_id, {S.each("{p}, ({p} - a_{p}) / s_{p} as z_{p}")} from known, st),
dist as (select k.point_id, {S.each("k.{p} as x_{p}, e.{p} as y_{p}")}, cast(round(sqrt(({S.each("coalesce((k.z_{p} - e.z_{p}) * (k.z_{p} - e.z_{p}), 0)", sep=" + ")}) * {len(PARTS)} / ({S.each("cast(k.z_{p} - e.z_{p} is not null as int)", sep=" + ")})), 9) * 1e9 as hugeint) * 1000000000000 + e.point_id as place from kz k, kz e where k.point_id <> e.point_id and {S.each("cast(k.z_{p} - e.z_{p} is not null as int)", sep=" + ")} > 0),
best as materialized (select point_id, {S.each("arg_min(y_{p}, place, 5) filter (where x_{p} is null and y_{p} is not null) as v_{p}")} from dist group by 1)"""
_KNN_SQL = S.query(" union all ".join(f"select point_id, '{p}' as part, round(greatest(list_avg(v_{p}), 0), 6) as value from best where len(v_{p}) > 0" for p in PARTS), _KNN)


@register(_KNN_SQL)
def h13_knn(spark, d):
    known = orders.known_points(spark, d)
    return rounded(lr.knn_impute(known, known, PARTS, 5), "value")


#: The same job under the name that it had while the other read a sample.
QUERIES["h17_knn_all"], SQL["h17_knn_all"] = h13_knn, _KNN_SQL


_MASK = f"""m0 as (select r.rep, label, part, point_id, value from (select label, point_id, part, value from ({S.long("known", "label, point_id")}) where value is not null) , (select unnest(range(20)) as rep) r),
m1 as (select *, row_number() over (partition by rep, part order by case when value > 0 then 0 else 1 end, {S.uniform("'mask'", "rep", "part", "point_id")}, point_id) rn, sum(cast(value > 0 as int)) over (partition by rep, part) n from m0),
m2 as materialized (select *, rn <= greatest(1, cast(round(n * 0.1) as int)) as hidden from m1 where n >= 10),
mo as (select rep, part, avg(value) mean, quantile_cont(value, 0.5) median from m2 where not hidden group by 1, 2),
mg as (select rep, part, label, case when count(*) >= 5 then quantile_cont(value, 0.5) end own from m2 where not hidden group by 1, 2, 3),
mt as materialized (select rep, part, value, mean, median, coalesce(own, median) own from (select * from m2 where hidden) join mo using (rep, part) left join mg using (rep, part, label)),
detail as materialized (select rep, part, method, count(*) n, avg(abs(e)) mae, sqrt(avg(e * e)) rmse, quantile_cont(abs(e), 0.5) median_ae from (select rep, part, 'global_mean' as method, mean - value e from mt union all select rep, part, 'global_median', median - value from mt union all select rep, part, 'zero', -value from mt union all select rep, part, 'group_median', own - value from mt) group by 1, 2, 3)"""


@register(S.query("select rep, part, method, n, round(mae, 6) as mae, round(rmse, 6) as rmse, round(median_ae, 6) as median_ae from detail", _MASK))
def h14_mask_validation(spark, d):
    """Errors of few cells of six digits often end in a half at the seventh, so they are rounded as SQL does, in doubles."""
    told = lr.mask_validation(orders.known_points(spark, d), PARTS, "label", 20)
    return told.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in ("mae", "rmse", "median_ae")})


@register(S.query("select method, round(m, 6) as mean_mae, round(lo, 6) as mae_low, round(hi, 6) as mae_high, round(m - (select avg(mae) from detail where method = 'group_median'), 6) + 0.0 as delta from (select method, avg(mae) m, quantile_cont(mae, 0.025) lo, quantile_cont(mae, 0.975) hi from detail group by 1)", _MASK))
def h15_mask_summary(spark, d):
    return rounded(lr.mask_summary(lr.mask_validation(orders.known_points(spark, d), PARTS, "label", 20)), "mean_mae", "mae_low", "mae_high", "delta")


@register(None)
def h16_pca(spark, d):
    return rounded(lr.logratio_pca(prepared(spark, d), S.ILR), "loading", "explained")
