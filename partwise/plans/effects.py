"""Queries of the state effect, its resampling and the counterfactual shift (inventory C3-C5, J, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import helmert
from ..operators import audit, robust
from ..operators import effect as E
from ..operators import logratio as lr
from ..sources import orders
from ..sources.orders import PARTS
from ..sources.shared import materialise
from . import sql as S
from .prepare import SIX, prepared, rounded, select6
from .prepare import CENTERS as CENTERS_SQL
from .prepare import PREP

QUERIES, SQL = {}, {}
#: Replicates of the bootstrap and of the permutation.
REPS, PERMS = 1_000, 10_000
Z = S.ILR
IDX = range(1, len(PARTS))


def register(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return keep


def effect_ctes(src: str, keys: str, out: str) -> str:
    """``out``: a_i, b_i and effect_norm of the rows of ``src`` (with ``weight``)."""
    mean = lambda c, s: f"sum(weight * {c}) filter (where state = '{s}') / sum(weight) filter (where state = '{s}')"
    inner = ", ".join(f"{mean(c, 'U')} as a_{i}, {mean(c, 'W')} - {mean(c, 'U')} as b_{i}" for i, c in enumerate(Z, 1))
    return f"{out} as materialized (select *, sqrt({' + '.join(f'b_{i} * b_{i}' for i in IDX)}) as effect_norm from (select {keys}, {inner} from {src} group by {keys}))"


WEIGHTED = S.grouped_ctes("known", "label", "j") + ",\njw as materialized (select *, 1.0 / count(*) over (partition by unit_id) as weight from jz)"
MAIN = effect_ctes("jw", "label", "main")
BOOT = (
    f"bdraw as materialized (select unit_id, rep, {S.poisson()} as m from {S.drawn('known', 'boot', REPS)}),\n"
    "bpos as materialized (select k.*, rep, m from (select *, 1.0 / count(*) over (partition by unit_id) as uw from known) k join bdraw using (unit_id) where m > 0),"
    + S.grouped_ctes("bpos", "rep, label", "b", weight="m")
    + ",\nbw as (select *, m * uw as weight from bz),\n"
    + effect_ctes("bw", "rep, label", "boot")
)


def weighted(spark, d, zero_c: float = 0.5, known=None):
    """Prepared points with weights, from points that are written once (``known``, if the caller has written them)."""
    return E.prepared_points(orders.written_known(spark, d) if known is None else known, PARTS, zero_c)


def long_sql(table: str, keys: str, fields) -> str:
    return "(" + " union all ".join(f"select {keys}, 'ilr_{i}' as coordinate, {', '.join(f'{f}_{i} as {n}' for f, n in fields)} from {table}" for i in IDX) + ")"


@register(S.query(f"select label, coordinate, round(intercept, 6) + 0.0 as intercept, round(beta, 6) + 0.0 as beta from {long_sql('main', 'label', (('a', 'intercept'), ('b', 'beta')))}", WEIGHTED, MAIN))
def j1_state_effect(spark, d):
    return rounded(E.long_effect(E.state_effect(weighted(spark, d), PARTS, ["label"]), PARTS, ["label"]), "intercept", "beta")


@register(S.query("select label, round(effect_norm, 6) as effect_norm from main", WEIGHTED, MAIN))
def j2_effect_norm(spark, d):
    return rounded(E.state_effect(weighted(spark, d), PARTS, ["label"]).select("label", "effect_norm"), "effect_norm")


PERM = f"""um as materialized (select label, unit_id, {", ".join(f"avg({c}) as {c}" for c in Z)}, case when avg(cast(state = 'W' as int)) >= 0.5 then 'W' else 'U' end as state from jw group by 1, 2),
dealt as materialized (select unit_id, rep, row_number() over (partition by rep, label order by x_, b_, unit_id) <= n_w as is_w from {S.drawn("um", "perm", PERMS)} join (select label, count(case when state = 'W' then 1 end) as n_w from um group by 1) using (label)),
pw as (select um.* exclude (state), rep, case when is_w then 'W' else 'U' end as state, 1.0 as weight from um join dealt using (unit_id))"""


@register(S.query(f"select label, round(m.effect_norm, 6) as observed, count(case when n.effect_norm >= m.effect_norm - 1e-12 then 1 end) as exceed, round((count(case when n.effect_norm >= m.effect_norm - 1e-12 then 1 end) + 1) / ({PERMS} + 1), 6) as p from nulls n join main m using (label) group by label, m.effect_norm", WEIGHTED, MAIN, PERM, effect_ctes("pw", "rep, label", "nulls")))
def j3_permutation(spark, d):
    return rounded(E.perm_state(weighted(spark, d), PARTS, PERMS), "observed", "p")


@register(S.query(f"select rep, label, {', '.join(S.r6(f'b_{i}', f'b_{i}') for i in IDX)}, round(effect_norm, 6) as effect_norm from boot", BOOT))
def j4_bootstrap(spark, d):
    return select6(E.boot_effect(orders.known_points(spark, d), PARTS, REPS), ["rep", "label"], [*[f"b_{i}" for i in IDX], "effect_norm"])


@register(S.query(f"select label, coordinate, round(beta, 6) + 0.0 as beta, round(boot_se, 6) as boot_se, round(ci_low, 6) + 0.0 as ci_low, round(ci_high, 6) + 0.0 as ci_high, round(sign_frequency, 6) as sign_frequency, round(p_raw, 6) + 0.0 as p_raw, round(least(1.0, min(raw) over (partition by label order by p_raw, coordinate rows between current row and unbounded following)), 6) + 0.0 as p_fdr from (select *, p_raw * count(*) over (partition by label) / row_number() over (partition by label order by p_raw, coordinate) as raw from (select label, coordinate, stddev_samp(beta) boot_se, quantile_cont(beta, 0.025) ci_low, quantile_cont(beta, 0.975) ci_high, greatest(avg(cast(beta >= 0 as int)), avg(cast(beta <= 0 as int))) sign_frequency, least(1.0, 2 * least(avg(cast(beta >= 0 as int)), avg(cast(beta <= 0 as int)))) p_raw from {long_sql('boot', 'label', (('b', 'beta'),))} group by 1, 2) join {long_sql('main', 'label', (('b', 'beta'),))} using (label, coordinate))", WEIGHTED, MAIN, BOOT))
def j5_effect_table(spark, d):
    known = orders.written_known(spark, d)
    table = E.effect_table(E.main_effect(E.prepared_points(known, PARTS), PARTS), E.boot_effect(known, PARTS, REPS), PARTS)
    return select6(table, ["label", "coordinate"], ["beta", "boot_se", "ci_low", "ci_high", "sign_frequency", "p_raw", "p_fdr"])


def _percent_sql(table: str, keys: str) -> str:
    """Rows keys, part, u, w of the predicted compositions of an effect table."""
    basis = helmert(len(PARTS))
    e = lambda k, w: "exp(" + S.linear([r[k] for r in basis], [f"(a_{i} + b_{i})" if w else f"a_{i}" for i in IDX]) + ")"
    inner = ", ".join(f"{e(k, False)} as u_{p}, {e(k, True)} as w_{p}" for k, p in enumerate(PARTS))
    us, ws = " + ".join(f"u_{p}" for p in PARTS), " + ".join(f"w_{p}" for p in PARTS)
    return "(" + " union all ".join(f"select {keys}, '{p}' as part, 100 * u_{p} / ({us}) as u, 100 * w_{p} / ({ws}) as w from (select {keys}, {inner} from {table})" for p in PARTS) + ")"


@register(S.query(f"select label, part, round(u, 6) as predicted_u, round(w, 6) as predicted_w, round(w - u, 6) + 0.0 as difference, round(lo, 6) + 0.0 as ci_low, round(hi, 6) + 0.0 as ci_high from {_percent_sql('main', 'label')} join (select label, part, quantile_cont(w - u, 0.025) lo, quantile_cont(w - u, 0.975) hi from {_percent_sql('boot', 'label')} group by 1, 2) using (label, part)", WEIGHTED, MAIN, BOOT))
def j6_contrast(spark, d):
    known = orders.written_known(spark, d)
    main = E.main_effect(E.prepared_points(known, PARTS), PARTS)
    return rounded(E.effect_contrast(main, E.boot_effect(known, PARTS, REPS), PARTS), "predicted_u", "predicted_w", "difference", "ci_low", "ci_high")


_MW = f"""cells as materialized (select *, rank() over (partition by label, part order by value) + (count(*) over (partition by label, part, value) - 1) / 2 as rk from ({S.long("known", "label, state")}) where value is not null),
tie as (select label, part, sum(t * t * t - t) ties from (select label, part, value, cast(count(*) as double) t from cells group by 1, 2, 3) group by 1, 2),
mw as (select label, part, sum(rk) filter (where state = 'W') r, cast(count(*) filter (where state = 'W') as double) n1, cast(count(*) filter (where state = 'U') as double) n0, quantile_cont(value, 0.5) filter (where state = 'W') - quantile_cont(value, 0.5) filter (where state = 'U') md from cells group by 1, 2)"""


@register(S.query("select label, part, round(r - n1 * (n1 + 1) / 2, 6) as u, round((r - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))), 6) + 0.0 as z, round(md, 7) + 0.0 as median_difference from mw join tie using (label, part)", _MW))
def j7_mann_whitney(spark, d):
    out = E.mann_whitney(orders.written_known(spark, d), PARTS)
    return rounded(rounded(out.select("label", "part", "u", "z", "median_difference"), "u", "z"), "median_difference", digits=7)


_RES = "res as materialized (" + " union all ".join(f"select label, 'ilr_{i}' as coordinate, a_{i} + case when state = 'W' then b_{i} else 0 end as fitted, ilr_{i} - (a_{i} + case when state = 'W' then b_{i} else 0 end) as residual from jw join main using (label)" for i in IDX) + ")"


@register(S.query("select label, coordinate, round(avg(residual), 6) + 0.0 as mean, round(stddev_samp(residual), 6) as sd, round(skewness(residual), 5) + 0.0 as skewness, round(kurtosis(residual), 5) + 0.0 as kurtosis, round(abs(corr(fitted, residual)), 6) + 0.0 as abs_corr, abs(skewness(residual)) > 2 or abs(kurtosis(residual)) > 7 as flag from res group by 1, 2", WEIGHTED, MAIN, _RES))
def j8_residuals(spark, d):
    points = weighted(spark, d)
    out = rounded(E.residual_diag(points, E.main_effect(points, PARTS), PARTS), "mean", "sd", "abs_corr")
    return rounded(out, "skewness", "kurtosis", digits=5)


def _loo_sql() -> str:
    sums = [(c, s) for s in "UW" for c in ("", *Z)]
    unit = ", ".join(f"coalesce(sum(weight{' * ' + c if c else ''}) filter (where state = '{s}'), 0) as {s}_{c}" for c, s in sums)
    left = lambda s, c: f"(all_{s}_{c} - {s}_{c})"
    beta = lambda c: f"({left('W', c)} / {left('W', '')} - {left('U', c)} / {left('U', '')})"
    full = lambda c: f"(all_W_{c} / all_W_ - all_U_{c} / all_U_)"
    agree = " + ".join(f"cast(sign({beta(c)}) = sign({full(c)}) as int)" for c in Z)
    return f"select label, unit_id, round(sqrt({' + '.join(f'{beta(c)} * {beta(c)}' for c in Z)}), 6) as effect_norm, round(({agree}) / {len(Z)}, 6) as direction_agreement from (select label, unit_id, {unit} from jw group by 1, 2) join (select label, {', '.join(f'sum({s}_{c}) as all_{s}_{c}' for c, s in sums)} from (select label, unit_id, {unit} from jw group by 1, 2) group by 1) using (label)"


@register(S.query(_loo_sql(), WEIGHTED))
def j9_leave_one_out(spark, d):
    return rounded(E.loo_effect(weighted(spark, d), PARTS), "effect_norm", "direction_agreement")


_SENS = [("main", "known", 0.5), ("zero_c_0.25", "known", 0.25), ("zero_c_0.75", "known", 0.75), ("with_invalid", "everyone", 0.5), ("inherited_state", "inherited", 0.5)]
_SENS_CTES = ["everyone as materialized (select * from allp where unit_id % 50 <> 0)", "inherited as materialized (select * replace (unit_state as state) from known)"]
for _k, (_n, _src, _c) in enumerate(_SENS):
    _SENS_CTES += [S.grouped_ctes(_src, "label", f"q{_k}", _c), f"q{_k}w as (select *, 1.0 / count(*) over (partition by unit_id) as weight from q{_k}z)", effect_ctes(f"q{_k}w", "label", f"q{_k}e")]
_SENS_SQL = " union all ".join(f"select '{n}' as scenario, s.label, round(s.effect_norm, 6) as effect_norm, ({' + '.join(f'cast(sign(s.b_{i}) = sign(m.b_{i}) as int)' for i in IDX)}) / {len(Z)} as sign_agreement from q{k}e s join q0e m using (label)" for k, (n, _, _) in enumerate(_SENS))


@register(S.query(f"select *, sign_agreement >= 0.8 as stable from ({_SENS_SQL})", *_SENS_CTES))
def j10_sensitivity(spark, d):
    known, everyone = orders.known_points(spark, d), orders.points(spark, d).where("unit_id % 50 <> 0")
    scenarios = {"main": E.prepared_points(known, PARTS), "zero_c_0.25": E.prepared_points(known, PARTS, 0.25), "zero_c_0.75": E.prepared_points(known, PARTS, 0.75), "with_invalid": E.prepared_points(everyone, PARTS), "inherited_state": E.prepared_points(known.withColumn("state", F.col("unit_state")), PARTS)}
    return rounded(E.effect_sensitivity(scenarios, PARTS), "effect_norm")


_BASIS = helmert(len(PARTS))
SHIFTS = "shifts as (select label, " + ", ".join(f"{S.linear([r[k] for r in _BASIS], [f'b_{i}' for i in IDX])} as s_{p}" for k, p in enumerate(PARTS)) + " from main)"
CF = f"cfe as (select jw.*, {S.each('{p} * exp(-s_{p}) as e_{p}')} from jw join shifts using (label) where state = 'W'), cf as materialized (select point_id, unit_id, label, {', '.join(PARTS)}, {S.closed_columns('e_', out='cf_')} from cfe)"


def shifted(spark, d, known=None):
    points = weighted(spark, d, known=known)
    return E.counterfactual(points, E.main_effect(points, PARTS), PARTS)


@register(S.query(f"select point_id, {S.each('round(cf_{p}, 6) + 0.0 as cf_{p}')} from cf", WEIGHTED, MAIN, SHIFTS, CF))
def k1_counterfactual(spark, d):
    return select6(shifted(spark, d), ["point_id"], [f"cf_{p}" for p in PARTS])


BOOT_CF = f"""bshift as (select rep, label, {", ".join(f"{S.linear([r[k] for r in _BASIS], [f'b_{i}' for i in IDX])} as s_{p}" for k, p in enumerate(PARTS))} from boot),
bcfe as (select point_id, rep, {S.each("(case when coalesce(k.{p}, m_{p}) = 0 then d_{p} else coalesce(k.{p}, m_{p}) end) * exp(-s_{p}) as e_{p}")} from known k join bmed using (label) join bdelta using (rep, label) join bshift using (rep, label) where state = 'W'),
bcf as materialized (select point_id, rep, {S.closed_columns('e_')} from bcfe)"""


@register(S.query(f"select point_id, part, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.975), 6) as high from ({S.long('bcf', 'point_id')}) group by 1, 2", BOOT, BOOT_CF))
def k2_boot_counterfactual(spark, d):
    known = orders.written_known(spark, d)
    return rounded(E.counterfactual_intervals(known, E.replicate_parameters(known, PARTS, REPS), PARTS), "low", "median", "high")


_RADIUS = "gaps as (select b.point_id, " + ", ".join(f"ln(b.{p}) - ln(cf_{p}) as g_{p}" for p in PARTS) + " from bcf b join cf using (point_id)), radii as (select point_id, sqrt(" + " + ".join(f"(g_{p} - mean) * (g_{p} - mean)" for p in PARTS) + ") as r from (select *, (" + " + ".join(f"g_{p}" for p in PARTS) + f") / {len(PARTS)} as mean from gaps))"


@register(S.query("select point_id, round(quantile_cont(r, 0.95), 6) as radius from radii group by 1", WEIGHTED, MAIN, SHIFTS, CF, BOOT, BOOT_CF, _RADIUS))
def k3_uncertainty_radius(spark, d):
    known = orders.written_known(spark, d)
    return rounded(E.uncertainty_radius(known, shifted(spark, d, known), E.replicate_parameters(known, PARTS, REPS), PARTS), "radius")


REFS = CENTERS_SQL + ", refs as materialized (select * from centers where unit_state = 'U')"
_D = "sqrt(" + " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in Z) + ")"


def points_and_refs(spark, d):
    """Prepared points, and the centres of unweathered units as a table written once: both from one fit."""
    points = prepared(spark, d)
    return points, materialise(lr.unit_centers(points, PARTS, carry=("label", "unit_state")).where("unit_state = 'U'"), "refs")


@register(S.query(f"select label, point_id, round(min(dd), 6) as distance from (select x.label, x.point_id, {_D} as dd from z x join refs y on x.label = y.label) group by 1, 2", PREP, REFS))
def c3_nearest_reference(spark, d):
    points, refs = points_and_refs(spark, d)
    return rounded(E.nearest_reference(points, refs, Z, ["label"]).select("label", "point_id", "distance"), "distance")


THRESHOLD = f"threshold as materialized (select label, quantile_cont(dd, 0.95) as threshold, count(*) as n_refs from (select x.label, x.unit_id, min({_D}) as dd from refs x join refs y on x.label = y.label and x.unit_id <> y.unit_id group by 1, 2) group by 1)"


@register(S.query("select label, round(threshold, 6) as threshold, n_refs from threshold", PREP, REFS, THRESHOLD))
def c4_domain_threshold(spark, d):
    return rounded(E.domain_threshold(points_and_refs(spark, d)[1], Z, ["label"]), "threshold")


@register(S.query(f"select label, round(avg(a.effect_norm - b.effect_norm), 6) + 0.0 as mean_difference, count(*) as n from boot a join (select rep, label, effect_norm from boot) b using (rep) where a.label < b.label group by a.label".replace("select label", "select a.label"), BOOT))
def c5_paired_metrics(spark, d):
    boot = E.boot_effect(orders.known_points(spark, d), PARTS, REPS).select("rep", "label", "effect_norm")
    a, b = boot.alias("a"), boot.alias("b")
    pairs = a.join(b, (F.col("a.rep") == F.col("b.rep")) & (F.col("a.label") < F.col("b.label")))
    return pairs.groupBy(F.col("a.label").alias("label")).agg(F.round(F.avg(F.col("a.effect_norm") - F.col("b.effect_norm")), 6).alias("mean_difference"), F.count("*").alias("n"))


@register(S.query(f"select point_id, round(dd, 6) as distance, dd > threshold as outside from (select x.label, x.point_id, min({_D}) as dd from z x join refs y on x.label = y.label where x.state = 'W' group by 1, 2) join threshold using (label)", PREP, REFS, THRESHOLD))
def k4_applicability(spark, d, known=None):
    points, refs = known or points_and_refs(spark, d)
    near = E.nearest_reference(points.where("state = 'W'"), refs, Z, ["label"])
    told = near.join(F.broadcast(E.domain_threshold(refs, Z, ["label"])), "label")
    return rounded(told.select("point_id", "distance", (F.col("distance") > F.col("threshold")).alias("outside")), "distance")


@register(None)
def k5_robust_distance(spark, d, known=None):
    """Points in state W against the unweathered units of their label: robust distance, its threshold, and whether it is beyond."""
    points, refs = known or points_and_refs(spark, d)
    told = robust.robust_flags(points.where("state = 'W'"), refs, Z, "label")
    return rounded(told.select("point_id", "robust_distance", "robust_threshold", "outside"), "robust_distance", "robust_threshold", digits=4)


@register(None)
def k11_domain(spark, d):
    """The whole rule of applicability: beyond the nearest-reference threshold of the label, or beyond the robust one."""
    known = points_and_refs(spark, d)
    near, far = k4_applicability(spark, d, known).select("point_id", "distance", F.col("outside").alias("near_")), k5_robust_distance(spark, d, known)
    return near.join(far, "point_id").select("point_id", "distance", "robust_distance", (F.col("near_") | F.coalesce("outside", F.lit(False))).alias("outside"))


@register(S.query(f"select point_id, part, round(value, 6) as estimate, true as modeled from ({S.long('cf', 'point_id', column='cf_{p}')}) union all select point_id, 'other', null, false from cf", WEIGHTED, MAIN, SHIFTS, CF))
def k6_long(spark, d):
    cf = shifted(spark, d)
    rows = audit.unpivot(cf.select("point_id", *[F.col(f"cf_{p}").alias(p) for p in PARTS]).withColumn("other", F.lit(None).cast("double")), ["point_id"], [*PARTS, "other"])
    return rows.select("point_id", "part", F.round("value", 6).alias("estimate"), F.col("value").isNotNull().alias("modeled"))


_RATIO = f"""ratios as (select label, part, quantile_cont(value, 0.5) filter (where state = 'W') / nullif(quantile_cont(value, 0.5) filter (where state = 'U'), 0) as ratio from ({S.long("known", "label, state")}) group by 1, 2),
wide as (select label, {", ".join(f"max(ratio) filter (where part = '{p}') as q_{p}" for p in PARTS)} from ratios group by 1),
rbe as (select jw.point_id, {S.each("{p} / coalesce(q_{p}, 1.0) as e_{p}")} from jw join wide using (label) where state = 'W')"""


@register(S.query(f"select point_id, {S.each('round({p}, 6) + 0.0 as rb_{p}')} from (select point_id, {S.closed_columns('e_')} from rbe)", WEIGHTED, _RATIO))
def k7_ratio_baseline(spark, d):
    known = orders.written_known(spark, d)
    return select6(E.ratio_baseline(weighted(spark, d, known=known), audit.median_ratio(known, PARTS, "label"), PARTS), ["point_id"], [f"rb_{p}" for p in PARTS])


_CF2 = "main2 as (select label, " + ", ".join(f"b_{i}" for i in IDX) + " from q1e), shifts2 as (select label, " + ", ".join(f"{S.linear([r[k] for r in _BASIS], [f'b_{i}' for i in IDX])} as s_{p}" for k, p in enumerate(PARTS)) + f" from main2), cfe2 as (select q1w.*, {S.each('{p} * exp(-s_{p}) as e_{p}')} from q1w join shifts2 using (label) where state = 'W'), cf2 as materialized (select point_id, {S.closed_columns('e_', out='cf_')} from cfe2)"


@register(S.query("select a.point_id, " + ", ".join(f"round(abs(b.cf_{p} - a.cf_{p}) / a.cf_{p}, 5) + 0.0 as change_{p}" for p in PARTS) + " from cf a join cf2 b using (point_id)", WEIGHTED, MAIN, SHIFTS, CF, *_SENS_CTES[:2], *_SENS_CTES[5:8], _CF2))
def k8_sensitivity(spark, d):
    low = weighted(spark, d, 0.25)
    other = E.counterfactual(low, E.state_effect(low, PARTS, ["label"]), PARTS).select("point_id", *[F.col(f"cf_{p}").alias(f"o_{p}") for p in PARTS])
    return shifted(spark, d).join(other, "point_id").select("point_id", *[F.round(F.abs(F.col(f"o_{p}") - F.col(f"cf_{p}")) / F.col(f"cf_{p}"), 5).alias(f"change_{p}") for p in PARTS])


@register(S.query(f"select label, part, round(avg(observed), 6) as mean_observed, round(avg(value), 6) as mean_estimate, 0 as not_positive from ({' union all '.join(f'''select label, '{p}' as part, {p} as observed, cf_{p} as value from cf''' for p in PARTS)}) group by 1, 2", WEIGHTED, MAIN, SHIFTS, CF))
def k9_checks(spark, d):
    cf = shifted(spark, d)
    each = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("observed"), F.col(f"cf_{p}").alias("value")) for p in PARTS])
    cells = cf.select("label", F.explode(each).alias("c")).select("label", "c.*")
    return rounded(cells.groupBy("label", "part").agg(F.avg("observed").alias("mean_observed"), F.avg("value").alias("mean_estimate"), F.sum((F.col("value") <= 0).cast("int")).alias("not_positive")), "mean_observed", "mean_estimate")


#: The same jobs under the names that they had while the others read a sample.
for _old, _new in (("c3_nearest_reference", "c6_nearest_all"), ("c4_domain_threshold", "c7_threshold_all"), ("k4_applicability", "k10_applicability_all")):
    QUERIES[_new], SQL[_new] = QUERIES[_old], SQL[_old]


@register(S.query(f"select label, count(*) as successes, {REPS} - count(*) as failures, count(*) >= 0.8 * {REPS} as enough from boot where effect_norm is not null group by 1", BOOT))
def j11_boot_failures(spark, d):
    return E.boot_failures(E.boot_effect(orders.known_points(spark, d), PARTS, REPS), REPS)
