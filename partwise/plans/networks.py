"""Queries of categorical association and proportionality networks (inventory I, O)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators import network as N
from ..operators.audit import contingency
from ..operators.keys import dummy_code, encode_binary, merge_rare, unknown_level
from ..sources import orders
from ..sources.orders import PARTS
from . import sql as S
from .prepare import rounded, select6

QUERIES, SQL = {}, {}
#: Replicates of the bootstrap and of the permutation.
REPS, PERMS = 1_000, 10_000


def register(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return keep


def cells_sql(src: str, a: str, b: str, out: str = "cells") -> str:
    return f"{out} as materialized (select a, b, coalesce(n, 0) as observed, row_n * column_n / total_n as expected from (select {a} a, count(*) row_n from {src} where {a} is not null and {b} is not null group by 1) cross join (select {b} b, count(*) column_n from {src} where {a} is not null and {b} is not null group by 1) cross join (select count(*) total_n from {src} where {a} is not null and {b} is not null) left join (select {a} a, {b} b, count(*) n from {src} group by 1, 2) using (a, b))"


V = "(case when least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1) > 0 then sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)) else 0 end)"
AGG = "sum((observed - expected) * (observed - expected) / expected) chi2, count(distinct a) r, count(distinct b) k, sum(observed) n"


def pattern_state(spark, d):
    return contingency(orders.raw_units(spark, d), "pattern", "state")


@register(S.query(f"select round(chi2, 6) as chi2, (r - 1) * (k - 1) as df, n, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) as p, sparse from (select {AGG}, min(expected) < 1 or avg(cast(expected < 5 as int)) > 0.2 as sparse from cells)", cells_sql("units", "pattern", "state")))
def i1_chi2(spark, d):
    return rounded(A.chi2_test(pattern_state(spark, d)).select("chi2", "df", "n", "p", "sparse"), "chi2", "p")


@register(None)
def i2_fisher(spark, d):
    return A.fisher_exact(contingency(orders.raw_units(spark, d), "label", "state"))


@register(None)
def i3_perm_chi2(spark, d):
    return A.perm_p(pattern_state(spark, d), 10_000)


@register(S.query(f"select round({V}, 6) as v from (select {AGG} from cells)", cells_sql("units", "pattern", "state")))
def i4_cramers_v(spark, d):
    return rounded(A.cramers_v(pattern_state(spark, d)), "v")


@register(None)
def i5_boot_v(spark, d):
    return A.boot_v(pattern_state(spark, d), 1_000)


@register(S.query(f"select da as a, db as b, units, round({V}, 6) as v from (select da, db, units, {AGG} from (select da, db, units, a, b, o as observed, sum(o) over (partition by da, db, a) * sum(o) over (partition by da, db, b) / sum(o) over (partition by da, db) as expected from (select x.a da, x.b db, x.observed units, y.a, y.b, y.observed - cast(x.a = y.a and x.b = y.b as int) o from cells x cross join cells y where x.observed > 0)) group by 1, 2, 3)", cells_sql("units", "pattern", "state")))
def i6_loo_v(spark, d):
    return rounded(A.loo_v(pattern_state(spark, d)), "v")


def coded(spark, d):
    return dummy_code(encode_binary(orders.raw_units(spark, d), "state", {"U": 0, "W": 1}, "y"), "pattern")


@register(None)
def i7_logistic(spark, d):
    df = coded(spark, d)
    return A.logistic_glm(df, "y", [c for c in df.columns if c.startswith("pattern_")])


@register(None)
def i8_ridge(spark, d):
    df = coded(spark, d)
    return rounded(A.logistic_ridge(df, "y", [c for c in df.columns if c.startswith("pattern_")]), "beta", "se", "odds_ratio", "ci_low", "ci_high")


_SC = [cells_sql("u0", "color", "state", "c0"), cells_sql("units", "color", "state", "c1"), cells_sql("u2", "color", "state", "c2")]
_SC0 = "u0 as (select unit_id, state, coalesce(color, 'unknown') as color from units), u2 as (select unit_id, state, case when n < 62 then 'other' else color end as color from units left join (select color, count(*) n from units group by color) using (color))"


@register(S.query(" union all ".join(f"select '{s}' as scenario, round(chi2, 6) as chi2, (r - 1) * (k - 1) as df, n, round({V}, 6) as v from (select {AGG} from c{i})" for i, s in enumerate(("unknown_level", "complete_case", "rare_merged"))), _SC0, *_SC))
def i9_scenarios(spark, d):
    u = orders.raw_units(spark, d)
    return rounded(A.assoc_scenarios({"unknown_level": unknown_level(u, "color"), "complete_case": unknown_level(u, "color", True), "rare_merged": merge_rare(u, "color", 62)}, "color", "state"), "chi2", "v")


PAIRS = list(combinations(PARTS, 2))


def centers_sql(src: str, keys: str, out: str, carry: str = "") -> str:
    """Units' centres of ``src`` (with ilr) and centred logs ``l_p``; ``keys`` come before the unit."""
    group = f"{keys}, unit_id" if keys else "unit_id"
    means = f"{out}m as materialized (select {group}{', ' + carry if carry else ''}, {', '.join(f'avg({c}) as {c}' for c in S.ILR)} from {src} group by {group})"
    logs = [S.linear([r[k] for r in S.helmert(len(PARTS))], S.ILR) for k in range(len(PARTS))]  # the inverse transform in logs is centred
    return f"{means},\n{out} as materialized (select *, {', '.join(f'{e} as l_{p}' for e, p in zip(logs, PARTS, strict=True))} from {out}m)"


def edges_sql(src: str, keys: str, out: str, w: str = "1.0") -> str:
    sums = ", ".join([f"sum({w}) as n_", *[f"sum({w} * l_{p}) as s_{p}, sum({w} * l_{p} * l_{p}) as q_{p}" for p in PARTS], *[f"sum({w} * l_{j} * l_{k}) as x_{j}_{k}" for j, k in PAIRS]])
    var = lambda p: f"((q_{p} - s_{p} * s_{p} / n_) / (n_ - 1))"
    cov = lambda j, k: f"((x_{j}_{k} - s_{j} * s_{k} / n_) / (n_ - 1))"
    rows = " union all ".join(f"select {keys}, '{j}' as part_j, '{k}' as part_k, {var(j)} + {var(k)} - 2 * {cov(j, k)} as variation, 2 * {cov(j, k)} / ({var(j)} + {var(k)}) as rho from {out}s" for j, k in PAIRS)
    return f"{out}s as materialized (select {keys}, {sums} from {src} group by {keys}),\n{out} as materialized ({rows})"


MAIN = ",\n".join([S.grouped_ctes("known", "label", "j"), centers_sql("jz", "", "cen", "min(label) as label, min(unit_state) as unit_state"), edges_sql("cen", "label", "main")])
BOOT = ",\n".join([f"bdraw as materialized (select unit_id, rep, {S.poisson()} as m from {S.drawn('known', 'boot', REPS)}),\nbpos as materialized (select k.*, rep, m from known k join bdraw using (unit_id) where m > 0)", S.grouped_ctes("bpos", "rep, label", "b", weight="m"), centers_sql("bz", "rep", "bcen", "min(label) as label, min(m) as m"), edges_sql("bcen", "rep, label", "boot", "cast(m as double)")])


@register(S.query("select label, part_j, part_k, round(variation, 6) as variation, round(rho, 6) + 0.0 as rho from main", MAIN))
def o1_edges(spark, d):
    return rounded(N.main_edges(orders.known_points(spark, d), PARTS), "variation", "rho")


TABLE = "tab as materialized (select m.*, ci_low, ci_high, selection_frequency, direction_frequency, successes, abs(rho) >= 0.1 and selection_frequency >= 0.7 and direction_frequency >= 0.8 as core from main m join (select b.label, b.part_j, b.part_k, quantile_cont(b.rho, 0.025) ci_low, quantile_cont(b.rho, 0.975) ci_high, avg(cast(abs(b.rho) >= 0.1 as int)) selection_frequency, avg(cast(sign(b.rho) = sign(a.rho) as int)) direction_frequency, count(*) successes from boot b join main a using (label, part_j, part_k) group by 1, 2, 3) using (label, part_j, part_k))"


@register(S.query("select label, part_j, part_k, round(rho, 6) + 0.0 as rho, round(ci_low, 6) + 0.0 as ci_low, round(ci_high, 6) + 0.0 as ci_high, round(selection_frequency, 6) as selection_frequency, round(direction_frequency, 6) as direction_frequency, successes, core from tab", MAIN, BOOT, TABLE))
def o2_boot_edges(spark, d):
    known = orders.written_known(spark, d)
    out = N.edge_table(N.main_edges(known, PARTS), N.boot_edges(known, PARTS, REPS), 0.1).drop("variation")
    return rounded(out, "rho", "ci_low", "ci_high", "selection_frequency", "direction_frequency")


_ADJ = ",\n".join(["adj as materialized (select label, " + ", ".join(f"l_{p} - avg(l_{p}) over (partition by label, unit_state) as l_{p}" for p in PARTS) + " from cen)", edges_sql("adj", "label", "adjusted")])


@register(S.query("select label, part_j, part_k, round(variation, 6) as variation, round(rho, 6) + 0.0 as rho from adjusted", MAIN, _ADJ))
def o3_adjusted_edges(spark, d):
    return rounded(N.adjusted_edges(orders.known_points(spark, d), PARTS), "variation", "rho")


@register(None)
def o4_partial_corr(spark, d):
    known = orders.known_points(spark, d)
    main = N.partial_corr(N.log_centers(N.fitted(known, PARTS), PARTS), PARTS)
    return rounded(N.partial_table(main, N.boot_partials(known, PARTS, REPS)), "partial", "shrinkage", "ci_low", "ci_high", "direction_frequency")


@register(None)
def o5_diff_edges(spark, d):
    known = orders.known_points(spark, d)
    out = N.diff_edges(N.main_edges(known, PARTS), N.boot_edges(known, PARTS, REPS), N.perm_edges(known, PARTS, PERMS), PERMS)
    return rounded(out.select("part_j", "part_k", "delta", "ci_low", "ci_high", "direction_frequency", "p", "p_fdr", "core"), "delta", "ci_low", "ci_high", "direction_frequency", "p", "p_fdr")


@register(None)
def o6_perm_edges(spark, d):
    """10,000 permutations of the labels: too many for SQL that prepares every point in each; tests compare few with brute force."""
    return rounded(N.perm_edges(orders.known_points(spark, d), PARTS, PERMS), "rho")


@register(S.query(f"select rep, label, count(case when abs(b.rho) >= 0.1 then 1 end) as n_edges, round(count(case when abs(b.rho) >= 0.1 then 1 end) / {len(PAIRS)}, 6) as density, round(coalesce(count(case when abs(b.rho) >= 0.1 and abs(m.rho) >= 0.1 then 1 end) / nullif(count(case when abs(b.rho) >= 0.1 or abs(m.rho) >= 0.1 then 1 end), 0), 1.0), 6) as jaccard from boot b join main m using (label, part_j, part_k) group by 1, 2", MAIN, BOOT))
def o7_stability(spark, d):
    known = orders.written_known(spark, d)
    return rounded(N.network_stability(N.main_edges(known, PARTS), N.boot_edges(known, PARTS, REPS), PARTS, 0.1), "density", "jaccard")


_SC_O = [("main", "main", 0.1), ("zero_c_0.25", "low", 0.1), ("threshold_0.2", "main", 0.2), ("with_invalid", "every", 0.1)]
_SENS = ",\n".join([
    S.grouped_ctes("known", "label", "q", 0.25), centers_sql("qz", "", "qcen", "min(label) as label"), edges_sql("qcen", "label", "low"),
    "everyone as materialized (select * from allp where unit_id % 50 <> 0)", S.grouped_ctes("everyone", "label", "v"), centers_sql("vz", "", "vcen", "min(label) as label"), edges_sql("vcen", "label", "every"),
])


@register(S.query(" union all ".join(f"select '{n}' as scenario, label, cast(sum(cast(abs(s.rho) >= {t} as int)) as bigint) as n_edges, round(coalesce(sum(cast(abs(s.rho) >= {t} and abs(m.rho) >= 0.1 as int)) / nullif(sum(cast(abs(s.rho) >= {t} or abs(m.rho) >= 0.1 as int)), 0), 1.0), 6) as jaccard, round(avg(cast(sign(s.rho) = sign(m.rho) as int)), 6) as sign_agreement from {x} s join main m using (label, part_j, part_k) group by label" for n, x, t in _SC_O), MAIN, _SENS))
def o8_sensitivity(spark, d):
    everyone = orders.written_labelled(spark, d)
    known = everyone.where("valid")
    main = N.main_edges(known, PARTS)
    scenarios = {"main": (main, 0.1), "zero_c_0.25": (N.main_edges(known, PARTS, 0.25), 0.1), "threshold_0.2": (main, 0.2), "with_invalid": (N.main_edges(everyone, PARTS), 0.1)}
    return rounded(N.network_sensitivity(scenarios, PARTS), "jaccard", "sign_agreement")
