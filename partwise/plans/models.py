"""Queries of classification, sub-classes, frozen scoring and evidence (inventory A4, L, M, N, P)."""

from __future__ import annotations

from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import uniform
from ..operators import audit, classify, cluster, evidence, nested, pipelines, robust, trees
from ..operators import effect as E
from ..operators import network as N
from ..operators.keys import perturb, unit_folds
from ..operators.logratio import balances
from ..operators.refit import weightings
from ..sources import orders
from ..sources.shared import materialise, shared_path
from ..sources.orders import PARTS
from . import sql as S
from .networks import MAIN as CENTERS_SQL
from .prepare import BALANCES_SQL, LIBRARY, prepared, rounded, scored
from .prepare import _SCORED as SCORED

QUERIES, SQL = {}, {}
LIB = {k: v for k, v in LIBRARY.items() if k != "absent"}
NAMES = list(LIB)


def register(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return keep


def folds_of(known, k: int = 3, reps: int = 2):
    return unit_folds(known.groupBy("unit_id").agg(F.min("label").alias("label")), k, reps)


_L1 = f"""fu as (select unit_id, min(label) as label from known group by 1),
fo as materialized (select unit_id, rep, (row_number() over (partition by rep, label order by {S.uniform("'fold'", "rep", "unit_id")}, unit_id) - 1) % 3 as fold from fu, (select unnest(range(2)) as rep)),
fr as materialized (select known.*, rep, target, case when fold = target then 'validation' else 'train' end as role from known join fo using (unit_id), (select unnest(range(3)) as target)),
fm as materialized (select rep, target, state, {S.each("quantile_cont({p}, 0.5) as m_{p}")} from fr where role = 'train' group by 1, 2, 3),
ff as materialized (select fr.* exclude ({", ".join(PARTS)}), {S.each("coalesce(fr.{p}, m_{p}) as {p}")} from fr join fm using (rep, target, state)),
fd as materialized (select rep, target, {S.each("0.5 * min(case when {p} > 0 then {p} end) as d_{p}")} from ff where role = 'train' group by 1, 2),
fz as (select ff.* exclude ({", ".join(PARTS)}), {S.each("case when ff.{p} = 0 then d_{p} else ff.{p} end as {p}")} from ff join fd using (rep, target))"""


@register(S.query("select rep, target, role, unit_id, label, count(*) as n_points, " + ", ".join(f"round(avg({b}), 6) + 0.0 as {b}" for b in NAMES) + f" from (select *, {BALANCES_SQL} from fz) group by 1, 2, 3, 4, 5", _L1))
def l1_split_features(spark, d):
    known = orders.written_known(spark, d)
    return rounded(classify.split_features(known, folds_of(known), PARTS, LIB), *NAMES)


def labelled_units(spark, d):
    units = balances(prepared(spark, d), LIB).groupBy("unit_id", "label").agg(*[F.avg(b).alias(b) for b in NAMES])
    units = materialise(units.withColumns({"y": (F.col("label") == "PB").cast("int"), "one": F.lit(1), "role": F.lit("train")}), "units")
    return classify.standardised(units, ["one"], NAMES)


def _coefs(spark, beta, keys="one int"):
    rows = [(*k, *map(float, b)) for k, b in beta.items()]
    return rounded(spark.createDataFrame(rows, f"{keys}, " + ", ".join(f"{n} double" for n in [*NAMES, "intercept"])), *NAMES, "intercept")


@register(None)
def l2_logistic(spark, d):
    return _coefs(spark, classify.batched_logistic(labelled_units(spark, d), ["one"], NAMES))


@register(None)
def l3_tree(spark, d):
    """Nodes of a tree of depth 3 over all known units."""
    known = orders.known_points(spark, d)
    w = weightings(known, PARTS, LIB, pipelines.Every(), 1, known.select("unit_id").distinct().withColumns({"a_": F.lit(0).cast("long"), "b_": F.lit(0).cast("long")}))
    try:
        edges = trees.bin_edges(w)
        tree = trees.grow(w, edges, [(5, True)], 3)[0][5, True].pruned(3, 0.005)
    finally:
        w.close()
    way = lambda p: " and ".join(f"{NAMES[f]} {'>' if right else '<='} {edges[f][cut]:.4f}" for f, cut, right in p)
    rows = [(way(p), len(p), float(n[0]), float(n[1]), p not in tree.splits, tree.probability(p)) for p, n in sorted(tree.nodes.items())]
    return rounded(spark.createDataFrame(rows, "node string, depth int, n0 double, n1 double, leaf boolean, probability double"), "probability")


@register(None)
def l4_lda(spark, d):
    return _coefs(spark, classify.lda(labelled_units(spark, d), ["one"], NAMES))


@register(None)
def l5_tune(spark, d):
    return rounded(nested.tuning_table(known_of(spark, d), PARTS, LIB), "balanced_accuracy", "threshold")


@register(None)
def l6_nested_cv(spark, d):
    """The out-of-fold table of the chain: every unit once per repeat and model."""
    return rounded(chain_of(spark, d).oof, "score", "threshold")


def oof(spark, d):
    """An out-of-fold table from the data: two models' scores of every unit in three repeats."""
    rows = scored(spark, d).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
    a = rows.withColumn("model", F.lit("logistic")).withColumn("score", F.round(F.col("score") * 0.8 + 0.2 * uniform(F.lit("a"), "rep", "unit_id"), 4))
    b = rows.withColumn("model", F.lit("tree")).withColumn("score", F.round(F.col("score") * 0.5 + 0.5 * uniform(F.lit("b"), "rep", "unit_id"), 4))
    return a.unionByName(b).select("rep", "unit_id", "y", "model", "score")


_OOF = f"oof as materialized (select rep, unit_id, y, 'logistic' as model, round(score * 0.8 + 0.2 * {S.uniform(chr(39) + 'a' + chr(39), 'rep', 'unit_id')}, 4) as score from scored, (select unnest(range(3)) as rep) union all select rep, unit_id, y, 'tree', round(score * 0.5 + 0.5 * {S.uniform(chr(39) + 'b' + chr(39), 'rep', 'unit_id')}, 4) from scored, (select unnest(range(3)) as rep))"
_CONF = "cf as (select rep, model, cast(sum(cast(score >= 0.5 and y = 1 as int)) as double) tp, cast(sum(cast(score < 0.5 and y = 1 as int)) as double) fn, cast(sum(cast(score >= 0.5 and y = 0 as int)) as double) fp, cast(sum(cast(score < 0.5 and y = 0 as int)) as double) tn, avg((score - y) * (score - y)) brier from oof group by 1, 2), au as (select rep, model, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) auc from (select *, rank() over (partition by rep, model order by score) + (count(*) over (partition by rep, model, score) - 1) / 2 rk from oof) group by 1, 2), met as materialized (select rep, model, (tp / (tp + fn) + tn / (tn + fp)) / 2 as balanced_accuracy, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 as macro_f1, brier, auc from cf join au using (rep, model))"


@register(S.query("select rep, model, round(balanced_accuracy, 6) as balanced_accuracy, round(macro_f1, 6) as macro_f1, round(brier, 6) as brier, round(auc, 6) as auc from met", SCORED, _OOF, _CONF))
def l7_metrics(spark, d):
    return rounded(classify.class_metrics(oof(spark, d)), "balanced_accuracy", "macro_f1", "brier", "auc")


@register(S.query("select model, y, predicted, count(s.unit_id) as n from (select distinct model from oof) cross join (select unnest([0, 1]) as y) cross join (select unnest([0, 1]) as predicted) left join (select unit_id, model, y, cast(score >= 0.5 as int) as predicted from oof) s using (model, y, predicted) group by 1, 2, 3", SCORED, _OOF))
def l9_confusion(spark, d):
    return classify.confusion(oof(spark, d))


@register(S.query("select metric, model_a, model_b, round(avg(dd), 6) + 0.0 as mean, round(quantile_cont(dd, 0.025), 6) + 0.0 as ci_low, round(quantile_cont(dd, 0.975), 6) + 0.0 as ci_high from (select 'balanced_accuracy' as metric, a.model model_a, b.model model_b, a.balanced_accuracy - b.balanced_accuracy as dd from met a join met b using (rep) where a.model < b.model union all select 'brier', a.model, b.model, a.brier - b.brier from met a join met b using (rep) where a.model < b.model) group by 1, 2, 3", SCORED, _OOF, _CONF))
def l10_comparison(spark, d):
    return rounded(classify.model_comparison(classify.class_metrics(oof(spark, d))), "mean", "ci_low", "ci_high")


@register(S.query("select model, round(accuracy, 6) as accuracy, round(brier, 6) as brier, eligible, eligible and rank = min(case when eligible then rank end) over () as selected from (select *, accuracy >= max(accuracy) over () - first_value(coalesce(se, 0)) over (order by accuracy desc) and brier <= min(brier) over () + 0.02 as eligible, case model when 'tree' then 1 else 0 end as rank from (select model, avg(balanced_accuracy) accuracy, stddev_samp(balanced_accuracy) / sqrt(count(*)) se, avg(brier) brier from met group by 1))", SCORED, _OOF, _CONF))
def l12_select(spark, d):
    return rounded(classify.select_model(classify.class_metrics(oof(spark, d)), {"logistic": 0, "tree": 1}), "accuracy", "brier")


#: Scenarios whose steps run side by side: each is many short passes.
TOGETHER = 4
#: What a session has already decided and frozen for a folder of tables: the chain takes many passes and is the same each time.
_KEPT: dict = {}


def _kept(spark, d, name, make):
    key = spark.sparkContext.applicationId, d, name
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def known_of(spark, d):
    """Known points, written once for all steps of the chain: cross-validation, final fits, bootstrap, references."""
    return _kept(spark, d, "known", lambda: orders.written_known(spark, d))


def chain_of(spark, d) -> pipelines.Chain:
    return _kept(spark, d, "chain", lambda: pipelines.choose(known_of(spark, d), PARTS, LIB))


def pipeline_of(spark, d, zero_c: float = 0.5, group: str | None = "state"):
    chain = chain_of(spark, d)
    return pipelines.train_final(known_of(spark, d), PARTS, LIB, chain.configs, chain.decisions, chain.selected, zero_c, group)


def frozen(spark, d, zero_c: float = 0.5, group: str | None = "state"):
    """A pipeline that went through files in the shared folder, as scoring must take it."""

    def write():
        path = shared_path(spark, "frozen")
        return path, classify.freeze(spark, pipeline_of(spark, d, zero_c, group), path)

    path, mark = _kept(spark, d, f"frozen {zero_c} {group}", write)
    return classify.load_frozen(spark, path), mark


def boot_of(spark, d) -> pipelines.Replicated:
    chain = chain_of(spark, d)
    return _kept(spark, d, "boot", lambda: pipelines.boot_pipelines(known_of(spark, d), PARTS, LIB, chain.configs, chain.selected))


@register(None)
def a4_freeze(spark, d):
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(frozen(spark, d)[0].items())], "name string, value string")


@register(None)
def l8_calibration(spark, d):
    return rounded(classify.calibration_fit(chain_of(spark, d).oof, ["rep", "model"]), "intercept", "slope", digits=4)


@register(None)
def l11_gate(spark, d):
    return rounded(chain_of(spark, d).decisions, "raw_threshold", "brier_gain", "accuracy_change", "slope", "intercept", "threshold")


@register(None)
def l13_final_fit(spark, d):
    return rounded(classify.coef_table(spark, pipeline_of(spark, d)), "coef", "odds_ratio")


@register(None)
def l14_boot_pipelines(spark, d):
    """A row a replicate: the selected model's coefficients (none for a tree), or why it has no fit."""
    boot = boot_of(spark, d)
    rows = [(k, boot.model, boot.failed.get(k), [round(float(v), 6) for v in boot.fits[k]] if k in boot.fits and boot.model != "tree" else None) for k in range(boot.tried)]
    return spark.createDataFrame(rows, "rep int, model string, failed string, coefs array<double>").withColumn("coefs", F.array_join(F.col("coefs").cast("array<string>"), " "))


@register(None)
def l15_sensitivity(spark, d):
    """The chosen setting over five folds of one repeat under each scenario, and its distance from the main one."""
    chain = chain_of(spark, d)
    every = materialise(orders.points(spark, d).where("unit_id % 50 <> 0").select("point_id", "unit_id", "label", "state", "valid", *PARTS), "scenarios")
    known = every.where("valid")
    scenarios = [("main", known, 0.5, "state"), ("zero_c_0.25", known, 0.25, "state"), ("zero_c_0.75", known, 0.75, "state"), ("global_median", known, 0.5, None), ("include_invalid", every, 0.5, "state")]
    scenarios += [(f"perturbed_{round(100 * r)}", perturb(known, PARTS, r, 0, "point_id"), 0.5, "state") for r in (0.05, 0.1)]
    model = chain.selected
    threshold = {r["model"]: r["raw_threshold"] for r in chain.decisions.collect()}[model]

    def judge(scenario):
        name, df, c, group = scenario
        return pipelines.fixed_cv(df, PARTS, LIB, model, chain.configs[model], threshold, zero_c=c, group=group).withColumn("scenario", F.lit(name))

    with ThreadPool(TOGETHER) as pool:
        jobs = [inheritable_thread_target(spark)(partial(judge, s)) for s in scenarios]
        out = reduce(DataFrame.unionByName, pool.map(lambda job: job(), jobs))
    main = out.where("scenario = 'main'").first()["balanced_accuracy"]
    return rounded(out.withColumn("delta", F.col("balanced_accuracy") - F.lit(main)), "balanced_accuracy", "brier", "delta")


@register(None)
def l16_coefs(spark, d):
    return rounded(classify.coef_table(spark, frozen(spark, d)[0]), "coef", "odds_ratio")


@register(None)
def l17_choice(spark, d):
    """The models' accuracy and Brier score over real out-of-fold scores, which of them may be chosen and which is."""
    return rounded(chain_of(spark, d).choice, "accuracy", "brier")


@register(None)
def l18_fold_metrics(spark, d):
    return rounded(chain_of(spark, d).metrics, "balanced_accuracy", "macro_f1", "brier", "auc")


def centers_of(spark, d, known=None):
    """Units' centres as a table written once, from points that are written once (``known``, if the caller has them)."""
    known = orders.written_known(spark, d) if known is None else known
    return materialise(N.log_centers(N.fitted(known, PARTS), PARTS, carry=("label", "unit_state", "pattern")), "centers")


_RANKS = "rk as materialized (select label, unit_id, " + ", ".join(f"rank() over (partition by label order by l_{p}) + (count(*) over (partition by label, l_{p}) - 1) / 2 as r_{p}" for p in PARTS) + " from cen)"


@register(S.query(" union all ".join(f"select label, '{j}' as part_j, '{k}' as part_k, round(corr(r_{j}, r_{k}), 5) + 0.0 as rho from rk group by label" for i, j in enumerate(PARTS) for k in PARTS[i + 1 :]), CENTERS_SQL, _RANKS))
def m1_spearman(spark, d):
    return rounded(cluster.clr_spearman(centers_of(spark, d), PARTS), "rho", digits=5)


@register(None)
def m2_representatives(spark, d):
    known = orders.written_known(spark, d)
    return rounded(cluster.variable_selection(known, centers_of(spark, d, known), PARTS), "detection_rate", "mad")


#: Numbers of clusters that are tried, bootstrap replicates, and splits of the prediction strength.
KS, REPS, SPLITS = (2, 3, 4, 5, 6), 1_000, 20


def _cluster(method: str, spark, d):
    return cluster.cluster_grid(centers_of(spark, d), S.ILR, KS, method)


m3_bisecting, m3_kmeans, m3_gmm = (partial(_cluster, m) for m in ("bisecting", "kmeans", "gmm"))
QUERIES |= {"m3_bisecting": m3_bisecting, "m3_kmeans": m3_kmeans, "m3_gmm": m3_gmm}

_CM = "cc as (select pattern, count(*) n, " + ", ".join(f"avg({c}) as m_{c}" for c in S.ILR) + " from cp group by 1), cg as (select count(*) total, " + ", ".join(f"avg({c}) as g_{c}" for c in S.ILR) + " from cp), cw as materialized (select pattern, n, " + ", ".join(f"m_{c}" for c in S.ILR) + ", sum(" + " + ".join(f"({c} - m_{c}) ^ 2" for c in S.ILR) + ") as w, avg(sqrt(" + " + ".join(f"({c} - m_{c}) ^ 2" for c in S.ILR) + ")) as s from cp join cc using (pattern) group by all)"


@register(S.query("select k, round((b / (k - 1)) / (w / (n - k)), 6) as calinski_harabasz, round(db, 6) as davies_bouldin, smallest from (select count(*) k, min(n) smallest, sum(w) w, sum(n) n, sum(n * (" + " + ".join(f"(m_{c} - g_{c}) ^ 2" for c in S.ILR) + ")) b from cw, cg), (select avg(r) db from (select x.pattern, max((x.s + y.s) / sqrt(" + " + ".join(f"(x.m_{c} - y.m_{c}) ^ 2" for c in S.ILR) + ")) r from cw x join cw y on x.pattern <> y.pattern group by 1))", CENTERS_SQL, "cp as materialized (select cen.*, u.pattern from cen join units u using (unit_id))", _CM))
def m4_metrics(spark, d):
    return rounded(cluster.cluster_metrics(centers_of(spark, d), S.ILR, "pattern"), "calinski_harabasz", "davies_bouldin")


_ARI = "select label, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) + 0.0 as ari from (select label, sum(n * (n - 1) / 2) s, sum(n) t from (select label, pattern, state, cast(count(*) as double) n from units group by 1, 2, 3) group by 1) join (select label, sum(n * (n - 1) / 2) sa from (select label, pattern, cast(count(*) as double) n from units group by 1, 2) group by 1) using (label) join (select label, sum(n * (n - 1) / 2) sb from (select label, state, cast(count(*) as double) n from units group by 1, 2) group by 1) using (label)"


@register(S.query(_ARI))
def m5_ari(spark, d):
    return rounded(cluster.ari(orders.raw_units(spark, d), "pattern", "state", ["label"]), "ari")


@register(None)
def m6_align(spark, d):
    units = centers_of(spark, d)
    a, b = (cluster.cluster_grid(units, S.ILR, KS, m).withColumnRenamed("cluster", n) for m, n in (("kmeans", "a"), ("bisecting", "b")))
    cells: dict = {}
    for r in a.join(b, ["label", "k", "unit_id"]).groupBy("label", "k", "a", "b").agg(F.count("*").alias("n")).collect():
        cells.setdefault((r["label"], r["k"]), {})[r["b"], r["a"]] = r["n"]
    rows = [(label, k, *pair) for (label, k), own in sorted(cells.items()) for pair in sorted(cluster.align_labels(own, k).items())]
    return spark.createDataFrame(rows, "label string, k int, label_b int, label_a int")


@register(None)
def m7_prediction_strength(spark, d):
    return rounded(cluster.prediction_strength(centers_of(spark, d), S.ILR, KS, SPLITS), "strength")


@register(None)
def m8_stability(spark, d):
    return rounded(cluster.cluster_stability(centers_of(spark, d), S.ILR, KS, REPS), "ari")


@register(None)
def m13_chosen_k(spark, d):
    """The stability gate on the real clusterings: median and tenth percentile over replicates, smallest cluster."""
    units = centers_of(spark, d)
    runs = cluster.cluster_stability(units, S.ILR, KS, REPS).groupBy("label", "k").agg(F.percentile("ari", 0.5).alias("ari_median"), F.percentile("ari", 0.1).alias("ari_p10"))
    return cluster.stability_gate(runs.join(cluster.main_sizes(units, S.ILR, KS), ["label", "k"]))


def assigned(spark, d):
    """Replicated labelings from the data: a unit's pattern as main label, hashed labels as clusters."""
    rows = orders.raw_units(spark, d).select("unit_id", F.col("pattern").alias("main")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.withColumn("cluster", F.floor(uniform(F.lit("c"), "rep", "unit_id") * 3).cast("int"))


_AS = f"asg as materialized (select unit_id, pattern as main, rep, cast(floor({S.uniform(chr(39) + 'c' + chr(39), 'rep', 'unit_id')} * 3) as int) as cluster from units, (select unnest(range(4)) as rep)), pr as materialized (select x.main = y.main as same, x.cluster = y.cluster as together from asg x join asg y on x.rep = y.rep and x.unit_id < y.unit_id)"


@register(S.query("select case when same then 'within' else 'between' end as kind, round(avg(cast(together as int)), 6) as value from pr group by same", _AS))
def m9_consensus(spark, d):
    return rounded(cluster.consensus(assigned(spark, d)), "value")


_GATE = "g as (select label, k, round(n / 400, 6) as ari_median, round(n / 500, 6) as ari_p10, n as smallest from (select label, cast(rank() over (partition by label order by pattern) as int) k, n from (select label, pattern, count(*) n from units group by 1, 2)))"


@register(S.query("select label, k, passes, position = 1 as chosen, case when position = 1 then case when passes then 'stable' else 'exploratory' end end as status from (select *, row_number() over (partition by label order by case when passes then 0 else 1 end, case when passes then k else -ari_median end, k) as position from (select *, ari_median >= 0.43 and ari_p10 >= 0.3 and smallest >= 3 as passes from g))", _GATE))
def m10_gate(spark, d):
    from pyspark.sql import Window

    by = orders.raw_units(spark, d).groupBy("label", "pattern").agg(F.count("*").alias("n"))
    m = by.select("label", F.rank().over(Window.partitionBy("label").orderBy("pattern")).alias("k"), F.round(F.col("n") / 400, 6).alias("ari_median"), F.round(F.col("n") / 500, 6).alias("ari_p10"), F.col("n").alias("smallest"))
    return cluster.stability_gate(m, 0.43, 0.3)


@register(S.query(f"select pattern, part, round(g / sum(g) over (partition by pattern) * 100, 6) as center, round(median, 6) as median, round(q25, 6) as q25, round(q75, 6) as q75, n from (select pattern, part, exp(avg(ln(value))) g, quantile_cont(value, 0.5) median, quantile_cont(value, 0.25) q25, quantile_cont(value, 0.75) q75, count(*) n from ({S.long('jz', 'pattern')}) group by 1, 2)", S.grouped_ctes("known", "label", "j")))
def m11_profiles(spark, d):
    return rounded(cluster.profiles(N.fitted(orders.written_known(spark, d), PARTS), PARTS, ["pattern"]), "center", "median", "q25", "q75")


_M12 = "sc as (select 'half' as scenario, * from (select *, state as other from units where unit_id % 2 = 0) union all select 'inherited', * from (select *, case when unit_id % 5 = 0 then 'W' else state end as other from units))"


@register(S.query("select scenario, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) + 0.0 as ari from (select scenario, sum(n * (n - 1) / 2) s, sum(n) t from (select scenario, label, other, cast(count(*) as double) n from sc group by 1, 2, 3) group by 1) join (select scenario, sum(n * (n - 1) / 2) sa from (select scenario, label, cast(count(*) as double) n from sc group by 1, 2) group by 1) using (scenario) join (select scenario, sum(n * (n - 1) / 2) sb from (select scenario, other, cast(count(*) as double) n from sc group by 1, 2) group by 1) using (scenario)", _M12))
def m12_scenarios(spark, d):
    u = orders.raw_units(spark, d)
    half = u.where("unit_id % 2 = 0").withColumn("other", F.col("state")).withColumn("scenario", F.lit("half"))
    inherited = u.withColumn("other", F.when(F.col("unit_id") % 5 == 0, "W").otherwise(F.col("state"))).withColumn("scenario", F.lit("inherited"))
    return rounded(cluster.ari(half.unionByName(inherited), "label", "other", ["scenario"]), "ari")


@register(None)
def n1_frozen_check(spark, d):
    pipeline, mark = frozen(spark, d)
    return spark.createDataFrame([(mark, len(pipeline))], "fingerprint string, n_parameters int")


@register(None)
def n2_score(spark, d):
    told = pipelines.score_units(written_unknown(spark, d), frozen(spark, d)[0])
    return rounded(told.select("unit_id", *[f"{x}_{m}" for m in ("logistic", "tree", "lda") for x in ("p", "label")]), "p_logistic", "p_tree", "p_lda")


def written_unknown(spark, d):
    """Points of units whose label is hidden, as a table written once: scores, votes and scenarios read it several times."""
    return materialise(orders.unknown_points(spark, d).select(*[c for c in orders.KEPT if c != "label"]), "unknown")


def _voted(spark, d):
    """Unknown units with scores, intervals and votes of 1,000 refitted pipelines."""
    pipe, unknown = frozen(spark, d)[0], written_unknown(spark, d)
    m = pipe["selected"]
    return pipelines.boot_score(pipelines.score_units(unknown, pipe), unknown, boot_of(spark, d), pipe["thresholds"][m], pipe["calibration"][m])


def _judged(spark, d):
    pipe, units = frozen(spark, d)[0], materialise(_voted(spark, d), "voted")
    refs = materialise(classify.unit_features(known_of(spark, d), pipe).withColumn("all_", F.lit(1)), "refs")
    near = E.nearest_reference(units.withColumn("all_", F.lit(1)), refs, NAMES, ["all_"], "unit_id", "unit_id")
    told = near.join(E.domain_threshold(refs, NAMES, ["all_"]), "all_").select("unit_id", "distance", "threshold")
    far = robust.robust_flags(units, refs, NAMES).select("unit_id", "robust_distance", "robust_threshold", F.col("outside").alias("far_"))
    both = told.join(far, "unit_id").withColumn("outside", (F.col("distance") > F.col("threshold")) | F.coalesce(F.col("far_"), F.lit(False))).drop("far_")
    return units.join(both, "unit_id")


@register(None)
def n3_boot_score(spark, d):
    return rounded(_voted(spark, d).select("unit_id", "p_low", "p_high", "majority"), "p_low", "p_high", "majority")


@register(None)
def n4_applicability(spark, d):
    return rounded(_judged(spark, d).select("unit_id", "distance", "threshold", "robust_distance", "robust_threshold", "outside"), "distance", "threshold", "robust_distance", "robust_threshold")


@register(None)
def n5_reject(spark, d):
    pipe = frozen(spark, d)[0]
    p = f"p_{pipe['selected']}"
    return rounded(classify.reject_reasons(_judged(spark, d), pipe).select("unit_id", F.col(p).alias("probability"), "reasons", "rejected"), "probability")


@register(None)
def n6_sensitivity(spark, d):
    """Unknown units under alternate frozen pipelines and perturbed parts: change of the probability and of the label."""
    unknown, pipe = written_unknown(spark, d), frozen(spark, d)[0]
    m = pipe["selected"]
    told = lambda df, p: materialise(pipelines.score_units(df, p).select("unit_id", F.col(f"p_{m}").alias("p"), F.col(f"label_{m}").alias("label")), "scored")
    main = told(unknown, pipe).select("unit_id", F.col("p").alias("main"), F.col("label").alias("main_label"))
    others = {"zero_c_0.25": (0.25, "state"), "zero_c_0.75": (0.75, "state"), "global_median": (0.5, None)}
    with ThreadPool(TOGETHER) as pool:
        jobs = [inheritable_thread_target(spark)(partial(frozen, spark, d, *o)) for o in others.values()]
        scenarios = [(name, unknown, p) for name, (p, _) in zip(others, pool.map(lambda job: job(), jobs), strict=True)]
    scenarios += [(f"perturbed_{round(100 * r)}_{k}", materialise(perturb(unknown, PARTS, r, k, "point_id"), "perturbed"), pipe) for r in (0.05, 0.1) for k in (0, 1)]
    out = None
    for name, df, p in scenarios:
        one = told(df, p).withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one)
    both = out.join(main, "unit_id")
    return rounded(both.select("scenario", "unit_id", "p", (F.col("p") - F.col("main")).alias("delta"), (F.col("label") != F.col("main_label")).alias("label_changed")), "p", "delta")


@register("select count(*) as n_rows, cast(sum(cast(('0x' || substr(md5(concat_ws('|', coalesce(color, ''), label, name, pattern, state, cast(unit_id as varchar))), 1, 15))::bigint as hugeint)) as varchar) as fingerprint from (" + S.query("select * from units") + ")")
def p1_fingerprint(spark, d):
    return evidence.table_fingerprint(orders.raw_units(spark, d))


@register(S.query("select 'raw_sum' as \"column\", (select count(*) from allp where unit_id % 50 = 0) as one_side_only, (select count(*) from known where point_id % 4 = 0) + (select count(*) from allp where not valid and unit_id % 50 <> 0 and point_id % 4 = 0) as different, round(0.5, 6) as largest"))
def p2_compare(spark, d):
    a = orders.points(spark, d)
    b = a.where("unit_id % 50 <> 0").withColumn("raw_sum", F.when(F.col("point_id") % 4 == 0, F.col("raw_sum") + 0.5).otherwise(F.col("raw_sum")))
    return rounded(evidence.compare_tables(a, b, ["point_id"], ["raw_sum"]), "largest")


@register(S.query("select 'audit' as source, 'all' as scenario, part as item, round(quantile_cont(value, 0.5), 8) as value from (" + S.long("allp", "") + ") group by part union all select 'states', state, label, cast(count(*) as double) from units group by state, label"))
def p3_master(spark, d):
    a = audit.part_audit(orders.points(spark, d), PARTS).withColumn("scenario", F.lit("all"))
    b = orders.raw_units(spark, d).groupBy("state", "label").agg(F.count("*").alias("n"))
    return rounded(evidence.sensitivity_master({"audit": (a, "scenario", "part", "median"), "states": (b, "state", "label", "n")}), "value", digits=8)


@register(S.query("select 'units' as claim, label || ': ' || cast(count(*) as varchar) || ' units' as evidence from units group by label union all select 'points', cast(count(*) as varchar) || ' valid points' from known"))
def p4_claims(spark, d):
    u = orders.raw_units(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    k = orders.known_points(spark, d).agg(F.count("*").alias("n"))
    return evidence.claim_evidence({"units": (u, F.concat(F.col("label"), F.lit(": "), F.col("n").cast("string"), F.lit(" units"))), "points": (k, F.concat(F.col("n").cast("string"), F.lit(" valid points")))})
