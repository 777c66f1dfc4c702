"""From out-of-fold scores to a frozen pipeline: calibration gate, choice of the model, final fit, its bootstrap, scoring."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import logit
from ..sources.shared import materialise
from . import nested
from . import trees as T
from .audit import mode_config
from .classify import calibration_fit, class_metrics, linear_score, select_model, unit_features
from .logratio import Prep, fit_prep
from .refit import Drawn, Weightings, _mask, _sums, drawn_words, weightings
from .resample import CHUNK, _matrix, _sliced

#: Which model counts as simpler, and replicates that must have a fit before intervals are told.
SIMPLICITY = {"tree": 0, "logistic": 1, "lda": 2}
LEAST_SUCCESSES = 800


class Every(Drawn):
    """Each unit once."""

    def roles(self, a, b, ids):
        return np.ones((len(a), len(ids))), np.zeros((len(a), len(ids)), np.int8)

    def __call__(self, g, a, b, ids):
        yield 0, np.arange(len(a)), self.roles(a, b, ids)[0]


def calibration_decisions(oof: DataFrame, gain: float = 0.01, loss: float = 0.01) -> DataFrame:
    """Per model: whether a sigmoid fitted on repeat 0 betters the other repeats, and the threshold that holds then.

    It is enabled if the Brier score falls by ``gain`` and balanced accuracy by no more than ``loss``; the raw threshold is
    the median of all folds', mapped by the sigmoid where one is used.  The enabled sigmoid is fitted on all repeats.
    """
    raw = {r["model"]: r["t"] for r in oof.groupBy("model").agg(F.percentile("threshold", 0.5).alias("t")).collect()}
    first = {r["model"]: (r["slope"], r["intercept"]) for r in calibration_fit(oof.where("rep = 0"), ["model"]).collect()}
    whole = {r["model"]: (r["slope"], r["intercept"]) for r in calibration_fit(oof, ["model"]).collect()}
    sigmoid = lambda p, fit: 1 / (1 + F.exp(-(logit(p) * fit[0] + fit[1])))
    pick = lambda values: F.coalesce(*[F.when(F.col("model") == m, v) for m, v in values.items()])
    fitted = {m: v for m, v in first.items() if m in raw}
    calibrated = pick({m: sigmoid(F.col("score"), v) for m, v in fitted.items()}) if fitted else F.lit(None).cast("double")
    limit = pick({m: sigmoid(F.lit(raw[m]), v) for m, v in fitted.items()}) if fitted else F.lit(None).cast("double")
    rows = oof.where("rep <> 0").select("model", "y", "score", calibrated.alias("calibrated"), pick({m: F.lit(t) for m, t in raw.items()}).alias("raw_threshold"), limit.alias("limit_"))
    brier = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    ba = lambda c, t: (F.avg(F.when(F.col("y") == 1, (F.col(c) >= F.col(t)).cast("int"))) + F.avg(F.when(F.col("y") == 0, (F.col(c) < F.col(t)).cast("int")))) / 2
    told = rows.groupBy("model").agg(F.first("raw_threshold").alias("raw_threshold"), (brier("score") - brier("calibrated")).alias("brier_gain"), (ba("calibrated", "limit_") - ba("score", "raw_threshold")).alias("accuracy_change"))
    told = told.withColumn("enabled", F.coalesce((F.col("brier_gain") >= gain) & (F.col("accuracy_change") >= -loss), F.lit(False)))
    ends = {m: v for m, v in whole.items() if m in raw}
    mapped = pick({m: sigmoid(F.col("raw_threshold"), v) for m, v in ends.items()}) if ends else F.lit(None).cast("double")
    on = lambda i: F.when(F.col("enabled"), pick({m: F.lit(float(v[i])) for m, v in ends.items()})) if ends else F.lit(None).cast("double")
    return told.withColumns({"slope": on(0), "intercept": on(1), "threshold": F.when(F.col("enabled"), mapped).otherwise(F.col("raw_threshold"))})


def fold_metrics(oof: DataFrame) -> DataFrame:
    """Metrics of each repeat and model at the median of its folds' thresholds."""
    middle = oof.groupBy("rep", "model").agg(F.percentile("threshold", 0.5).alias("limit_"))
    return class_metrics(oof.join(middle, ["rep", "model"]), F.col("limit_"))


class Chain:
    """What the chain decided: ``oof``, ``metrics``, ``decisions``, ``choice`` (tables), ``configs`` and ``selected``."""

    def __init__(self, oof, metrics, decisions, choice, configs, selected):
        self.oof, self.metrics, self.decisions, self.choice, self.configs, self.selected = oof, metrics, decisions, choice, configs, selected


def choose(df: DataFrame, parts, library, folds_n: int = 5, repeats: int = 20, zero_c: float = 0.5) -> Chain:
    """Nested cross-validation, metrics, calibration gate, the model within one standard error, each model's usual setting."""
    oof, tuned = nested.cross_validate(df, parts, library, folds_n, repeats, zero_c)
    spark = df.sparkSession
    metrics = materialise(fold_metrics(oof), "metrics")
    decisions = materialise(calibration_decisions(oof), "decisions")
    choice = materialise(select_model(metrics, SIMPLICITY), "choice")
    tried = spark.createDataFrame([(model, json.dumps(s, sort_keys=True), i) for i, (_, _, model, s, _, _) in enumerate(tuned.chosen)], "model string, config string, place int")
    configs = {r["model"]: json.loads(r["config"]) for r in mode_config(tried, "model", "config", "place").collect()}
    fine = choice.where("selected").orderBy("brier", "model").first()
    return Chain(oof, metrics, decisions, choice, configs, fine["model"])


def fit_models(w: Weightings, configs: dict[str, dict]) -> tuple[dict[str, dict[int, object]], np.ndarray | None]:
    """Coefficients or trees of every weighting for one setting of each model."""
    out: dict[str, dict[int, object]] = {}
    edges = None
    for model, s in configs.items():
        if model == "logistic":
            beta, unsettled = nested.fit_logistics(w, [s])
            w.failed |= dict.fromkeys(unsettled, "not_settled")
            out[model] = {k: b[0] for k, b in beta.items() if k not in unsettled}
        elif model == "lda":
            out[model] = {k: b[0] for k, b in nested.fit_discriminants(w, [s["shrinkage"]]).items()}
        else:
            edges = T.bin_edges(w)
            grown = T.grow(w, edges, [(s["leaf"], s["balanced"])], s["depth"])
            out[model] = {k: t[s["leaf"], s["balanced"]].pruned(s["depth"], s["alpha"]) for k, t in grown.items()}
    return out, edges


def _frozen_tree(tree: T.Tree, edges: np.ndarray, names: list[str], path: T.Path = ()) -> dict:
    if path not in tree.splits:
        return {"p": tree.probability(path)}
    f, cut = tree.splits[path]
    low, high = (_frozen_tree(tree, edges, names, c) for c in tree.children(path))
    return {"feature": names[f], "cut": float(edges[f][cut]), "low": low, "high": high}


def tree_score(tree: dict) -> Column:
    """A frozen tree as one conditional expression over standardised features."""
    if "p" in tree:
        return F.lit(float(tree["p"]))
    return F.when(F.col(tree["feature"]) <= tree["cut"], tree_score(tree["low"])).otherwise(tree_score(tree["high"]))


def train_final(df: DataFrame, parts, library, configs: dict[str, dict], decisions=None, selected: str = "logistic", zero_c: float = 0.5, group: str = "state") -> dict:
    """A pipeline's parameters: medians, zero replacements, scaling, the three models with their thresholds and calibration.

    ``group`` may be ``None``: medians of all points then.
    """
    rows = df if group else df.withColumn("all_", F.lit("all"))
    key = group or "all_"
    prep = fit_prep(rows, parts, key, zero_c=zero_c)
    w = weightings(rows, parts, library, Every(), 1, rows.select("unit_id").distinct().withColumns({"a_": F.lit(0).cast("long"), "b_": F.lit(0).cast("long")}), key, zero_c)
    try:
        fits, edges = fit_models(w, configs)
        if w.failed:
            raise ValueError(f"the pipeline has no fit: {w.failed[0]}")
        names = list(library)
        models = {m: _frozen_tree(f[0], edges, names) if m == "tree" else f[0].tolist() for m, f in fits.items()}
        scale = {}
        for i, f in enumerate(names):
            sd = float(_raw_scale(w, library, parts, i))
            scale |= {f"s_{f}": sd, f"a_{f}": float(-w.turn[0, -1, i] * sd)}
    finally:
        w.close()
    told = {r["model"]: r.asDict() for r in decisions.collect()} if decisions is not None else {}
    thresholds = {m: float(told[m]["threshold"]) if m in told else 0.5 for m in models}
    calibration = {m: [told[m]["slope"], told[m]["intercept"]] if m in told and told[m]["enabled"] else None for m in models}
    return {"parts": list(prep.parts), "group": group, "medians": prep.medians, "counts": prep.counts, "global": prep.global_medians, "delta": prep.delta, "library": {k: [list(s) for s in v] for k, v in library.items()}, "scale": scale, "models": models, "configs": configs, "thresholds": thresholds, "calibration": calibration, "selected": selected, "zero_c": zero_c}


def _raw_scale(w: Weightings, library, parts, i: int) -> float:
    """The deviation by which feature ``i`` was divided: the weight of a log part before and after."""
    from .refit import _balance_weights

    raw = _balance_weights(library, list(parts))[:, i]
    p = int(np.abs(raw).argmax())
    return raw[p] / w.turn[0, p, i]


def score_units(df: DataFrame, pipeline: dict) -> DataFrame:
    """Units with the (calibrated) probability of every frozen model, ``p_<model>``, and its label, ``label_<model>``."""
    names = list(pipeline["library"])
    units = unit_features(df, pipeline)
    for m, fit in pipeline["models"].items():
        p = tree_score(fit) if isinstance(fit, dict) else linear_score(names, fit)
        sigmoid = pipeline["calibration"][m]
        if sigmoid:
            p = 1 / (1 + F.exp(-(logit(p) * sigmoid[0] + sigmoid[1])))
        units = units.withColumn(f"p_{m}", p).withColumn(f"label_{m}", (F.col(f"p_{m}") >= pipeline["thresholds"][m]).cast("int"))
    return units


class Replicated:
    """The selected model of every bootstrap replicate that has a fit; ``failed`` names the reasons of the others."""

    def __init__(self, levels, parts, turn, fits, edges, model, failed, tried):
        self.levels, self.parts, self.turn, self.fits, self.edges, self.model, self.failed, self.tried = levels, parts, turn, fits, edges, model, failed, tried

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (unit, replicate) of units' rows."""
        if self.model == "tree":
            return np.stack([t.score(x @ self.turn[k], self.edges) for k, t in self.fits.items()], axis=1)
        ids = list(self.fits)
        beta = np.array([self.fits[k] for k in ids])
        flat = np.einsum("kdf,kf->dk", self.turn[ids], beta[:, :-1])
        return nested.probability(x @ flat + beta[:, -1])


def boot_pipelines(df: DataFrame, parts, library, configs: dict[str, dict], model: str, reps: int = 1_000, group: str = "state", zero_c: float = 0.5, salt: str = "pipeline") -> Replicated:
    """``reps`` bootstraps of units: medians, zero replacements, scaling and the model are fitted anew in each."""
    w = weightings(df, parts, library, Drawn(), reps, drawn_words(df, salt), group, zero_c)
    try:
        fits, edges = fit_models(w, {model: configs[model]})
    finally:
        w.close()
    levels = sorted(r[group] for r in df.select(group).distinct().collect() if r[group] is not None)
    return Replicated(levels, list(parts), w.turn, fits[model], edges, model, dict(w.failed), reps)


def unit_rows(df: DataFrame, parts, levels, group: str = "state") -> DataFrame:
    """``unit_id, x``: the sums that replicates turn into features; points of levels never seen are filled globally."""
    others = ~F.coalesce(F.col(group).isin(*levels), F.lit(False)) if levels else F.lit(True)
    masks = [*[_mask(group, s) for s in levels], others]
    return df.groupBy("unit_id").agg(F.array(*[c / F.count("*") for m in masks for k in range(3) for p in parts for c in [_sums(m, p)[k]]], F.lit(1.0)).alias("x"))


def boot_score(units: DataFrame, points: DataFrame, boot: Replicated, threshold: float, sigmoid=None, group: str = "state", least: int = LEAST_SUCCESSES) -> DataFrame:
    """``units`` with ``p_low, p_high`` (95 per cent over replicates) and ``majority`` (share of the more frequent label).

    All three are null with fewer than ``least`` replicates that have a fit.  A task holds its block of units by replicates.
    """
    enough = len(boot.fits) >= least

    def judge(batches):
        for batch in _sliced(batches):
            for at in range(0, len(batch), CHUNK):
                own = batch.slice(at, CHUNK)
                n = len(own)
                if enough:
                    p = boot.scores(_matrix(own, "x"))
                    if sigmoid:
                        q = np.clip(p, 1e-6, 1 - 1e-6)
                        p = nested.probability(np.log(q / (1 - q)) * sigmoid[0] + sigmoid[1])
                    low, high = np.quantile(p, [0.025, 0.975], axis=1)
                    vote = (p >= threshold).mean(axis=1)
                    columns = [pa.array(v) for v in (low, high, np.maximum(vote, 1 - vote))]
                else:
                    columns = [pa.nulls(n, pa.float64())] * 3
                yield pa.RecordBatch.from_arrays([own.column(0), *columns], names=["unit_id", "p_low", "p_high", "majority"])

    rows = unit_rows(points, boot.parts, boot.levels, group)
    kind = dict(rows.dtypes)["unit_id"]
    told = rows.mapInArrow(judge, f"unit_id {kind}, p_low double, p_high double, majority double")
    return units.join(told, "unit_id")


def failures(df: DataFrame, boot: Replicated) -> DataFrame:
    """``reason, n``: replicates without a fit, and those with one."""
    rows = [("fitted", len(boot.fits))] + [(r, sum(v == r for v in boot.failed.values())) for r in sorted(set(boot.failed.values()))]
    return df.sparkSession.createDataFrame(rows, "reason string, n int")


def fixed_cv(df: DataFrame, parts, library, model: str, setting: dict, threshold: float, folds_n: int = 5, zero_c: float = 0.5, group: str | None = "state") -> DataFrame:
    """Balanced accuracy and Brier score of one setting over the folds of one repeat, and folds without a fit."""
    rows = df if group else df.withColumn("all_", F.lit("all"))
    w = nested.prepared(rows, parts, library, folds_n, 1, zero_c, group or "all_")
    try:
        fits, edges = fit_models(w, {model: setting})
        outer = np.array([k for k, (_, a, b) in enumerate(w.draw.keys) if a == b and k in fits[model]], np.int64)
        own = fits[model]

        def each(k, x, y, weight, role):
            at = role == 1
            z, truth = x[at], y[at]
            p = own[k].score(z, edges) if model == "tree" else nested.probability(np.hstack([z, np.ones((len(z), 1))]) @ own[k])
            hit = p >= threshold
            return np.array([(truth == 1).sum(), (truth == 0).sum(), (hit & (truth == 1)).sum(), (~hit & (truth == 0)).sum(), ((p - truth) ** 2).sum()], float)

        told = sum(w.summed(each, outer).values()) if len(outer) else np.zeros(5)
    finally:
        w.close()
    n1, n0, ones, zeros, squares = map(float, told)
    ba = (ones / n1 + zeros / n0) / 2 if n1 and n0 else None
    return df.sparkSession.createDataFrame([(model, ba, squares / (n1 + n0) if n1 + n0 else None, folds_n - len(outer))], "model string, balanced_accuracy double, brier double, failed_folds int")
