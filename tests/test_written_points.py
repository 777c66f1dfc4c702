"""Jobs of several passes read points that are written once: no pass joins the order lines again."""

import pytest

from partwise.operators import audit, classify, cluster, effect, logratio, network
from partwise.plans import registry

DATA = "/root/testdata/sf0.001"


class Seen(Exception):
    """Carries the folders that an operator's first table comes from."""


#: Query, the operator that gets its points, and what was written.
JOBS = [
    ("o8_sensitivity", network, "main_edges", "labelled"),
    ("k3_uncertainty_radius", effect, "replicate_parameters", "known"),
    ("l1_split_features", classify, "split_features", "known"),
    ("j3_permutation", effect, "state_effect", "prepared"),
    ("l2_logistic", classify, "standardised", "units"),
    ("m2_representatives", cluster, "variable_selection", "known"),
    ("k2_boot_counterfactual", effect, "replicate_parameters", "known"),
    ("m11_profiles", network, "fitted", "known"),
    ("o2_boot_edges", network, "boot_edges", "known"),
    ("k7_ratio_baseline", audit, "median_ratio", "known"),
    ("o7_stability", network, "boot_edges", "known"),
    ("j9_leave_one_out", effect, "prepared_points", "known"),
    ("j7_mann_whitney", effect, "mann_whitney", "known"),
    ("m4_metrics", cluster, "cluster_metrics", "centers"),
    ("j8_residuals", effect, "prepared_points", "known"),
    ("j6_contrast", effect, "boot_effect", "known"),
    ("h16_pca", logratio, "fit_prep", "known"),
    ("j5_effect_table", effect, "boot_effect", "known"),
]


@pytest.mark.parametrize(("name", "module", "operator", "written"), JOBS)
def test_points_are_written_once(spark, monkeypatch, name, module, operator, written):
    def seen(df, *args, **kwargs):
        raise Seen(sorted({f.rsplit("/", 2)[-2].split("-")[0] for f in df.inputFiles()}))

    monkeypatch.setattr(module, operator, seen)
    with pytest.raises(Seen) as told:
        registry.queries()[name](spark, DATA).collect()
    assert told.value.args[0] == [written]


#: Query of the chain, what is replaced before it, the operator that is looked at, and what was written.
CHAIN = [
    ("l17_choice", (), "pipelines", "choose", "known"),
    ("l13_final_fit", ("chain_of",), "pipelines", "train_final", "known"),
    ("l14_boot_pipelines", ("chain_of",), "pipelines", "boot_pipelines", "known"),
    ("n2_score", ("frozen",), "pipelines", "score_units", "unknown"),
    ("n3_boot_score", ("frozen",), "pipelines", "score_units", "unknown"),
    ("n6_sensitivity", ("frozen",), "pipelines", "score_units", "unknown"),
    ("n4_applicability", ("frozen", "_voted"), "E", "nearest_reference", "voted"),
    ("n5_reject", ("frozen", "_voted"), "E", "nearest_reference", "voted"),
]


@pytest.mark.parametrize(("name", "given", "module", "operator", "written"), CHAIN)
def test_the_chain_reads_written_points(spark, monkeypatch, name, given, module, operator, written):
    from types import SimpleNamespace

    from partwise.plans import models

    def seen(df, *args, **kwargs):
        raise Seen(sorted({f.rsplit("/", 2)[-2].split("-")[0] for f in df.inputFiles()}))

    fakes = {"chain_of": lambda *_: SimpleNamespace(configs={}, decisions=None, selected="tree"), "frozen": lambda *_: ({"selected": "tree"}, ""), "_voted": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_custkey")}
    monkeypatch.setattr(models, "_KEPT", {})
    monkeypatch.setattr(models.classify, "unit_features", lambda df, pipe: df)
    for f in given:
        monkeypatch.setattr(models, f, fakes[f])
    monkeypatch.setattr(getattr(models, module), operator, seen)
    with pytest.raises(Seen) as told:
        registry.queries()[name](spark, DATA).collect()
    assert told.value.args[0] == [written]
