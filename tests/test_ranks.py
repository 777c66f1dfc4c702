"""Running totals, ranks and quantiles across tasks, against plain Python."""

import random
from statistics import quantiles as plain_quantiles

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.operators import audit, cluster, ranks, selection

R = random.Random(5)
#: A value fills a third of group a, so its rows come from many tasks; b has one row, null is a group too.
ROWS = [("a", 7.0) for _ in range(100)] + [("a", float(R.randrange(40))) for _ in range(200)] + [("b", 1.5)] + [(None, float(i % 4)) for i in range(9)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(ROWS)], "id long, g string, v double").repartition(7)


def test_ranks_of_ties_span_tasks(rows):
    told = {r["id"]: r["rank"] for r in audit.avg_rank(rows, "v", ["g"]).collect()}
    assert len(told) == len(ROWS)
    for i, (g, v) in enumerate(ROWS):
        own = [y for x, y in ROWS if x == g]
        assert told[i] == sum(y < v for y in own) + (sum(y == v for y in own) + 1) / 2


def test_rows_that_a_second_evaluation_changes_keep_their_ranks(spark):
    """A mean's last bit hangs on the order in which a shuffle delivers: ranks join back by value, so rows are evaluated once."""
    df = spark.range(200).select("id", F.lit("x").alias("g"), F.java_method(F.lit("java.lang.Math"), F.lit("random")).cast("double").alias("v"))
    told = sorted(audit.avg_rank(df, "v", ["g"]).collect(), key=lambda r: r["v"])
    assert [r["rank"] for r in told] == [float(i) for i in range(1, 201)]
    adjusted = audit.bh_fdr(df, "v", ["g"]).collect()
    assert len(adjusted) == 200 and all(r["p_fdr"] is not None and r["p_fdr"] > r["v"] - 1e-12 for r in adjusted)


def test_rank_correlations_of_centres_that_a_second_evaluation_changes(spark):
    noise = 1 + F.java_method(F.lit("java.lang.Math"), F.lit("random")).cast("double") * 1e-12
    plain = [(i, R.random(), R.random()) for i in range(200)]
    centers = spark.createDataFrame([(*r, "x") for r in plain], "unit_id long, l_a double, l_b double, label string").withColumns({"l_a": F.col("l_a") * noise, "l_b": F.col("l_b") * noise})
    place = lambda k: np.argsort(np.argsort([r[k] for r in plain]))
    told = cluster.clr_spearman(centers, ["a", "b"]).collect()
    assert [(r["part_j"], r["part_k"]) for r in told] == [("a", "b")]
    assert told[0]["rho"] == pytest.approx(np.corrcoef(place(1), place(2))[0, 1], abs=1e-12)


def test_running_totals_do_not_hang_on_the_number_of_ranges(rows, spark):
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    seen = []
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, ranks.running_totals(counted, ["g"], [F.desc("v")], ["n"]).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]
    assert max(r["below_n"] for r in ranks.running_totals(counted, [], ["g", "v"], ["n"]).collect()) < len(ROWS)


def test_quantiles(rows):
    told = {r["g"]: r for r in ranks.quantiles(rows, "v", ["g"], {"q25": 0.25, "q50": 0.5, "q90": 0.9}).collect()}
    own = sorted(v for g, v in ROWS if g == "a")
    wanted = plain_quantiles(own, n=20, method="inclusive")
    assert [told["a"][q] for q in ("q25", "q50", "q90")] == pytest.approx([wanted[4], wanted[9], wanted[17]])
    assert told["b"]["q25"] == told["b"]["q90"] == 1.5
    alone = ranks.quantiles(rows, "v", [], {"m": 0.5}).first()["m"]
    assert alone == plain_quantiles([v for _, v in ROWS], n=2, method="inclusive")[0]


def test_adjusted_values_equal_a_plain_loop(spark):
    ps = [R.choice([0.01, 0.02, 0.5, R.random()]) for _ in range(60)] + [None, float("nan")]
    df = spark.createDataFrame([(i, "x" if i % 3 else "y", p) for i, p in enumerate(ps)], "id long, f string, p double")
    told = {r["id"]: r["p_fdr"] for r in audit.bh_fdr(df, "p", ["f"]).collect()}
    few = {r["id"]: r["p_fdr"] for r in audit.bh_fdr_few(df, "p", ["f"], tie="id").collect()}
    assert told[60] is None and told[61] is None and set(told) == set(range(62))
    for i, p in enumerate(ps[:60]):
        own = sorted(ps[j] for j in range(60) if (j % 3 > 0) == (i % 3 > 0))
        assert told[i] == pytest.approx(min(1.0, *[own[k] * len(own) / (k + 1) for k in range(len(own)) if own[k] >= p]))
        assert few[i] == pytest.approx(told[i])


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, g string, v double")
    assert audit.avg_rank(none, "v", ["g"]).count() == 0
    assert ranks.quantiles(none, "v", ["g"], {"m": 0.5}).count() == 0


@pytest.mark.parametrize("few", [50_000, 40])
def test_selection_narrows_to_exact_quantiles(spark, monkeypatch, few):
    """Ties fill half of a column, a group is small, one is null, one column has no value in a group."""
    monkeypatch.setattr(selection, "FEW", few)
    rows = [(R.choice("ab"), R.choice([1.0, R.random(), R.gauss(0, 1e6)]), None if R.random() < 0.3 else R.random()) for _ in range(4000)]
    rows += [(None, 5.0, 2.0), (None, 6.0, None), ("c", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, u double, v double").repartition(5)
    told = selection.select(df, ["u", "v"], ["g"], [0.0, 0.25, 0.5, 1.0])
    assert set(told) == {("a",), ("b",), ("c",), (None,)}
    for (g,), own in told.items():
        for c, k in (("u", 1), ("v", 2)):
            x = [r[k] for r in rows if r[0] == g and r[k] is not None]
            assert own[c][0] == len(x)
            assert own[c][1] == pytest.approx(np.quantile(x, [0.0, 0.25, 0.5, 1.0]).tolist()) if x else own[c][1] == [None] * 4
    assert selection.select(df.limit(0), ["u"], ["g"], [0.5]) == {}
    assert selection.select(df, ["u"], [], [0.5])[()]["u"][1] == [pytest.approx(np.median([r[1] for r in rows]))]
