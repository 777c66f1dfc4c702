import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.functions.expressions import erfc_p, helmert, poisson_draws, uniform
from partwise.operators import association, audit, cluster, evidence, keys
from partwise.operators import logratio as lr

PARTS = ("a", "b", "c")
SCHEMA = "point_id long, unit_id long, label string, a double, b double, c double"
ROWS = [
    (1, 1, "x", 50.0, 30.0, 20.0),
    (2, 1, "x", None, 40.0, 10.0),
    (3, 2, "x", 60.0, 0.0, 40.0),
    (4, 3, "y", 10.0, 80.0, 10.0),
    (5, 4, "y", 20.0, 70.0, None),
    (6, 5, "y", 30.0, 60.0, 5.0),
]


@pytest.fixture()
def points(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_fill_replace_close_by_hand(points):
    prep = lr.fit_prep(points, PARTS, "label", min_obs=3)
    assert prep.level("y", "a") == "group" and prep.level("x", "a") == "global"
    assert prep.value("x", "a") == np.median([50, 60, 10, 20, 30])
    out = {r["point_id"]: r for r in lr.transform(points, prep).collect()}
    assert out[2]["fallback_a"] and not out[1]["fallback_a"]
    assert prep.delta["b"] == 0.5 * 30
    raw = np.array([60.0, 15.0, 40.0])
    closed = raw / raw.sum() * 100
    assert np.allclose([out[3][p] for p in PARTS], closed)
    logs = np.log(closed)
    assert np.allclose([out[3][f"clr_{p}"] for p in PARTS], logs - logs.mean())
    assert np.allclose([out[3][f"ilr_{i}"] for i in (1, 2)], np.array(helmert(3)) @ logs)


def test_log_ratio_properties(points):
    full = points.dropna().where("b > 0")
    z = lr.ilr(lr.clr(lr.closure(full, PARTS), PARTS), PARTS)
    back = lr.inverse_ilr(z, ["ilr_1", "ilr_2"], PARTS, "back_").collect()
    scaled = {r["point_id"]: r for r in lr.clr(full.withColumns({p: F.col(p) * 7 for p in PARTS}), PARTS).collect()}
    for r in back:
        assert np.allclose([r[f"back_{p}"] for p in PARTS], [r[p] for p in PARTS])
        assert abs(sum(r[f"clr_{p}"] for p in PARTS)) < 1e-12
        assert np.allclose([scaled[r["point_id"]][f"clr_{p}"] for p in PARTS], [r[f"clr_{p}"] for p in PARTS])
        assert r["closure_error"] <= 1e-8


def test_partitioning_changes_nothing(points):
    one = lr.fit_prep(points.repartition(1), PARTS, "label", min_obs=3)
    many = lr.fit_prep(points.repartition(5), PARTS, "label", min_obs=3)
    assert one == many


def test_negative_part_is_an_error(spark, points):
    prep = lr.fit_prep(points, PARTS, "label", min_obs=3)
    bad = spark.createDataFrame([(9, 9, "x", -1.0, 2.0, 3.0)], SCHEMA)
    with pytest.raises(Exception, match="negative"):
        lr.transform(bad, prep).collect()


def test_prepare_by_takes_weights_as_copies(points):
    weighted = lr.prepare_by(points.withColumn("m", F.lit(2)), ["label"], PARTS, weight="m")
    copied = lr.prepare_by(points.union(points), ["label"], PARTS).distinct()
    key = lambda df: sorted((r["point_id"], *[round(r[p], 9) for p in PARTS]) for r in df.collect())
    assert key(weighted) == key(copied)


def test_validity_and_flags(spark):
    df = spark.createDataFrame([(1, 85.0, None), (2, 105.0, 0.0), (3, 105.5, 0.0), (4, 84.0, 0.5)], "k int, a double, b double")
    out = {r["k"]: r for r in keys.cell_flags(keys.validity(df, ["a", "b"], 85, 105), ["a", "b"]).collect()}
    assert [out[k]["valid"] for k in (1, 2, 3, 4)] == [True, True, False, False]
    assert (out[1]["miss_b"], out[1]["zero_b"], out[2]["zero_b"]) == (1, 0, 1)
    assert out[3]["exclusion_reason"] == "sum_above_105"


def test_keys(spark):
    df = spark.createDataFrame([(" 7 point",), ("123x",), ("none",), (None,)], "t string")
    assert [r["k"] for r in keys.normalise_keys(df, "t", "k").collect()] == ["07", "123", None, None]


def test_bh_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.04), (4, None), (5, 0.9)], "k int, p double").withColumn("f", F.lit(1))
    out = {r["k"]: r["p_fdr"] for r in audit.bh_fdr(df, "p", ["f"], tie="k").collect()}
    assert out[4] is None
    assert np.allclose([out[k] for k in (1, 2, 3, 5)], [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.9])


def test_average_ranks_and_auc(spark):
    df = spark.createDataFrame([(1, 0.2, 0), (2, 0.5, 1), (3, 0.5, 0), (4, 0.9, 1)], "k int, score double, y int").withColumn("g", F.lit(1))
    assert sorted(r["rank"] for r in audit.avg_rank(df, "score", ["g"]).collect()) == [1, 2.5, 2.5, 4]
    assert audit.auc(df, ["g"]).first()["auc"] == (2 + 2 - 0.5) / 4


def test_ari(spark):
    df = spark.createDataFrame([(i, i % 3, (i + 1) % 3, i // 6) for i in range(12)], "k int, a int, b int, c int")
    assert cluster.ari(df, "a", "b").first()["ari"] == 1.0
    assert cluster.ari(df, "a", "c").first()["ari"] < 0.1


def test_consensus_counts_pairs(spark):
    rows = [(0, i, i % 2, (i // 2) % 2) for i in range(8)]
    got = {r["kind"]: r["value"] for r in cluster.consensus(spark.createDataFrame(rows, "rep int, unit_id int, main int, cluster int")).collect()}
    pair = lambda same: np.mean([a[3] == b[3] for i, a in enumerate(rows) for b in rows[i + 1 :] if (a[2] == b[2]) == same])
    assert math.isclose(got["within"], pair(True)) and math.isclose(got["between"], pair(False))


def test_tests_on_tables(spark):
    df = spark.createDataFrame([("p", "u")] * 3 + [("p", "v")] + [("q", "u")] + [("q", "v")] * 3, "a string, b string")
    cells = audit.contingency(df, "a", "b")
    assert math.isclose(association.fisher_exact(cells).first()["p"], 0.4857142857, rel_tol=1e-6)
    told = association.chi2_test(cells).first()
    assert math.isclose(told["chi2"], 2.0) and told["df"] == 1 and told["sparse"] and abs(told["p"] - 0.157299) < 1e-5
    tails = spark.range(1).select(*[association.chi2_tail(F.lit(5.0), F.lit(k)).alias(str(k)) for k in (1, 2, 3, 4, 7)]).first()
    assert np.allclose(list(tails), [0.0253473, 0.0820850, 0.1717971, 0.2872975, 0.6599632], atol=1e-6)
    p = association.perm_p(cells, 400).first()["p"]
    assert 0.35 < p < 0.6


def test_normal_tail_and_draws(spark):
    got = spark.range(1).select(erfc_p(F.lit(1.959964)).alias("p")).first()["p"]
    assert abs(got - 0.05) < 1e-6
    m = spark.range(20000).select(poisson_draws(uniform(F.lit(1), "id")).alias("m")).agg(F.avg("m"), F.variance("m")).first()
    assert abs(m[0] - 1) < 0.03 and abs(m[1] - 1) < 0.05


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).select("id", (F.col("id") / 7).alias("x"))
    a, b = evidence.table_fingerprint(df).first(), evidence.table_fingerprint(df.orderBy(F.desc("id")).select("x", "id").repartition(7)).first()
    assert a == b
    assert evidence.table_fingerprint(df.where("id <> 3")).first() != a


def test_jaccard_of_empty_sets(spark):
    a = spark.createDataFrame([("g", 1), ("g", 2)], "g string, k int")
    assert audit.set_jaccard(a, a.where("k = 2"), ["k"], ["g"]).first()["jaccard"] == 0.5
    assert audit.set_jaccard(a.where("k > 5"), a.where("k > 5"), ["k"], ["g"]).count() == 0


def test_folds_hold_whole_units(spark):
    units = spark.range(40).select(F.col("id").alias("unit_id"), F.when(F.col("id") % 2 == 0, "K").otherwise("PB").alias("label"))
    folds = keys.unit_folds(units, 5, 2)
    assert folds.groupBy("rep", "unit_id").count().where("count <> 1").isEmpty()
    assert {r["count"] for r in folds.groupBy("rep", "label", "fold").count().collect()} == {4}


def test_stream_is_scored_like_a_table(spark, tmp_path, points):
    from partwise.streaming.scoring import score_stream

    pipe = {
        "parts": list(PARTS), "medians": {"x": {"a": 50.0, "b": 30.0, "c": 20.0}}, "counts": {"x": {"a": 9, "b": 9, "c": 9}}, "global": {"a": 40.0, "b": 30.0, "c": 20.0},
        "delta": {"a": 1.0, "b": 1.0, "c": 1.0}, "library": {"first": [["a"], ["b", "c"]]}, "scale": {"a_first": 0.0, "s_first": 1.0}, "models": {"logistic": [1.0, 0.0]},
    }
    rows = points.withColumn("state", F.lit("x"))
    rows.write.parquet(str(tmp_path / "in"))
    query = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), pipe).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["point_id"], round(r["p_logistic"], 9)) for r in spark.table("scored").collect())
    assert got == sorted((r["point_id"], round(r["p_logistic"], 9)) for r in score_stream(rows, pipe).collect())
