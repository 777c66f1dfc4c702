"""Sketches are asked for the places next to a quantile, so one of them narrows to few values."""

from partwise.operators import selection


def test_one_sketch_is_enough(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 100)
    asked, real = [], selection.F.percentile_approx
    monkeypatch.setattr(selection.F, "percentile_approx", lambda *args: asked.append(1) or real(*args))
    df = spark.range(20_000).selectExpr("cast((id * 7919) % 20000 as double) as v")
    assert selection.select(df, ["v"], [], [0.5])[()]["v"] == (20_000, [9_999.5])
    assert len(asked) == 1
    told = selection.select(df.selectExpr("v", "cast(v % 3 as int) as g"), ["v"], ["g"], [0.0, 0.25, 1.0])
    assert told[(0,)]["v"] == (6_667, [0.0, 4_999.5, 19_998.0])
