"""The inverse of log-ratio coordinates: its values, and methods that the JVM compiles."""

import re

import numpy as np

from partwise.operators import logratio as lr

PARTS = ("a", "b", "c", "d", "e", "f")
ILR = [f"ilr_{i}" for i in range(1, 6)]


def test_inverse_of_prepared_points_stays_compilable(spark):
    x = np.random.default_rng(1).random((40, 6)) * 30
    rows = [(i, "xy"[i % 2], *[None if (i + j) % 5 == 0 else 0.0 if (i + j) % 7 == 0 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "point_id long, label string, " + ", ".join(f"{p} double" for p in PARTS))
    kept = df.persist()
    back = lr.inverse_ilr(lr.transform(kept, lr.fit_prep(df, PARTS, "label")), ILR, PARTS, "back_")
    assert all(abs(r[p] - r[f"back_{p}"]) < 1e-9 for r in back.collect() for p in PARTS)
    text = spark.sparkContext._jvm.PythonSQLUtils.explainString(back._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    kept.unpersist()
    assert sizes and max(sizes) < 8_000  # the JVM interprets longer methods


def test_missing_coordinates_give_no_parts(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 0.5, -0.5)], "i int, u double, v double")
    got = {r["i"]: r for r in lr.inverse_ilr(df, ["u", "v"], ("a", "b", "c")).collect()}
    assert [got[1][p] for p in "abc"] == [None] * 3 and abs(sum(got[2][p] for p in "abc") - 100) < 1e-9
