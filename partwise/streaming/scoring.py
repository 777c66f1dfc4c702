"""Frozen scoring of a stream: the operators are stateless expressions, so a stream takes them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import linear_score
from ..operators.logratio import Prep, balances, transform
from ..operators.pipelines import tree_score


def score_stream(points: DataFrame, pipeline: dict) -> DataFrame:
    """Points of a stream (or table) with the frozen models' probabilities, each point as a unit of its own."""
    prep = Prep("state", tuple(pipeline["parts"]), pipeline["medians"], pipeline["counts"], pipeline["global"], 5, pipeline["delta"])
    library = {k: tuple(map(tuple, v)) for k, v in pipeline["library"].items()}
    s = pipeline["scale"]
    rows = balances(transform(points, prep), library).withColumns({f: (F.col(f) - s[f"a_{f}"]) / (s[f"s_{f}"] or 1.0) for f in library})
    return rows.withColumns({f"p_{m}": tree_score(b) if isinstance(b, dict) else linear_score(list(library), b) for m, b in pipeline["models"].items()})
