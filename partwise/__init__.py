"""Compositional-data analytics as Spark jobs: DataFrame in, DataFrame out."""
