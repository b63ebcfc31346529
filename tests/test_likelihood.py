"""The Poisson likelihood has a value at any number of distinct responses."""

import math

import pytest
from pyspark.sql import functions as F

from ratecraft.functions.families import Family
from ratecraft.operators.inference import log_likelihood, totals


@pytest.mark.parametrize("n", [1_000, 200_500])
def test_poisson_likelihood_of_distinct_responses(spark, n):
    scored = spark.range(n).select((F.col("id") / 1000.0).alias("y"), (1 + F.col("id") % 3 / 2.0).alias("w"), (0.5 + F.col("id") % 7).alias("mu"))
    y, w, mu = F.col("y"), F.col("w"), F.col("mu")
    t = totals(scored, Family("poisson"), y, w, F.lit(0.0), mu)
    rows = [(i / 1000.0, 1 + i % 3 / 2.0, 0.5 + i % 7) for i in range(n)]
    want = math.fsum(b * (a * math.log(m) - m - math.lgamma(a + 1)) for a, b, m in rows)
    assert log_likelihood(scored, Family("poisson"), t, y, w, 1.0) == pytest.approx(want, rel=1e-11)
