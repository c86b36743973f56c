"""Chart data against estimates over all values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.functions import numeric as N
from lexarium.operators import chart_data


def test_density_uses_every_value(spark):
    value = F.when(F.col("id") == 0, 5.0).otherwise(F.pmod(F.col("id"), F.lit(64)) / 64.0)
    df = spark.range(200_000).select(value.alias("v"))
    v = np.array([r["v"] for r in df.collect()])
    grid, got = np.array([(r["x"], r["density"]) for r in chart_data.density(df, "v").collect()]).T
    kinds, counts = np.unique(v, return_counts=True)
    width = v.std(ddof=1) * len(v) ** -0.2
    want = np.exp(-0.5 * ((grid[:, None] - kinds) / width) ** 2) @ counts / (len(v) * width * np.sqrt(2 * np.pi))
    assert got == pytest.approx(want, rel=0.03, abs=0.002)
    assert got[-1] == pytest.approx(1 / (len(v) * width * np.sqrt(2 * np.pi)), rel=1e-4)
    assert N.gaussian_kde(kinds, grid, counts) == pytest.approx(want)
