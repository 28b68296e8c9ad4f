"""The median where the sketch's fence misses the middle."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwall.operators import ranks as R


@pytest.mark.parametrize("ends", [(0.6, 0.7), (0.1, 0.2), (0.5, 0.5)])
def test_median_outside_the_fence(spark, monkeypatch, ends):
    sketch = F.percentile_approx

    def wrong(column, shares, accuracy):
        return sketch(column, list(ends) if len(shares) == 2 else shares, accuracy)

    df = spark.range(1000).select(((F.col("id") * 7919) % 10007 / 3).alias("v"))
    values = df.toPandas().v.to_numpy()
    monkeypatch.setattr(R.F, "percentile_approx", wrong)
    assert R.median(df, "v").first()["median"] == np.median(values)
    assert R.mad_cutoff(df, "v", 2.0).first()["mad"] == np.median(abs(values - np.median(values)))
