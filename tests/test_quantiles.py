"""Distributed exact quantiles equal numpy's linear percentiles."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.plans.quantiles import exact_quantiles

vals = st.lists(st.one_of(st.integers(-5000, 5000).map(lambda i: i / 1000), st.sampled_from([0.0, 1.0, -1.0])),
                min_size=1, max_size=60)


@settings(max_examples=10, deadline=None)
@given(st.lists(vals, min_size=1, max_size=3), st.sampled_from([(1 << 12, 1 << 16), (1 << 12, 0), (64, 8)]))
def test_matches_numpy(spark, groups, limits):
    rows = [(g, float(v)) for g, vs in enumerate(groups) for v in vs]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, "v", ["g"], probs, *limits).collect()}
    for g, vs in enumerate(groups):
        want = np.percentile(np.array(vs), [p * 100 for p in probs])
        for k, w in enumerate(want):
            assert abs(got[g][f"q_{k}"] - w) <= 1e-9 * max(1.0, abs(w))


def test_outliers_cost_one_more_step(spark):
    values = [i / 7 for i in range(500)] + [1e12, -1e12]
    df = spark.createDataFrame([(0, v) for v in values], "g int, v double")
    got = exact_quantiles(df, "v", ["g"], [0.1, 0.5, 0.9], 64, 16).first()
    for k, p in enumerate((10, 50, 90)):
        assert abs(got[f"q_{k}"] - np.percentile(values, p)) < 1e-6
