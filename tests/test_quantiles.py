from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.functions.levels import level_rank, risk_level
from tidewatch.operators.quantiles import exact_quantiles
from pyspark.sql import functions as F


def _frame(spark, **columns):
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{n} DOUBLE" for n in names))


@pytest.mark.parametrize("listed", [1_000_000, 2])
def test_interpolated_quantiles(spark, listed):
    df = _frame(spark, s=[1.0, 2.0, 3.0, 10.0])
    got = exact_quantiles(df, ["s"], [0.75, 0.95, 0.0, 1.0], listed)["s"]
    assert got == pytest.approx([4.75, 8.95, 1.0, 10.0])


def test_narrowing_matches_numpy_with_ties_and_gaps(spark):
    rng = np.random.default_rng(5)
    smooth = rng.normal(size=6000).tolist()
    tied = rng.integers(0, 3, 6000).astype(float).tolist()
    heavy = [0.0] * 3000 + [1.0] * 2990 + [1e9] * 10
    gaps = [x if i % 3 else None for i, x in enumerate(smooth)]
    constant = [4.25] * 6000
    data = {"smooth": smooth, "tied": tied, "heavy": heavy, "gaps": gaps, "constant": constant}
    probs = [0.0, 0.1, 0.5, 0.75, 0.95, 0.98, 1.0]
    got = exact_quantiles(_frame(spark, **data).repartition(5), list(data), probs, listed=20)
    for name, values in data.items():
        present = [v for v in values if v is not None]
        assert got[name] == pytest.approx(np.quantile(present, probs).tolist(), abs=1e-12), name


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_both_ways_agree(spark, values):
    df = _frame(spark, s=values)
    probs = [0.25, 0.75, 0.95]
    assert exact_quantiles(df, ["s"], probs, 3)["s"] == pytest.approx(exact_quantiles(df, ["s"], probs)["s"])


def test_nothing_to_rank(spark):
    df = _frame(spark, s=[None, None])
    assert exact_quantiles(df, ["s"], [0.5])["s"] == [None]


def test_levels_at_their_bounds(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (1.9,), (2.0,), (None,), (float("nan"),)], "s DOUBLE")
    got = [r[0] for r in df.select(risk_level(F.col("s"), 1.0, 2.0)).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High", "High"]


def test_unknown_level_ranks_last(spark):
    df = spark.createDataFrame([("Low",), ("Medium",), ("High",), ("Odd",), (None,)], "l STRING")
    assert [r[0] for r in df.select(level_rank(F.col("l"))).collect()] == [1, 2, 3, 4, 4]
