"""Property tests on seeded random frames (hypothesis) against numpy/pandas."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sismo.functions.cells import cell_of
from sismo.operators import ordering as od

coords = st.lists(st.floats(min_value=-180, max_value=180, allow_nan=False).map(lambda v: round(v, 3)),
                  min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(coords, st.sampled_from([0.5, 0.25, 1.0]))
def test_cells_equal_numpy_half_even(spark, xs, b):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r["c"] for r in df.select(cell_of("x", b).alias("c")).collect()]
    want = (np.rint(np.array(xs) / b) * b + 0.0).tolist()
    assert got == want
    assert all(np.copysign(1.0, g) == 1.0 for g in got if g == 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=60),
       st.integers(1, 5))
def test_interpolation_equals_pandas(spark, vals, parts):
    pdf = pd.DataFrame({"event_id": np.arange(len(vals)), "v": pd.array(vals, dtype="Float64")})
    df = spark.createDataFrame([(int(i), v) for i, v in enumerate(vals)], "event_id long, v double")
    got = od.interpolate_linear(df, ["v"], order=[F.col("event_id")], partitions=parts) \
        .orderBy("pos").toPandas()["v"].to_numpy(dtype=float)
    want = pdf["v"].astype("float64").interpolate().to_numpy(dtype=float)
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-9, equal_nan=True)
