"""Property test: the two-phase primitives equal plain Python on random inputs
(random sizes, heavy ties, random partitioning)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarmac.operators import scale


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(n=st.integers(1, 300), distinct=st.integers(1, 20), parts=st.integers(1, 9), seed=st.integers(0, 10_000))
def test_two_phase_equals_python(spark, n, distinct, parts, seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, distinct, n).tolist()
    vals = rng.integers(1, 1000, n).tolist()
    rows = [(float(k), f"r{i:04d}", int(v)) for i, (k, v) in enumerate(zip(keys, vals))]
    df = spark.createDataFrame(rows, "k double, name string, v long").repartition(parts)
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    want_cum, acc = {}, 0
    for r in order:
        acc += r[2]
        want_cum[r[1]] = acc
    got = scale.running_total(df, [F.col("k").desc(), F.col("name").asc()], "v", "cum", "tot", small=False)
    got = {r["name"]: (r["cum"], r["tot"]) for r in got.collect()}
    assert got == {k: (c, acc) for k, c in want_cum.items()}
    ids = scale.ordered_row_id(df, [F.col("k").desc(), F.col("name").asc()], "rid", start=1, small=False)
    want_ids = {r[1]: i + 1 for i, r in enumerate(order)}
    assert {r["name"]: r["rid"] for r in ids.collect()} == want_ids
    q = scale.exact_quantiles(df, {"v": [0.0, 0.25, 0.5, 0.9, 1.0]})["v"]
    assert np.allclose(q, np.percentile(np.array(vals, dtype=float), [0, 25, 50, 90, 100]))
