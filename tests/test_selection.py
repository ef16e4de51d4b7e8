import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sismo.operators import selection as sel
from sismo.operators.quantiles import exact_quantiles, sorted_quantiles
from sismo.operators.topk import sample_exact_n, top_magnitude_markers


def rows_of(seed=1, n=700):
    rnd = random.Random(seed)
    pool = [0.0, -0.0, 1.5, -1e300, 1e-300, 5e-324, -5e-324, float("inf"), float("-inf"), float("nan"), None, 4.4, 4.4, 4.5]
    return [(i, rnd.choice(["a", "b", None, "c\x1f"]), rnd.choice(pool) if rnd.random() < 0.4 else rnd.gauss(0, 10 ** rnd.randrange(-5, 9)),
             rnd.choice([None, rnd.randrange(-2**62, 2**62), rnd.randrange(5)])) for i in range(n)]


def test_keys_keep_the_order():
    v = np.array([-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf])
    k = sel.ordered_keys(v)
    assert (np.diff(k) > 0).all() and [sel.key_value(x, True) for x in k] == v.tolist()
    assert sel.ordered_keys(np.array([-0.0]))[0] == sel.ordered_keys(np.array([0.0]))[0]


def brute(rows, probs):
    out = {}
    for g in {r[1] for r in rows}:
        v = sorted(r[2] for r in rows if r[1] == g and r[2] is not None and not math.isnan(r[2]))
        if v:
            q = []
            for p in probs:
                at = p * (len(v) - 1)
                lo, hi, d = v[math.floor(at)], v[math.ceil(at)], at - math.floor(at)
                q.append(lo if d == 0 else lo + (hi - lo) * d)
            out[g] = (len(v), *q)
    return out


def same(a, b):
    return a.keys() == b.keys() and all(np.array_equal(np.array(a[k], float), np.array(b[k], float), equal_nan=True) for k in a)


@pytest.mark.parametrize("hold", [200_000, 3])
def test_quantiles_by_group(spark, monkeypatch, hold):
    monkeypatch.setattr(sel, "HOLD", hold)
    rows, probs = rows_of(), (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    df = spark.createDataFrame(rows, "id long, g string, v double, n long").repartition(3)
    for f in (exact_quantiles, sorted_quantiles):
        got = {r.g: tuple(r)[1:] for r in f(df, "v", probs, ["g"]).collect()}
        assert same(got, brute(rows, probs))


def test_quantiles_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "id long, v double")
    assert [tuple(r) for r in exact_quantiles(df, "v", (0.5,)).collect()] == [(0, None)]
    assert exact_quantiles(df, "v", (0.5,), ["id"]).collect() == []
    assert [tuple(r) for r in exact_quantiles(df.limit(0), "v", (0.5,)).collect()] == [(0, None)]


def test_too_many_groups_take_the_sorted_way(spark, monkeypatch):
    rows, probs = rows_of(seed=2, n=200), (0.5,)
    df = spark.createDataFrame(rows, "id long, g string, v double, n long")
    monkeypatch.setattr(sel, "STATES", 2)
    assert sel.order_statistics(df, ["v"], probs, ["g"]) is None
    assert same({r.g: tuple(r)[1:] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}, brute(rows, probs))


def order_of(descending, last):
    def key(r):
        v = None if r[2] is None or math.isnan(r[2]) else r[2]
        n = r[3]
        return ((v is None) == last, 0.0 if v is None else (-v if descending else v) + 0.0, n is not None, n or 0, r[0])
    return key


@pytest.mark.parametrize("descending,last", [(True, True), (False, False), (True, False), (False, True)])
def test_first_rows_along_several_columns(spark, descending, last):
    rows = rows_of(seed=3, n=300)
    df = spark.createDataFrame(rows, "id long, g string, v double, n long").repartition(3)
    order = [sel.Key(F.col("v"), descending, last), sel.Key(F.col("n")), sel.Key(F.col("id"))]
    want = sorted(rows, key=order_of(descending, last))
    for k in (0, 1, 37, 150, 271, 299, 300, 1000):
        out, picked = sel.first_rows(df, order, k)
        assert sorted(r.id for r in out.collect()) == sorted(r[0] for r in want[:k])
        assert picked is not None


def test_equal_rows_are_cut_by_a_limit(spark):
    df = spark.createDataFrame([(1.0, i % 2) for i in range(20)], "v double, id long")
    out, picked = sel.first_rows(df, [sel.Key(F.col("v")), sel.Key(F.col("id"))], 13)
    assert picked is None and sorted(r.id for r in out.collect()) == [0] * 10 + [1] * 3


def test_plans_have_no_exchange_of_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "event_id long, magnitude double")
    for out in (sample_exact_n(df, 100), top_magnitude_markers(df, 100)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and out.count() == 100
