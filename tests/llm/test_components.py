from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sismo.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def same_parts(got, want):
    parts = {}
    for n, r in got.items():
        parts.setdefault(r, set()).add(n)
    return sorted(map(sorted, parts.values())) == sorted(sorted(n for n in want if want[n] == r) for r in set(want.values()))


def run(spark, edges):
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.root for r in rows}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), max_size=40))
def test_matches_union_find(spark, edges):
    assert same_parts(run(spark, edges), brute(edges))


def test_chain_star_and_nulls(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    got = run(spark, chain + star + [(5000, 5000)])
    assert same_parts(got, brute(chain + star + [(5000, 5000)]))
    assert run(spark, [(None, 1), (1, None), (2, 3)]) in ({2: 2, 3: 2}, {2: 3, 3: 3})
    assert run(spark, []) == {}
