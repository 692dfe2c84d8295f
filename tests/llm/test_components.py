import random

import pytest

from gridlark.llm.components import connected_components


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    n = 400
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(60)]
    edges += [(7, 7), (9999, 9999), (None, 3), (4, None)] + edges[:5]
    rng.shuffle(edges)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["v"]: r["c"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in up}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_filter_marks_all_wanted_rows_and_few_others(spark):
    from gridlark.llm.common import Scratch, bit_filter, with_mark

    rows = spark.range(20_000).selectExpr("CASE WHEN id % 100 = 7 THEN null ELSE id END AS k", "id AS at_", "'x' AS mask")
    with Scratch(spark) as scratch:
        got = with_mark(rows, "k", bit_filter(spark.range(0, 20_000, 7).toDF("k"), "k", scratch)).collect()
        assert len(got) == 20_000 and not any(r["_mark"] for r in with_mark(rows, "k", bit_filter(spark.range(0).toDF("k"), "k", scratch)).collect())
    assert all(r["_mark"] for r in got if r["k"] is not None and r["k"] % 7 == 0)
    assert sum(r["_mark"] for r in got) < 2900
