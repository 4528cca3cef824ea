import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.operators.skew import chunked, key_sizes, number_rows, process_chunks, with_key_stat


def rows(spark, n=4000, seed=1):
    r = random.Random(seed)
    data = [(("hot" if r.random() < 0.4 else r.choice(["a", "b", "", None, "c"])), r.randint(1, 60), i) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, d int, p int")


def test_sizes_against_brute_force(spark):
    data, df = rows(spark)
    want = defaultdict(list)
    for k, d, p in data:
        want[k].append((d, p))
    got = {r.k: r for r in key_sizes(df, ["k"], ["d", "p"], "d", chunk_rows=100).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        g = got[k]
        assert (g.n, g.runs, tuple(g.first), tuple(g.last)) == (len(v), len({d for d, _ in v}), min(v), max(v))
        assert g.chunks == -(-len(v) // 100)


def test_chunks_are_bounded_and_ordered(spark):
    _, df = rows(spark)
    c = chunked(df, ["k"], ["d", "p"], chunk_rows=150)
    per = c.groupBy("k", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("d", "p")).alias("a"), F.max(F.struct("d", "p")).alias("b")).orderBy("k", "chunk").collect()
    assert max(r.n for r in per) <= 150 and c.count() == 4000
    for x, y in zip(per, per[1:]):
        if x.k == y.k:
            assert tuple(x.b) < tuple(y.a)


def test_numbers_are_exact(spark):
    _, df = rows(spark, 500)
    laid, off = number_rows(df, ["k"], ["d", "p"])
    j = laid.alias("l").join(off.alias("o"), F.expr("l.__file = o.__file AND l.k <=> o.k"))
    got = j.select("l.k", "l.d", "l.p", F.expr("o.__before + l.__row - o.__first").alias("n")).collect()
    data = sorted(((str((r.k is None, r.k)), r.d, r.p), r.n) for r in got)
    at: dict = {}
    for (k, _, _), n in data:
        assert n == at.get(k, 0)
        at[k] = n + 1
    assert len(got) == 500


def test_empty_and_clashing_names(spark):
    e = spark.createDataFrame([], "k string, d int, chunk int, n int")
    assert key_sizes(e, ["k"], ["d"]).count() == 0
    f = spark.createDataFrame([("x", 1, 7, 8), ("x", 1, 7, 8), (None, None, 1, 1)], "k string, d int, chunk int, n int")
    assert {r.k: (r.n, r.runs) for r in key_sizes(f, ["k"], ["d"], "d").collect()} == {"x": (2, 1), None: (1, 1)}
    with pytest.raises(ValueError):
        key_sizes(f, ["k"], ["d"], "n")


def test_process_chunks(spark):
    _, df = rows(spark, 1000)
    out = process_chunks(df, ["k"], ["d", "p"], lambda p: p.assign(m=len(p))[["p", "m"]], "p int, m int", chunk_rows=50)
    assert out.count() == 1000 and out.agg(F.max("m")).first()[0] <= 50


def test_key_stat_join(spark):
    _, df = rows(spark, 1000)
    stat = df.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("w"))
    got = with_key_stat(df, stat, "k", "w", max_hot=4)
    assert got.count() == df.filter("k IS NOT NULL").count()
