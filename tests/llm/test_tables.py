"""Frequencies, distinctive terms and the best of every group."""

import math
import random

from termloom.llm.distinctive import best_terms, term_scores
from termloom.llm.frequency import record_terms, term_frequencies
from termloom.llm.topn import top_n
from pyspark.sql import functions as F


def test_frequencies(spark):
    t = spark.createDataFrame([(1, 1, "A", 9), (1, 1, "a", 9), (1, 2, "a", 9), (2, 1, "a", 9), (3, 1, None, 9), (None, 1, "b", 9), (4, None, "", 9)], "doc int, pos int, text string, term int")
    r = record_terms(t, "doc", "pos", "text")
    got = {x.term: (x.tf, x.df, x.mark) for x in term_frequencies(r, F.lit(4), rare_below=2, common_above=0.4).collect()}
    assert got == {"a": (3, 2, "common"), "b": (1, 1, "rare"), "": (1, 1, "rare")}
    assert record_terms(t.limit(0), "doc", "pos", "text").count() == 0


def test_scores_and_ties(spark):
    p = spark.createDataFrame([("b", 1, 1), ("a", 1, 1), ("c", 1, 0), ("z", 2, 4), ("y", 2, 2), (None, 3, 1)], "term string, doc_id long, f int")
    s = {(r.doc_id, r.term): r.score for r in term_scores(p, k1=None).collect()}
    assert s[2, "z"] == 4 * math.log(2.5 / 1.5) and s[1, "c"] == 0 and (3, None) not in s
    best = best_terms(term_scores(p, k1=None), 2).collect()
    assert {(r.doc_id, r.term) for r in best} == {(1, "a"), (1, "b"), (2, "z"), (2, "y")}
    assert term_scores(p.limit(0)).count() == 0
    full = {(r.doc_id, r.term): r.score for r in term_scores(p).collect()}
    assert full[1, "c"] == 0 and full[2, "z"] > full[2, "y"]


def test_top_n_against_brute_force(spark):
    r = random.Random(2)
    data = []
    for g in range(6):
        for i in range(3000 if g == 0 else r.randint(0, 40)):
            data.append((f"g{g}" if g else None, r.randint(0, 1500), r.choice([None, float("nan"), -1.0, 0.0, 2.5, r.random() * 10, float("inf")])))
    want = {}
    for g, i, s in data:
        if s is not None and not math.isnan(s):
            want.setdefault(g, {})
            want[g][i] = max(s, want[g].get(i, -math.inf))
    df = spark.createDataFrame(data, "g string, item int, score double").withColumn("rank", F.lit("clash"))
    got = {}
    for x in top_n(df, "g", "item", "score", 7, large=50).collect():
        got.setdefault(x.g, {})[x["rank"]] = (x.item, x.score)
    for g, items in want.items():
        best = sorted(items.items(), key=lambda kv: (-kv[1], kv[0]))[:7]
        assert [got[g][k + 1] for k in range(len(best))] == best and len(got[g]) == len(best)
    assert top_n(df.limit(0), "g", "item", "score", 7).count() == 0 and top_n(df, "g", "item", "score", 0).count() == 0
