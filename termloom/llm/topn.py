"""Problem 7: the N best items of every group, with one choice among equal scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from termloom.session import table


def top_n(items: DataFrame, group: str, item: str, score: str, n: int, large: int = 200, max_large: int = 100_000) -> DataFrame:
    """(group, item, score, rank): the n best items of each group; equal scores go by the smaller item.

    Null and NaN scores don't take part; an item that comes repeatedly in its group has its highest score. Infinite
    scores order as numbers do. A null group or item is a value like others (null items are smallest). n < 1 or an empty
    table gives no rows. Clashing column names don't matter: only the three columns are read.

    Groups of over `large` items (or over 1/max_large of all items, so that there are never more than max_large such
    groups to broadcast) get a histogram of their scores, combined per input partition. The least score of the fewest
    upper bins that hold n items is the group's threshold: at least n items survive it. Rows below are dropped before
    the exact ranking, which also cuts to n per group in every task before its shuffle. The bins only steer how many
    survive; the result is exact for any bins.
    """
    raw = items.select(F.col(group).alias("group"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    best = raw.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("group", "item").agg(F.max("score").alias("score"))
    s = F.col("score")
    bin_ = F.signum(s) * F.floor(F.log2(F.greatest(F.least(F.abs(s), F.lit(1e300)), F.lit(1e-300))) * 32 + 32_000)
    hist = best.groupBy("group", bin_.alias("bin")).agg(F.count("*").alias("k"), F.min("score").alias("low"))
    total = best.agg(F.count("*")).scalar()
    w = W.partitionBy("group")  # a group has at most 128,000 bins, whatever its items
    sized = hist.withColumn("size", F.sum("k").over(w)).filter((F.col("size") > large) & (F.col("size") * F.lit(max_large) > total))
    above = F.coalesce(F.sum("k").over(w.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    limits = sized.withColumn("above", above).filter(F.col("above") < n).groupBy("group").agg(F.min("low").alias("least"))
    kept = best.alias("b").join(F.broadcast(limits).alias("t"), F.col("b.group").eqNullSafe(F.col("t.group")), "left")
    kept = kept.filter(F.col("t.least").isNull() | (F.col("b.score") >= F.col("t.least"))).select("b.*")
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.desc("score"), F.asc_nulls_first("item")))
    kept = kept.withColumn("rank", rank).filter(F.col("rank") <= n)
    return kept.select(F.col("group").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")


def _best(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").withColumn("qid", F.rtrim("qid"))
    return top_n(r, "qid", "doc_id", "score", 10)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("qid", "doc_id")


def p7_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d)


QUERIES = {"p7_found": p7_found, "p7_ranks": p7_ranks}

_R = """WITH b AS (SELECT rtrim(qid) AS qid, doc_id, max(score) AS score FROM results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b)
"""
SQL = {"p7_found": _R + "SELECT qid, doc_id FROM r WHERE rank <= 10", "p7_ranks": _R + "SELECT qid, doc_id, score, rank FROM r WHERE rank <= 10"}
