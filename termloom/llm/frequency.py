"""Problem 1: how often every term occurs, in how many records, and which are too rare or too common to search by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termloom.session import table


def record_terms(tokens: DataFrame, record: str, place: str, text: str) -> DataFrame:
    """(record, term, tf): occurrences of every lower-cased text per record, one per (record, place).

    Copies of a (record, place) count once; if their texts differ, the least in byte order of the lower-cased counts.
    Rows with a null text don't count; the empty string is a term; a null record or place is a value like others.
    An empty table gives no rows. Other columns are not read.
    """
    once = tokens.filter(F.col(text).isNotNull()).groupBy(F.col(record).alias("record"), F.col(place).alias("__place")).agg(F.min(F.lower(text)).alias("term"))
    return once.groupBy("record", "term").agg(F.count("*").alias("tf"))


def term_frequencies(per_record: DataFrame, n_records: Column, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """(term, tf, df, mark): occurrences, records, and `rare` (df < rare_below), `common` (df > common_above * n_records) or null.

    A term that is both is `rare`. Both sums are combined by hash within each input partition before the shuffle, so a
    term that holds a third of all rows sends one partial row per partition.
    """
    t = per_record.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > n_records * F.lit(common_above), "common")
    return t.withColumn("mark", mark)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    tok = table(spark, d, "tokens").filter(F.col("tok_type") == "Text")
    n = tok.filter(F.col("text").isNotNull()).select("doc_id").distinct().agg(F.count("*")).scalar()
    return term_frequencies(record_terms(tok, "doc_id", "pos", "text"), n)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter(F.col("mark").isNotNull()).select("term", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms with their counts; the mark of usable ones is `ok`."""
    return _terms(spark, d).fillna({"mark": "ok"})


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}

_T = """WITH once AS (SELECT doc_id, pos, min(lower(text)) AS term FROM tokens WHERE tok_type = 'Text' AND text IS NOT NULL GROUP BY doc_id, pos),
t AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM once GROUP BY term),
m AS (SELECT *, CASE WHEN df < 3 THEN 'rare' WHEN df > 0.2 * (SELECT count(DISTINCT doc_id) FROM once) THEN 'common' ELSE 'ok' END AS mark FROM t)
"""
SQL = {"p1_found": _T + "SELECT term, mark FROM m WHERE mark <> 'ok'", "p1_terms": _T + "SELECT term, tf, df, mark FROM m"}
