"""Problem 5: keys of tokens and postings that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.operators.skew import key_sizes
from termloom.session import table


def counted_tokens(spark: SparkSession, d: str) -> DataFrame:
    """One row per (doc_id, pos) of the Text rows that have a text: doc_id, pos, term (lower case, the least if copies differ)."""
    t = table(spark, d, "tokens").filter((F.col("tok_type") == "Text") & F.col("text").isNotNull())
    return t.groupBy("doc_id", "pos").agg(F.min(F.lower("text")).alias("term"))


def tagged_postings(spark: SparkSession, d: str) -> DataFrame:
    """One row per (term, doc_id): the greatest non-null pls_tag of its copies, null if all are."""
    return table(spark, d, "postings").groupBy("term", "doc_id").agg(F.max("pls_tag").alias("pls_tag"))


def _sizes(spark: SparkSession, d: str, distinct: bool) -> DataFrame:
    text = key_sizes(counted_tokens(spark, d).withColumnRenamed("term", "key_value"), ["key_value"], ["doc_id", "pos"], "doc_id" if distinct else None)
    tags = tagged_postings(spark, d).filter(F.col("pls_tag").isNotNull()).withColumnRenamed("pls_tag", "key_value")
    tags = key_sizes(tags, ["key_value"], ["doc_id", "term"], "doc_id" if distinct else None)
    cols = ["key_value", "n", *(["runs"] if distinct else []), F.col("first.doc_id").alias("first_doc"), F.col("last.doc_id").alias("last_doc")]
    return text.select(F.lit("text").alias("key_field"), *cols).unionByName(tags.select(F.lit("pls_tag").alias("key_field"), *cols))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms with at least 1 % of all counted tokens, containers with at least 5 % of the distinct postings that have one."""
    sizes = _sizes(spark, d, False).select("key_field", "key_value", "n")
    both = sizes.groupBy("key_field").agg(F.sum("n").alias("total"))  # two rows
    sizes = sizes.join(F.broadcast(both), "key_field")
    share = F.when(F.col("key_field") == "text", 100).otherwise(20)
    return sizes.filter(F.col("n") * share >= F.col("total")).select("key_field", "key_value")


def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    """True size of every term and container, its documents, its first and its last document."""
    return _sizes(spark, d, True).withColumnRenamed("runs", "n_docs")


QUERIES = {"p5_found": p5_found, "p5_sizes": p5_sizes}

_RAW = """
WITH tok AS (SELECT doc_id, pos, min(lower(text)) AS key_value FROM tokens WHERE tok_type = 'Text' AND text IS NOT NULL GROUP BY doc_id, pos),
post AS (SELECT * FROM (SELECT term, doc_id, max(pls_tag) AS key_value FROM postings GROUP BY term, doc_id) WHERE key_value IS NOT NULL),
sizes AS (SELECT 'text' AS key_field, key_value, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM tok GROUP BY key_value
UNION ALL SELECT 'pls_tag', key_value, count(*), count(DISTINCT doc_id), min(doc_id), max(doc_id) FROM post GROUP BY key_value)
"""
SQL = {
    "p5_found": _RAW + """SELECT key_field, key_value FROM (SELECT *, sum(n) OVER (PARTITION BY key_field) AS total FROM sizes)
WHERE n * CASE key_field WHEN 'text' THEN 100 ELSE 20 END >= total""",
    "p5_sizes": _RAW + "SELECT key_field, key_value, n, n_docs, first_doc, last_doc FROM sizes",
}
