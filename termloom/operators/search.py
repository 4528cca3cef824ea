"""Batches of queries against one or several indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from termloom.functions.markup_tokens import tokenize
from termloom.operators.index import Index, run_chain
from termloom.operators.rank import best, fall_back, threshold_terms
from termloom.session import written


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """(qid, pos, term, thresh): queries (qid, text, query_thresh) through the tokenizer and the index's own chain."""
    t = tokenize(queries.filter(F.col("text").isNotNull()), "qid", "text").filter("type = 'Text'")
    t = t.select(F.col("qid").alias("doc_id"), "pos", "term", "seg", F.lit(False).alias("final"))
    out = run_chain(t, index.meta["chain"]).withColumnRenamed("doc_id", "qid")
    return out.select("qid", F.struct("pos", "sub").alias("pos"), "term").join(queries.select("qid", F.col("query_thresh").alias("thresh")), "qid")


def search(queries: DataFrame, indexes: dict[str, Index], limit: int = 100, digits: int | None = None) -> DataFrame:
    """(qid, doc_id, docno, rank, score, source): each query (qid, text, engine, index_pref, force, query_thresh) by its engine
    on its preferred indexes in turn; the first with results answers. The last preference is forced if it is an index.

    With `digits` scores are rounded before they are ranked, so that sums that differ in their last places tie.
    Engines go by name in any case; queries with an unknown or null engine, no text or no answer have no rows.
    """
    prefs = F.filter(F.transform(F.split("index_pref", ","), F.trim), lambda x: x != "")
    q = written(queries.select(F.rtrim("qid").alias("qid"), "text", F.upper("engine").alias("engine"), "index_pref", F.coalesce("force", F.lit(False)).alias("force"), "query_thresh", F.element_at(prefs, -1).alias("__last"), prefs.alias("__prefs")), "queries")
    parts = []
    for tag, index in indexes.items():
        mine = q.filter(F.array_contains("__prefs", tag))
        terms = threshold_terms(query_terms(mine, index), index)
        terms = terms.join(mine.select("qid", "engine", (F.col("force") | (F.col("__last") == tag)).alias("force")), "qid")
        terms = written(terms.select("qid", F.row_number().over(W.partitionBy("qid").orderBy("pos")).alias("pos"), "term", "engine", "force"), "terms")  # used several times below
        s = best(terms, index, None, limit, digits)  # more of an index can't be in the result
        parts.append(written(s.join(index.docs.select("doc_id", "docno"), "doc_id").withColumn("source", F.lit(tag)), "answers"))
    answers = fall_back(q.select("qid", "index_pref"), reduce(DataFrame.unionByName, parts))
    return answers.select("qid", "doc_id", "docno", "rank", "score", "source")
