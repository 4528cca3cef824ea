"""Phrases of neighbouring tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def phrases(tokens: DataFrame, length: int = 2, limit: float = 0.2, least: int = 25, flush_last: bool = False, doc: str = "doc_id", pos: str = "pos", text: str = "term", seg: str = "seg") -> DataFrame:
    """(doc, pos, phrase): phrases of up to `length` tokens, pos from 0.

    Terms with at least `limit` of the frequency of a document's most frequent term are stop words of it (none in
    documents of under `least` tokens). Stop words and changes of `seg` end a segment; a segment of m tokens gives one
    phrase if m <= length, else m - length + 1. The last window of a document is lost unless its last token is a stop
    word or flush_last is set. Case counts. The tokens of one document are sorted together, those of a term aren't.
    """
    d = W.partitionBy(doc)
    t = tokens.select(doc, pos, F.col(text).alias("__t"), F.col(seg).alias("__g"))
    counts = t.groupBy(doc, "__t").agg(F.count("*").alias("__k"))
    tops = counts.groupBy(doc).agg(F.max("__k").alias("__top"), F.sum("__k").alias("__n"))
    stops = counts.join(tops, doc).filter((F.col("__n") >= least) & (F.col("__k") / F.col("__top") >= limit)).select(doc, "__t", F.lit(True).alias("__stop"))
    t = t.join(stops, [doc, "__t"], "left").withColumn("__stop", F.coalesce("__stop", F.lit(False)))
    o = d.orderBy(pos)
    t = t.withColumn("__cut", F.sum(F.col("__stop").cast("int")).over(o)).withColumn("__end", F.last("__stop").over(o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    t = t.filter(~F.col("__stop"))
    prior = F.lag("__g").over(W.partitionBy(doc, "__cut").orderBy(pos))
    t = t.withColumn("__seg", F.sum((prior != F.col("__g")).cast("int")).over(W.partitionBy(doc, "__cut").orderBy(pos)))
    t = t.withColumn("__seg", F.coalesce("__seg", F.lit(0)))
    s = W.partitionBy(doc, "__cut", "__seg")
    so = s.orderBy(pos)
    t = t.withColumn("__i", F.row_number().over(so)).withColumn("__m", F.count("*").over(s)).withColumn("__w", F.collect_list("__t").over(so.rowsBetween(-(length - 1), 0)))
    t = t.filter((F.col("__i") >= length) | ((F.col("__m") < length) & (F.col("__i") == F.col("__m"))))
    t = t.withColumn("__last", F.lead("__i").over(o).isNull()).withColumn("pos_", F.row_number().over(o) - 1)
    if not flush_last:
        t = t.filter(~F.col("__last") | F.col("__end"))
    return t.select(doc, F.col("pos_").alias("pos"), F.array_join("__w", " ").alias("phrase"))
