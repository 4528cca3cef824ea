"""Streams: postings of arriving documents, and queries that arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from termloom.functions.markup_tokens import tokenize
from termloom.operators.index import Index, postings_of
from termloom.session import written


def append_postings(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text"):
    """A streaming query that appends (term, doc_id, tf, positions) of each micro-batch of documents to a Parquet table.

    A micro-batch that is run again replaces its own folder, so postings are written once.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        t = tokenize(batch, key, text).filter("type = 'Text'")
        p = postings_of(t.select(F.lower("term").alias("term"), F.col(key).alias("doc_id"), "pos"), True)
        p.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def lookup_stream(queries: DataFrame, index: Index) -> DataFrame:
    """Term statistics for a stream of (qid, term): a stream-static join with the lexicon, which is counted and written once."""
    lex = index.lex if index.lex is not None else written(index.lexicon(), "lexicon")
    return queries.join(lex, "term", "left")
