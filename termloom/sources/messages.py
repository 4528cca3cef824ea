"""JSON forms of queries, results and the document map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

QUERY = "Id string, Text string, Engine string, IndexPref string, Force boolean, QueryThresh double, QueryThreshRanker string, Type int"
RESPONSE = "Results array<struct<Document: string, Score: double, Info: string>>, Error string, Source string"
DOCUMENT = "array<struct<Id: bigint, HumanId: string, TermCount: bigint, MaxTf: bigint, TermTfIdf: map<string, double>>>"


def to_queries(lines: DataFrame) -> DataFrame:
    """queries of JSON messages (value); a message that can't be read gives a row of nulls. type 0 is a ranked query, others
    look terms up."""
    q = lines.select(F.from_json("value", QUERY).alias("q"))
    names = {"qid": "Id", "text": "Text", "engine": "Engine", "index_pref": "IndexPref", "query_thresh": "QueryThresh", "query_thresh_ranker": "QueryThreshRanker"}
    rest = [F.coalesce("q.Force", F.lit(False)).alias("force"), F.coalesce("q.Type", F.lit(0)).alias("type")]
    return q.select(*[F.col(f"q.{v}").alias(k) for k, v in names.items()], *rest)


def from_queries(queries: DataFrame) -> DataFrame:
    names = {"qid": "Id", "text": "Text", "engine": "Engine", "index_pref": "IndexPref", "force": "Force", "query_thresh": "QueryThresh", "query_thresh_ranker": "QueryThreshRanker", "type": "Type"}
    s = F.struct(*[F.col(k).alias(v) for k, v in names.items() if k in queries.columns])
    return queries.select(F.to_json(s).alias("value"))


def responses(results: DataFrame) -> DataFrame:
    """(qid, value): one JSON response per query, results in rank order (a query's results are cut before)."""
    one = F.struct("rank", F.col("docno").alias("Document"), F.col("score").alias("Score"), F.lit("").alias("Info"))
    g = results.groupBy("qid").agg(F.sort_array(F.collect_list(one)).alias("r"), F.first("source").alias("Source"))
    r = F.transform("r", lambda x: F.struct(x["Document"].alias("Document"), x["Score"].alias("Score"), x["Info"].alias("Info")))
    return g.select("qid", F.to_json(F.struct(r.alias("Results"), F.lit("").alias("Error"), "Source")).alias("value"))


def read_responses(lines: DataFrame) -> DataFrame:
    """(qid, rank, docno, score, source, error) of responses (qid, value); one row with a null rank where there is no result."""
    r = lines.select("qid", F.from_json("value", RESPONSE).alias("r"))
    each = r.select("qid", F.col("r.Source").alias("source"), F.col("r.Error").alias("error"), F.posexplode_outer("r.Results").alias("rank", "x"))
    return each.select("qid", "rank", F.col("x.Document").alias("docno"), F.col("x.Score").alias("score"), "source", "error")


def read_document_map(lines: DataFrame) -> DataFrame:
    """(doc_id, docno, term_count, max_tf, weights) of a document map, a JSON array."""
    d = lines.select(F.explode(F.from_json("value", DOCUMENT)).alias("d"))
    return d.select(F.col("d.Id").alias("doc_id"), F.col("d.HumanId").alias("docno"), F.col("d.TermCount").alias("term_count"), F.col("d.MaxTf").alias("max_tf"), F.col("d.TermTfIdf").alias("weights"))


def document_map_rows(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(value): one JSON object per document; weights (doc_id, term, weight) become its map."""
    m = weights.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("TermTfIdf"))  # the terms of one document
    s = F.struct(F.col("doc_id").alias("Id"), F.col("docno").alias("HumanId"), F.col("term_count").alias("TermCount"), F.col("max_tf").alias("MaxTf"), "TermTfIdf")
    return docs.join(m, "doc_id", "left").select(F.to_json(s).alias("value"))
