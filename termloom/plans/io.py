"""Queries on the forms documents, topics, postings and messages are read and written in, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.operators import index as I, rank as R
from termloom.operators.index import dump_postings, parse_postings
from termloom.operators.skew import number_rows, salted_join
from termloom.plans.retrieval import _FALL, _WITH, SQL as _RETRIEVAL, answers, base_index, names, topics
from termloom.session import shared_dir, table
from termloom.sources import messages, trec


def document_files(spark: SparkSession, d: str) -> DataFrame:
    """Passages put into document files, and the documents read from these."""
    p = table(spark, d, "passages").filter(F.col("text").isNotNull())
    f = p.select(F.concat(F.lit("<DOC>\n<DOCNO> P-"), F.col("passage_id").cast("string"), F.lit(" </DOCNO>\n<TEXT>"), "text", F.lit("</TEXT>\n</DOC>\n")).alias("text"))
    return trec.split_documents(f)


def topic_files(spark: SparkSession, d: str) -> DataFrame:
    """Topics put into topic files, and the queries read from these; a topic is a line."""
    t = table(spark, d, "topics").filter(F.col("text").isNotNull())
    line = F.regexp_replace("text", r"[\n\r]+", " ")
    return trec.read_topics(t.select(F.concat(F.lit("<top>\n<num> Number: "), "qid", F.lit(" \n<title> Topic: "), line, F.lit("\n\n<desc> Description:\n</top>\n")).alias("text")))


def json_queries(spark: SparkSession, d: str) -> DataFrame:
    """Topics as JSON messages, and read from these; their threshold goes by their engine, and those without text look terms up."""
    t = table(spark, d, "topics").withColumn("query_thresh_ranker", F.lower("engine")).withColumn("type", F.col("text").isNull().cast("int"))
    return messages.to_queries(messages.from_queries(t))


def text_postings(spark: SparkSession, d: str) -> DataFrame:
    """Positional postings as lines of text, and read from these."""
    p = parse_postings(dump_postings(base_index(spark, d, True).postings), True)
    return p.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), " "))


def lexicon_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon in byte order of its terms, numbered from 1 without one task sorting all."""
    lex = base_index(spark, d).lexicon().withColumn("one", F.lit(1))
    laid, off = number_rows(lex, ["one"], ["term"])
    n = laid.join(off, ["__file", "one"]).withColumn("i", F.col("__before") + F.col("__row") - F.col("__first") + 1)
    return n.select("i", F.format_string("%d. '%s' [%d]: %d documents", "i", "term", "tf", "df").alias("line"))


def lexicon_postings(spark: SparkSession, d: str) -> DataFrame:
    """The printed posting lists of all terms, in parts of at most 100 entries."""
    return I.posting_strings(base_index(spark, d).postings, 100)


def term_postings(spark: SparkSession, d: str) -> DataFrame:
    """The posting lists of the topics' words, with positions."""
    p = base_index(spark, d, True).postings
    words = topics(spark, d).select("term").distinct()
    return I.posting_strings(salted_join(p, words, "term", F.col("doc_id")))


def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon of an index that was pruned, saved and loaded: frequencies are those of what is stored."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.save(I.prune(base_index(spark, d), "soft 1.5"), path)
    return I.load(spark, path).lexicon()


def stored_postings(spark: SparkSession, d: str) -> DataFrame:
    """A positional index saved and loaded."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.save(base_index(spark, d, True), path)
    return I.load(spark, path).postings.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), " "))


def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document table of an index saved and loaded."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.save(base_index(spark, d), path)
    return I.load(spark, path).docs.select("doc_id", "docno", "ord", "term_count", "max_tf", F.round("norm2", 4).alias("norm2"))


def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    """Passages written as document files in several folders, found below the root and read. Every seventh has no DOCNO and
    every eleventh no TEXT; a file that a dot begins is passed over."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    p = table(spark, d, "passages").filter(F.col("text").isNotNull())
    i = F.col("passage_id")
    docno = F.when(i % 7 != 0, F.concat(F.lit("<DOCNO> P-"), i.cast("string"), F.lit(" </DOCNO>\n"))).otherwise("")
    body = F.when(i % 11 != 0, F.concat(F.lit("<TEXT>"), F.col("text"), F.lit("</TEXT>\n"))).otherwise("")
    files = p.select(F.concat(F.lit("<DOC>\n"), docno, body, F.lit("</DOC>")).alias("value"), (i % 3).alias("folder"))
    files.write.partitionBy("folder").text(root)
    return trec.split_documents(trec.read_files(spark, root))


def stop_word_file(spark: SparkSession, d: str) -> DataFrame:
    """Stop words written as text files, and the words read from these."""
    path = f"{shared_dir(spark)}/stops-{uuid.uuid4().hex}"
    table(spark, d, "stops").filter(F.col("term").isNotNull()).select("term").write.text(path)
    return trec.read_stop_words(spark, path)


def responses(spark: SparkSession, d: str) -> DataFrame:
    """The 100 best answers of each query by the source it falls back to as JSON messages, and read from these."""
    q = table(spark, d, "topics").select(F.trim("qid").alias("qid"), "index_pref")
    best = R.rank(R.fall_back(q, answers(spark, d)).filter(F.col("docno").isNotNull()), 100)
    return messages.read_responses(messages.responses(best))


def document_map(spark: SparkSession, d: str) -> DataFrame:
    """The document map with the weight of each term as JSON, and read from it: terms and sum of weights by document."""
    i = base_index(spark, d).stored()
    lines = messages.document_map_rows(i.docs, I.online_weights(i.postings, names(spark, d)))
    m = messages.read_document_map(lines.select(F.concat(F.lit("["), "value", F.lit("]")).alias("value")))
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x)
    return m.select("doc_id", "docno", "term_count", "max_tf", F.coalesce(F.size("weights"), F.lit(0)).alias("n_terms"), F.round(F.coalesce(total, F.lit(0.0)), 4).alias("weight"))


def run_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a run file, read again."""
    from termloom.plans.retrieval import topk_run

    return trec.read_run(topk_run(spark, d))


QUERIES = {
    "document_files": document_files, "topic_files": topic_files, "json_queries": json_queries, "text_postings": text_postings, "lexicon_lines": lexicon_lines, "run_files": run_files,
    "lexicon_postings": lexicon_postings, "term_postings": term_postings, "stored_index": stored_index, "stored_postings": stored_postings, "stored_documents": stored_documents,
    "scanned_documents": scanned_documents, "stop_word_file": stop_word_file, "responses": responses, "document_map": document_map,
}

SQL = {
    "document_files": "SELECT 'P-' || passage_id AS docno, text, NULL::VARCHAR AS error FROM passages WHERE text IS NOT NULL",
    "topic_files": r"SELECT trim(qid) AS qid, trim(regexp_replace(text, '[\n\r]+', ' ', 'g')) AS text FROM topics WHERE text IS NOT NULL",
    "json_queries": "SELECT qid, text, engine, index_pref, coalesce(force, false) AS force, query_thresh, lower(engine) AS query_thresh_ranker, (text IS NULL)::INTEGER AS type FROM topics",
    "lexicon_postings": f"{_WITH}, r AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 100 AS part FROM p) SELECT term, part, string_agg(doc_id || ' ' || tf, ' | ' ORDER BY doc_id) AS list FROM r GROUP BY term, part",
    "term_postings": f"{_WITH}, r AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 1000 AS part FROM p WHERE term IN (SELECT term FROM qt)) SELECT term, part, string_agg(doc_id || ' ' || array_to_string(positions, ' '), ' | ' ORDER BY doc_id) AS list FROM r GROUP BY term, part",
    "stored_index": f"SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM ({_RETRIEVAL['prune_soft']}) GROUP BY term",
    "stored_postings": _RETRIEVAL["postings_positional"],
    "stored_documents": _RETRIEVAL["doc_stats"],
    "scanned_documents": """SELECT CASE WHEN passage_id % 7 <> 0 THEN 'P-' || passage_id END AS docno, CASE WHEN passage_id % 11 <> 0 THEN text ELSE '' END AS text,
CASE WHEN passage_id % 7 = 0 THEN 'no DOCNO' WHEN passage_id % 11 = 0 THEN 'no TEXT' END AS error FROM passages WHERE text IS NOT NULL""",
    "stop_word_file": r"SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(term, '\s+')) AS term FROM stops) WHERE term <> ''",
    "responses": f"{_FALL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM f WHERE docno IS NOT NULL) SELECT qid, rank::INTEGER AS rank, docno, score, source, '' AS error FROM r WHERE rank < 100",
    "document_map": f"{_WITH} SELECT d.doc_id, d.docno, d.term_count, d.max_tf, count(w.term)::INTEGER AS n_terms, round(coalesce(sum(weight), 0.0), 4) AS weight FROM d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY ALL",
    "text_postings": _RETRIEVAL["postings_positional"],
    "lexicon_lines": f"{_WITH} SELECT i, printf('%d. ''%s'' [%d]: %d documents', i, term, tf, df) AS line FROM (SELECT *, row_number() OVER (ORDER BY term) AS i FROM lex)",
    "run_files": f"SELECT l[1] AS qid, l[3] AS docno, l[4]::INTEGER AS rank, l[5]::DOUBLE AS score, l[6] AS source FROM (SELECT string_split(value, ' ') AS l FROM ({_RETRIEVAL['topk_run']}))",
}
