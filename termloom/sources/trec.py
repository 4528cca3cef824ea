"""TREC-style document files, topic files and run files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Base names of at least two characters that don't begin with a dot.
PATTERN = r"^[^\.].+"


def read_files(spark: SparkSession, root: str, pattern: str = PATTERN) -> DataFrame:
    """(path, text): all files below root whose base name matches."""
    t = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("__n"), F.col("value").alias("text"))
    return t.filter(F.col("__n").rlike(pattern)).drop("__n")


def split_documents(files: DataFrame, text: str = "text") -> DataFrame:
    """(docno, text, error) of the documents of files; an unfinished last document is left out.

    docno is what DOCNO holds without white space; text is what TEXT elements hold, joined by line breaks. error tells
    what is missing; such documents stay.
    """
    d = files.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)<DOC>(.*?)</DOC>"), F.lit(1))).alias("doc"))
    docno = F.nullif(F.regexp_replace(F.regexp_extract("doc", r"(?s)<DOCNO>(.*?)</DOCNO>", 1), r"\s+", ""), F.lit(""))
    body = F.regexp_extract_all(F.col("doc"), F.lit(r"(?s)<TEXT>(.*?)</TEXT>"), F.lit(1))
    error = F.when(docno.isNull(), "no DOCNO").when(F.size(body) == 0, "no TEXT")
    return d.select(docno.alias("docno"), F.array_join(body, "\n").alias("text"), error.alias("error"))


def read_topics(files: DataFrame, text: str = "text") -> DataFrame:
    """(qid, text): `<num> Number: ` gives the id, the next `<title> Topic: ` the text; a title without a number is left out."""
    t = files.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)<num>\s*Number:\s*[^\n]*(?:(?!<num>).)*?<title>\s*Topic:[^\n]*"), F.lit(0))).alias("t"))
    return t.select(F.trim(F.regexp_extract("t", r"<num>\s*Number:\s*([^\n]*)", 1)).alias("qid"), F.trim(F.regexp_extract("t", r"<title>\s*Topic:\s*([^\n]*)", 1)).alias("text"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(term): the words of files of stop words, parted by white space; each once."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("term"))
    return words.filter(F.col("term") != "").distinct()


def run_lines(results: DataFrame, limit: int = 100) -> DataFrame:
    """(value): `qid Q0 docno rank score source`, rank from 0 and below limit, score with six places."""
    r = results.filter(F.col("rank") < limit)
    return r.select(F.concat_ws(" ", F.col("qid"), F.lit("Q0"), F.col("docno"), F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.col("source")).alias("value"))


def read_run(lines: DataFrame) -> DataFrame:
    """The results of run file lines; lines that don't have six parts are left out."""
    p = F.split("value", " ")
    return lines.filter(F.size(p) == 6).select(p[0].alias("qid"), p[2].alias("docno"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("source"))
