"""Queries on tokenising and token filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.functions import tokens as T
from termloom.functions.markup_tokens import tokenize as tokenize_all
from termloom.functions.porter import stems
from termloom.operators.dates import FIGURES, MONTHS, dates
from termloom.operators.index import run_chain
from termloom.operators.phrases import phrases
from termloom.plans.stems import stems_sql
from termloom.session import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def stream(spark: SparkSession, d: str, together: bool = False) -> DataFrame:
    """(doc_id, pos, term, seg, final) of the token stream: one row per place that has a text. With `together` the tokens of a
    document are in one task, so that what is counted per document or per term of a document isn't shuffled again."""
    t = table(spark, d, "tokens").filter((F.col("tok_type") == "Text") & F.col("text").isNotNull())
    t = t.select("doc_id", "pos", "text", "phrase_id", "is_final").repartition("doc_id") if together else t
    return t.groupBy("doc_id", "pos").agg(F.min("text").alias("term"), F.max("phrase_id").cast("long").alias("seg"), F.max(F.coalesce("is_final", F.lit(False))).alias("final"))


STREAM = "SELECT doc_id, pos, min(text) AS term, max(phrase_id)::BIGINT AS seg, bool_or(coalesce(is_final, false)) AS final FROM tokens WHERE tok_type = 'Text' AND text IS NOT NULL GROUP BY doc_id, pos"
_BODY = f"regexp_replace(run, '{T.LEAD}', '')"
_CORE = f"regexp_replace({_BODY}, '{T.TRAIL}', '')"
RUNS = f"SELECT doc_id, unnest(l) AS run, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{T.RUN}') AS l FROM documents WHERE text IS NOT NULL)"
TERMS = f"SELECT doc_id, i, translate({_CORE}, '('')', '-') AS term FROM ({RUNS})"
NATIVE = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS pos, term FROM ({TERMS}) WHERE term <> ''"


def tokenize_native(spark: SparkSession, d: str) -> DataFrame:
    return T.native_tokens(docs(spark, d))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.native_tokens(docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document of the stream, Text and Symbol, before any filter; one per place."""
    t = table(spark, d, "tokens").filter(F.col("tok_type").isin("Text", "Symbol")).select("doc_id", "pos").distinct()
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def phrase_segments(spark: SparkSession, d: str) -> DataFrame:
    return T.phrase_segments(docs(spark, d))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """All texts, those with markup by the reader."""
    return tokenize_all(docs(spark, d))


def _filter(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return T.vocabulary_filter(T.native_tokens(docs(spark, d)), [name]).withColumnRenamed("text", "out")

    return run


def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    """The default filters but for dates, one after the other, over the vocabulary."""
    return T.vocabulary_filter(T.native_tokens(docs(spark, d)), _PLAIN).withColumnRenamed("text", "out")


def filter_dates(spark: SparkSession, d: str) -> DataFrame:
    return dates(T.native_tokens(docs(spark, d)).withColumn("final", F.lit(False)))


def chain_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The whole default chain over the native tokens of all documents."""
    t = T.native_tokens(docs(spark, d)).select("doc_id", "pos", "term", F.lit(0).cast("long").alias("seg"), F.lit(False).alias("final"))
    return run_chain(t, T.DEFAULT_CHAIN).withColumn("sub", F.array_join(F.transform("sub", lambda x: x.cast("string")), "."))


def stop_words(spark: SparkSession, d: str) -> DataFrame:
    """Stop words as they are matched: trimmed, in lower case, without apostrophes (tokens have none)."""
    s = table(spark, d, "stops").select(F.regexp_replace(F.lower(F.trim("term")), "['’]", "").alias("term"))
    return s.filter(F.col("term") != "").distinct()


def filter_stopwords(spark: SparkSession, d: str) -> DataFrame:
    """The stream in lower case without stop words; final tokens stay."""
    return run_chain(stream(spark, d), ["lower", "stopwords"], stop_words(spark, d)).select("doc_id", "pos", "term", "final")


def filter_porter(spark: SparkSession, d: str) -> DataFrame:
    return stems(stream(spark, d).select(F.lower("term").alias("term")))


def phrase_terms(spark: SparkSession, d: str) -> DataFrame:
    return phrases(stream(spark, d))


_PLAIN = [n for n in T.DEFAULT_CHAIN if n != "dates"]
_Q = lambda words: ", ".join(f"'{w}'" for w in words)


def _one(x: str, f: str = "false") -> str:
    return f"[{{'t': {x}, 'f': {f}}}]"


_DIGITS = "replace(regexp_extract(t, '^([0-9,]+)', 1), ',', '') || CASE WHEN coalesce(try_cast(regexp_extract(t, '\\.([0-9]+)$', 1) AS BIGINT), 0) > 0 THEN '.' || regexp_extract(t, '\\.([0-9]+)$', 1) ELSE '' END"
_PARTS = f"list_filter(regexp_split_to_array(t, '{T.HYPHENS}'), lambda x: x <> '')"
_JOIN = f"array_to_string({_PARTS}, '')"


def _sides(first: str, second: str, letters: str) -> str:
    return f"CASE WHEN len({letters}) >= 3 THEN [{{'t': {first} || {second}, 'f': true}}, {{'t': {letters}, 'f': true}}] ELSE {_one(f'{first} || {second}', 'true')} END"


_AN, _NA = "'^([A-z]+)-([0-9]+)$'", "'^([0-9]+)-([A-z]+)$'"
#: By filter: the list of (t, f) a text t becomes.
FILTER_SQL = {
    "digits": f"CASE WHEN regexp_matches(t, '^[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?$') THEN {_one(_DIGITS, f'({_DIGITS}) <> t')} ELSE {_one('t')} END",
    "hyphens": f"""CASE WHEN regexp_matches(t, {_AN}) THEN {_sides(f'regexp_extract(t, {_AN}, 1)', f'regexp_extract(t, {_AN}, 2)', f'regexp_extract(t, {_AN}, 1)')}
WHEN regexp_matches(t, {_NA}) THEN {_sides(f'regexp_extract(t, {_NA}, 1)', f'regexp_extract(t, {_NA}, 2)', f'regexp_extract(t, {_NA}, 2)')}
WHEN regexp_matches(t, '\\p{{Nd}}') OR len({_PARTS}) = 1 THEN {_one('t')}
WHEN len({_PARTS}) = 2 AND ({_PARTS})[1] IN ({_Q(T.PREFIXES)}) THEN [{{'t': {_JOIN}, 'f': true}}, {{'t': ({_PARTS})[2], 'f': true}}]
WHEN len({_PARTS}) = 2 THEN [{{'t': ({_PARTS})[1], 'f': true}}, {{'t': ({_PARTS})[2], 'f': true}}]
ELSE list_concat(list_transform({_PARTS}, lambda x: {{'t': x, 'f': true}}), {_one(_JOIN, 'true')}) END""",
    "slashes": f"CASE WHEN contains(t, '/') THEN list_transform(string_split(t, '/'), lambda x: {{'t': x, 'f': true}}) ELSE {_one('t')} END",
    "acronyms": f"CASE WHEN regexp_matches(t, '[A-Z][a-z]*(?:\\.[A-Z][a-z]*)+') THEN {_one("lower(replace(t, '.', ''))", 'true')} ELSE {_one('t')} END",
    "filename": f"CASE WHEN contains(t, '.') AND string_split(t, '.')[-1] IN ({_Q(T.EXTENSIONS)}) THEN [{{'t': replace(regexp_extract(t, '^(.*)\\.[^.]*$', 1), '.', ''), 'f': true}}, {{'t': t, 'f': false}}] ELSE {_one('t')} END",
    "lower": _one("lower(t)", "f"),
    "null": _one("t", "f"),
}


def chain_sql(names: list[str]) -> str:
    r = f"SELECT DISTINCT term, term AS t, false AS f, [0] AS o FROM ({NATIVE})"
    for n in names:
        e = FILTER_SQL[n] if n in T.SEES_FINAL else f"CASE WHEN f THEN {_one('t', 'true')} ELSE {FILTER_SQL[n]} END"
        r = f"SELECT term, x.t AS t, x.f AS f, list_append(o, i) AS o FROM (SELECT term, o, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT term, o, {e} AS l FROM ({r})))"
    return f"SELECT term, (row_number() OVER (PARTITION BY term ORDER BY o) - 1)::INTEGER AS sub, t AS out, f AS final FROM ({r})"


_MAP = "MAP {" + ", ".join(f"'{k}': {i + 1}" for i, n in enumerate(MONTHS) for k in dict.fromkeys((n.lower(), n[:3].lower()))) + "}"
_Y = f"try_cast(regexp_extract(t, '{FIGURES}', 3) AS INTEGER)"
_D = f"try_cast(regexp_extract(t, '{FIGURES}', 2) AS INTEGER)"
_M = f"try_cast(regexp_extract(t, '{FIGURES}', 1) AS INTEGER)"

def dates_sql(rel: str, order: str) -> str:
    """Dates over a relation (doc_id, <order>, t): its order columns, i and x (t, f) of what each token becomes."""
    return f"""
WITH a AS (SELECT doc_id, {order}, t, {_MAP}[lower(t)] AS m FROM ({rel})),
b AS (SELECT *, regexp_matches(t, '^[+-]?[0-9]{{1,18}}$') AS n, try_cast(t AS BIGINT) AS num,
  CASE WHEN try_cast(regexp_extract(t, '^(\\+?[0-9]+)[thsrd]*$', 1) AS BIGINT) BETWEEN 1 AND 30 THEN try_cast(regexp_extract(t, '^(\\+?[0-9]+)[thsrd]*$', 1) AS BIGINT) END AS d,
  CASE WHEN {_D} BETWEEN 1 AND 31 THEN printf('%02d_%02d_%04d', {_M}, {_D}, CASE WHEN {_Y} <= 20 THEN {_Y} + 2000 WHEN {_Y} < 100 THEN {_Y} + 1900 ELSE {_Y} END) END AS fig,
  row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - row_number() OVER (PARTITION BY doc_id, m IS NOT NULL ORDER BY {order}) AS g FROM a),
c AS (SELECT *, m IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, m IS NOT NULL, g ORDER BY {order}) % 2 = 1 AS s FROM b),
e AS (SELECT *, coalesce(lag(s, 1) OVER w, false) AS s1, coalesce(lag(s, 2) OVER w, false) AS s2, lag(m, 1) OVER w AS m1, lag(m, 2) OVER w AS m2, lag(d, 1) OVER w AS d1 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY {order})),
k AS (SELECT *, CASE WHEN s1 THEN {_one('t')} WHEN fig IS NOT NULL THEN {_one('fig', 'true')} WHEN s THEN {_one(f'[{_Q(MONTHS)}][m]', 'true')} ELSE {_one('t')} END AS beg FROM e),
h AS (SELECT doc_id, {order}, CASE
  WHEN s2 AND d1 IS NOT NULL AND n THEN [{{'t': t, 'f': false}}, {{'t': printf('%02d_%02d_%04d', m2, d1, num), 'f': true}}]
  WHEN s2 AND d1 IS NOT NULL THEN list_concat({_one("printf('%02d_%02d_0000', m2, d1)", 'true')}, beg)
  WHEN s1 AND d IS NOT NULL THEN []
  WHEN s1 AND n THEN [{{'t': t, 'f': false}}, {{'t': printf('%02d_00_%04d', m1, num), 'f': true}}]
  ELSE beg END AS l FROM k)
SELECT doc_id, {order}, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM h"""


_DATES = f"SELECT doc_id, pos, (i - 1)::INTEGER AS sub, x.t AS term, x.f AS final FROM ({dates_sql(f'SELECT doc_id, pos, term AS t FROM ({NATIVE})', 'pos')})"


def _group_sql(rel: str, names: list[str]) -> str:
    """Neighbouring filters over (doc_id, pos, o, t, f); the place in what a token becomes is put behind o."""
    r = f"SELECT *, [0] AS q FROM ({rel})"
    for n in names:
        e = FILTER_SQL[n] if n in T.SEES_FINAL else f"CASE WHEN f THEN {_one('t', 'true')} ELSE {FILTER_SQL[n]} END"
        r = f"SELECT doc_id, pos, o, x.t AS t, x.f AS f, list_append(q, i) AS q FROM (SELECT doc_id, pos, o, q, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, pos, o, q, {e} AS l FROM ({r})))"
    return f"SELECT doc_id, pos, list_append(o, row_number() OVER (PARTITION BY doc_id, pos, o ORDER BY q) - 1) AS o, t, f FROM ({r})"


def default_chain_sql(rel: str) -> str:
    """The default chain over a relation (doc_id, pos, t, f): (doc_id, pos, o, t, f)."""
    r = _group_sql(f"SELECT doc_id, pos, [0::BIGINT] AS o, t, f FROM ({rel})", ["digits"])
    open_ = f"SELECT doc_id, pos, list_append(o, i - 1) AS o, x.t AS t, x.f AS f FROM ({dates_sql(f'SELECT doc_id, pos, o, t FROM ({r}) WHERE NOT f', 'pos, o')})"
    r = f"{open_} UNION ALL SELECT doc_id, pos, list_append(o, 0) AS o, t, f FROM ({r}) WHERE f"
    return _group_sql(r, T.DEFAULT_CHAIN[2:])


def segments_sql(rel: str) -> str:
    """Tokens with the number of breaks before them over a relation (doc_id, run, i)."""
    return f"""WITH r AS (SELECT *, {_BODY} AS body, {_CORE} AS core, translate({_CORE}, '('')', '-') AS term FROM ({rel})),
b AS (SELECT *, (len(run) > len(body))::INTEGER AS before, (term = '' OR replace(substr(body, len(core) + 1), '''', '') <> '')::INTEGER AS after FROM r),
s AS (SELECT *, sum(before) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(after) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM b)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS pos, term, seg::BIGINT AS seg FROM s WHERE term <> ''"""


def phrases_sql(rel: str) -> str:
    """Phrases of two tokens over a relation (doc_id, pos, term, seg)."""
    return f"""
WITH s AS ({rel}),
k AS (SELECT doc_id, term, count(*) AS k FROM s GROUP BY ALL),
st AS (SELECT doc_id, term FROM (SELECT *, max(k) OVER (PARTITION BY doc_id) AS top, sum(k) OVER (PARTITION BY doc_id) AS n FROM k) WHERE n >= 25 AND k::DOUBLE / top >= 0.2),
a AS (SELECT s.*, st.term IS NOT NULL AS stop FROM s LEFT JOIN st USING (doc_id, term)),
b AS (SELECT *, sum(stop::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS cut, last_value(stop) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM a),
c AS (SELECT *, lag(seg) OVER (PARTITION BY doc_id, cut ORDER BY pos) AS pseg FROM b WHERE NOT stop),
e AS (SELECT *, sum(CASE WHEN pseg <> seg THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, cut ORDER BY pos) AS part FROM c),
f AS (SELECT *, lag(term) OVER w AS pt, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id, cut, part) AS m FROM e WINDOW w AS (PARTITION BY doc_id, cut, part ORDER BY pos)),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p, lead(i) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL AS is_last FROM f WHERE i >= 2 OR m = 1)
SELECT doc_id, p::INTEGER AS pos, CASE WHEN m = 1 THEN term ELSE pt || ' ' || term END AS phrase FROM g WHERE NOT is_last OR fin"""

QUERIES = {
    "tokenize": tokenize, "stream_counts": stream_counts, "tokenize_native": tokenize_native, "token_counts": token_counts, "phrase_segments": phrase_segments,
    **{f"filter_{n}": _filter(n) for n in FILTER_SQL}, "filter_chain": filter_chain, "filter_dates": filter_dates, "chain_tokens": chain_tokens,
    "filter_stopwords": filter_stopwords, "filter_porter": filter_porter, "phrase_terms": phrase_terms,
}

SQL = {
    "tokenize_native": NATIVE,
    "stream_counts": "SELECT doc_id, count(*) AS n_tokens FROM (SELECT DISTINCT doc_id, pos FROM tokens WHERE tok_type IN ('Text', 'Symbol')) GROUP BY doc_id",
    "token_counts": f"SELECT doc_id, count(*) AS n_tokens FROM ({NATIVE}) GROUP BY doc_id",
    "phrase_segments": segments_sql(RUNS),
    **{f"filter_{n}": chain_sql([n]) for n in FILTER_SQL},
    "filter_chain": chain_sql(_PLAIN),
    "filter_dates": _DATES,
    "chain_tokens": f"SELECT doc_id, pos, array_to_string(o, '.') AS sub, t AS term, f AS final FROM ({default_chain_sql(f'SELECT doc_id, pos, term AS t, false AS f FROM ({NATIVE})')})",
    "filter_stopwords": f"""WITH st AS (SELECT regexp_replace(lower(trim(term)), '[''’]', '', 'g') AS term FROM stops)
SELECT doc_id, pos, lower(term) AS term, final FROM ({STREAM}) WHERE final OR lower(term) NOT IN (SELECT term FROM st WHERE term IS NOT NULL)""",
    "filter_porter": stems_sql(f"SELECT DISTINCT lower(term) AS term FROM ({STREAM})"),
    "phrase_terms": phrases_sql(STREAM),
}
