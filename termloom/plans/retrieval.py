"""Queries on indexes and ranking over the indexed collection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from termloom.functions.tokens import RUN, native_tokens
from termloom.operators import index as I, rank as R
from termloom.operators.search import search as search_all
from termloom.plans.stems import stems_sql
from termloom.plans.text import _CORE, SQL as _TEXT, STREAM, default_chain_sql, phrases_sql, segments_sql, stop_words, stream
from termloom.session import table, written
from termloom.sources.trec import run_lines


def names(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, docno, ord): one row per document of the map; docno trimmed and in upper case."""
    return table(spark, d, "docs").groupBy("doc_id").agg(F.max(F.upper(F.trim("docno"))).alias("docno"), F.min("ord").alias("ord"))


def base_index(spark: SparkSession, d: str, positional: bool = False, norms: bool = True, chain: tuple[str, ...] | None = ("lower",), store: bool = False) -> I.Index:
    """The stream in lower case, or by another chain (None: the default one)."""
    kind = "single-term-positional" if positional else "single-term"
    return I.build_index(stream(spark, d, together=store), names(spark, d), kind, chain=list(chain) if chain else None, norms=norms, store=store)


def topics(spark: SparkSession, d: str) -> DataFrame:
    """(qid, pos, term, thresh): words of the topics in lower case."""
    t = table(spark, d, "topics").select(F.trim("qid").alias("qid"), "text", "query_thresh")
    w = native_tokens(t, "qid").withColumn("term", F.lower("term"))
    return w.join(t.select("qid", F.col("query_thresh").alias("thresh")), "qid")


_NAMES = "SELECT doc_id, max(upper(trim(docno))) AS docno, min(ord) AS ord FROM docs GROUP BY doc_id"
_POST = f"SELECT lower(term) AS term, doc_id, count(*)::INTEGER AS tf, list_sort(list(pos)) AS positions FROM ({STREAM}) GROUP BY ALL"


def with_sql(post: str, qt: str, topics: str = "SELECT trim(qid) AS qid, query_thresh AS thresh, text FROM topics") -> str:
    """Postings p, lexicon lex, documents d, totals tot and query tokens qt of an index; qn are the topics' words as they are."""
    return f"""WITH p AS ({post}), names AS ({_NAMES}), lex AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM p GROUP BY term),
o AS (SELECT p.term, p.doc_id, p.tf, row_number() OVER (PARTITION BY p.term ORDER BY ord) AS j, ord AS i, sum(tf) OVER (PARTITION BY p.term ORDER BY ord) AS seen FROM p JOIN names USING (doc_id)),
w AS (SELECT *, tf * ln((i - j + 0.5) / (j + 0.5)) AS weight FROM o),
d AS (SELECT n.doc_id, n.docno, n.ord, coalesce(sum(tf), 0)::BIGINT AS term_count, coalesce(max(seen), 0)::BIGINT AS max_tf, coalesce(sum(weight * weight), 0.0) AS norm2 FROM names n LEFT JOIN w USING (doc_id) GROUP BY ALL),
tot AS (SELECT (SELECT count(*) FROM names)::DOUBLE AS n, (SELECT count(*) FROM lex)::DOUBLE AS v),
q AS (SELECT * FROM ({topics}) WHERE text IS NOT NULL),
qr AS (SELECT qid, thresh, unnest(l) AS run, generate_subscripts(l, 1) AS i FROM (SELECT qid, thresh, regexp_extract_all(text, '{RUN}') AS l FROM q)),
qn AS (SELECT qid, thresh, row_number() OVER (PARTITION BY qid ORDER BY i)::INTEGER AS pos, t AS term FROM (SELECT *, translate({_CORE}, '('')', '-') AS t FROM qr) WHERE t <> ''),
qt AS ({qt})
"""


_WITH = with_sql(_POST, "SELECT qid, thresh, pos, lower(term) AS term FROM qn")


def _counted(rel: str) -> str:
    """Postings of a relation (doc_id, pos, t)."""
    return f"SELECT t AS term, doc_id, count(*)::INTEGER AS tf, list_sort(list(pos)) AS positions FROM ({rel}) GROUP BY ALL"


def _stemmed(rel: str) -> str:
    """The open tokens of a chain's outcome (doc_id, pos, o, t, f) become their stems."""
    return f"SELECT doc_id, pos, o, CASE WHEN f THEN t ELSE coalesce(stem, t) END AS t FROM ({rel}) LEFT JOIN ({stems_sql(f'SELECT DISTINCT t AS term FROM ({rel})')}) st ON st.term = t"


_CHAIN = default_chain_sql(f"SELECT doc_id, pos, term AS t, final AS f FROM ({STREAM})")
_QCHAIN = default_chain_sql("SELECT qid AS doc_id, pos, term AS t, false AS f FROM qn")


def _asked(rel: str) -> str:
    """Query tokens of a relation (doc_id, pos, o, t)."""
    return f"SELECT q.qid, q.thresh, row_number() OVER (PARTITION BY q.qid ORDER BY pos, o)::INTEGER AS pos, t AS term FROM ({rel}) c JOIN q ON q.qid = c.doc_id"


_QPHRASES = phrases_sql(f"SELECT * FROM ({segments_sql('SELECT qid AS doc_id, run, i FROM qr')})")
#: Postings and query tokens by the kind of index.
KINDS = {
    "single": (_counted(_CHAIN), _asked(_QCHAIN)), "positional": (_counted(_CHAIN), _asked(_QCHAIN)), "stem": (_counted(_stemmed(_CHAIN)), _asked(_stemmed(_QCHAIN))),
    "phrase": (f"SELECT phrase AS term, doc_id, count(*)::INTEGER AS tf, list_sort(list(pos)) AS positions FROM ({_TEXT['phrase_terms']}) GROUP BY ALL", _asked(f"SELECT doc_id, pos, 0 AS o, phrase AS t FROM ({_QPHRASES})")),
}


def postings_basic(spark: SparkSession, d: str) -> DataFrame:
    return base_index(spark, d).postings


def postings_positional(spark: SparkSession, d: str) -> DataFrame:
    return base_index(spark, d, True).postings.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), " "))


def lexicon_stats(spark: SparkSession, d: str) -> DataFrame:
    return base_index(spark, d).lexicon()


def lexicon_report(spark: SparkSession, d: str) -> DataFrame:
    return I.lexicon_report(base_index(spark, d).lexicon()).withColumn("mean_df", F.round("mean_df", 6))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return base_index(spark, d).docs.withColumn("norm2", F.round("norm2", 4))


def doc_weights_online(spark: SparkSession, d: str) -> DataFrame:
    p = base_index(spark, d).postings
    return I.online_weights(p, names(spark, d)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def prune_hard(spark: SparkSession, d: str) -> DataFrame:
    return I.prune(base_index(spark, d), "hard 10").postings


def prune_soft(spark: SparkSession, d: str) -> DataFrame:
    return I.prune(base_index(spark, d), "soft 1.5").postings


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Words of the topics as they are, without filters."""
    t = table(spark, d, "topics").select(F.trim("qid").alias("qid"), "text")
    s = R.term_stats(native_tokens(t, "qid"), base_index(spark, d))
    return s.select("term", F.round("idf", 6).alias("idf"), "df", "tf", "error")


def positional_filter(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive terms of all topics, and neighbours that stand together in 1 % of the documents: the positions of the second
    that are at most one beyond the last of the first, in every document that has both. (Few topics have two known terms.)"""
    p = written(base_index(spark, d, True).postings, "postings")
    w = W.partitionBy("qid").orderBy("pos")
    pairs = topics(spark, d).select(F.col("term").alias("first"), F.lead("term").over(w).alias("second")).filter(F.col("second").isNotNull()).distinct()
    w = W.partitionBy("doc_id").orderBy("pos")
    t = stream(spark, d).select("doc_id", "pos", F.lower("term").alias("first"))
    t = t.withColumn("second", F.lead("first").over(w)).withColumn("__p", F.lead("pos").over(w)).filter(F.col("__p") == F.col("pos") + 1)
    n = names(spark, d).agg(F.count("*")).scalar()
    often = t.groupBy("first", "second").agg(F.count_distinct("doc_id").alias("k")).filter(F.col("k") >= 0.01 * n).select("first", "second")
    out = R.neighbours(p, written(pairs.unionByName(often).distinct(), "pairs"))
    return out.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), " "))


def _top(t: DataFrame, i: I.Index, engine: str) -> DataFrame:
    """The client's 100 best; scores are rounded before ranking, as sums differ in their last places."""
    return R.best(t, i, engine, 100, 9)


def _rank(engine: str, positional: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        i, t = base_index(spark, d, positional, norms=engine == "COSINE", store=True), topics(spark, d)
        return _top(t, i, engine)

    return run


def query_threshold(spark: SparkSession, d: str) -> DataFrame:
    return R.threshold_terms(topics(spark, d), base_index(spark, d)).select("qid", "pos", "term")


def gate(spark: SparkSession, d: str) -> DataFrame:
    """Queries that have enough documents for their words."""
    i = base_index(spark, d)
    n = i.docs.agg(F.count("*").cast("double")).scalar()
    t = topics(spark, d).join(i.lexicon().select("term", "df"), "term").groupBy("qid").agg(F.sum("df").alias("sum_df"))
    return t.filter(F.col("sum_df") >= 0.01 * n)


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id, docno, score, source) of the given results: one row per query, document and source."""
    r = table(spark, d, "results").filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return r.groupBy(F.rtrim("qid").alias("qid"), "doc_id", "source").agg(F.max("score").alias("score"), F.max(F.upper(F.trim("docno"))).alias("docno"))


def extend_unique(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    return R.extend_unique(a.filter("source = 'single'"), a.filter("source = 'positional'"), ["qid", "doc_id"]).select("qid", "doc_id", "source", "score")


def fallback(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "topics").select(F.trim("qid").alias("qid"), "index_pref")
    return R.fall_back(q, answers(spark, d)).select("qid", "source", "doc_id", "score")


def topk_run(spark: SparkSession, d: str) -> DataFrame:
    """Run file lines of the 100 best answers of each query by the source it falls back to."""
    q = table(spark, d, "topics").select(F.trim("qid").alias("qid"), "index_pref")
    a = R.fall_back(q, answers(spark, d)).filter(F.col("docno").isNotNull())
    return run_lines(R.rank(a, 100))


def search(spark: SparkSession, d: str) -> DataFrame:
    """All topics on four indexes with their own engine, threshold, force and preferences."""
    t, n = stream(spark, d), names(spark, d)
    kinds = {"single": "single-term", "positional": "single-term-positional", "stem": "stemmed", "phrase": "phrase"}
    t, n = written(t, "stream").repartition("doc_id"), written(n, "names")
    built = {k: I.build_index(t, n, v, store=True).stored() for k, v in kinds.items() if k != "single"}
    p = built["positional"]  # of the same chain, so all but the positions is the same
    built["single"] = I.Index(p.postings.drop("positions"), p.docs, p.meta | {"type": kinds["single"]}, p.lex, p.counts)
    return search_all(table(spark, d, "topics"), built, digits=9)


def postings_default(spark: SparkSession, d: str) -> DataFrame:
    """The single-term index by the default chain."""
    return base_index(spark, d, chain=None).postings


def postings_default_positional(spark: SparkSession, d: str) -> DataFrame:
    """The positional index by the default chain."""
    return base_index(spark, d, True, chain=None).postings.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), " "))


def _rank_default(engine: str, positional: bool):
    """Topics through the chain of the index."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        i = base_index(spark, d, positional, norms=engine == "COSINE", chain=None, store=True)
        t = native_tokens(table(spark, d, "topics").select(F.trim("qid").alias("doc_id"), "text"))
        t = I.run_chain(t.select("doc_id", "pos", "term", F.lit(0).cast("long").alias("seg"), F.lit(False).alias("final")), I.chain_of("single-term"))
        t = t.select(F.col("doc_id").alias("qid"), F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "sub")).alias("pos"), "term")
        return _top(t, i, engine)

    return run


def stemmed_postings(spark: SparkSession, d: str) -> DataFrame:
    return I.build_index(stream(spark, d), names(spark, d), "stemmed").postings


def phrase_postings(spark: SparkSession, d: str) -> DataFrame:
    return I.build_index(stream(spark, d), names(spark, d), "phrase").postings


def stopped_postings(spark: SparkSession, d: str) -> DataFrame:
    return I.build_index(stream(spark, d), names(spark, d), "single-term", stopwords=stop_words(spark, d)).postings


_HITS = "h AS (SELECT k.qid, k.k, p.doc_id, p.tf::DOUBLE AS tf, k.df, k.ctf, d.term_count::DOUBLE AS dl, d.norm2 FROM k JOIN p USING (term) JOIN d USING (doc_id)),\n"
_K = """, k0 AS (SELECT qid, term, count(*)::DOUBLE AS k, any_value(lex.df)::DOUBLE AS df, any_value(lex.tf)::DOUBLE AS ctf FROM qt JOIN lex USING (term) GROUP BY qid, term),
k AS (SELECT * FROM k0 WHERE qid IN (SELECT qid FROM k0 GROUP BY qid HAVING sum(k * df) >= 0.01 * (SELECT n FROM tot))),
"""
_IDF = "ln((n - df + 0.5) / (df + 0.5))"
_TOP = "SELECT qid, doc_id, score, (r - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM s WHERE score IS NOT NULL AND NOT isnan(score)) WHERE r <= 100"
_LEVEL = "2 * L * 2.2 / (L + 1.2 * (0.25 + 0.75 * dl / (v / n)))"
_SCORES = {
    "BM25": "sum(k * " + _IDF + " * " + _LEVEL.replace("L", "(1 + ln(tf))") + ")",
    "COSINE": "sum(k * k * (1 + ln(tf)) * " + _IDF + ") / sqrt(any_value(norm2) * any_value((SELECT sum(k * k * k) FROM k WHERE k.qid = h.qid)))",
    "LM": "sum(k * ln(1000 * (tf + sqrt(v / n) * ctf / v) / (dl + sqrt(v / n))))",
}
_FOLD = """, known AS (SELECT qid, pos, term, row_number() OVER (PARTITION BY qid ORDER BY pos) AS i, term IN (SELECT term FROM lex) AS ok FROM qt),
st AS (SELECT qid, term, i, row_number() OVER (PARTITION BY qid ORDER BY i) AS step, i - coalesce(lag(i) OVER (PARTITION BY qid ORDER BY i), i - 1) AS within, count(*) OVER (PARTITION BY qid) AS need FROM known WHERE ok),
hit AS (SELECT qid, doc_id, list({'w': within, 'p': positions} ORDER BY step) AS g FROM st JOIN p USING (term) GROUP BY qid, doc_id HAVING count(*) = any_value(need)),
m AS (SELECT qid, doc_id, len(list_reduce(list_transform(g, lambda x: x), lambda a, x: {'w': x.w, 'p': list_filter(x.p, lambda y: y <= list_max(a.p) + x.w)}).p)::DOUBLE AS tf FROM hit),
mm AS (SELECT *, count(*) OVER (PARTITION BY qid)::DOUBLE AS df FROM m WHERE tf > 0),
h AS (SELECT mm.*, d.term_count::DOUBLE AS dl, nullif(d.norm2, 0) AS norm2, tot.* FROM mm JOIN d USING (doc_id), tot WHERE df >= floor(0.01 * n)),
"""
_POS = {
    "BM25": _IDF + " * " + _LEVEL.replace("L", "(1 + ln(tf))"),
    "COSINE": "(1 + ln(tf)) * " + _IDF + " / sqrt(norm2)",
    "LM": "CASE WHEN tf - sqrt(v / n) / v > 0 THEN ln(1000 * (tf - sqrt(v / n) / v) / (dl + sqrt(v / n))) END",
}
#: Queries of all engines in one statement: each has its own, and is forced or not.
_THRESH = """, x AS (SELECT qt.*, df, coalesce(thresh, 1.0) < 1 AS less FROM qt LEFT JOIN lex USING (term)),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN less THEN (df IS NULL)::INTEGER ELSE 0 END, CASE WHEN less THEN -coalesce(ln(((SELECT n FROM tot) - df + 0.5) / (df + 0.5)), 0.0) ELSE 0.0 END, pos) AS i, count(*) OVER (PARTITION BY qid) AS c FROM x),
asked AS (SELECT qid, i::INTEGER AS pos, term FROM y WHERE NOT less OR (i - 1)::DOUBLE / c < thresh)"""


def _each(scores: dict[str, str]) -> str:
    return "CASE engine " + " ".join(f"WHEN '{e}' THEN {x}" for e, x in scores.items()) + " END"


def answers_sql(tag: str) -> str:
    """(qid, doc_id, docno, score, source) of the queries that prefer an index."""
    post, qt = KINDS[tag]
    mine = f"""SELECT qid, thresh, text, engine, force OR last = '{tag}' AS force FROM (SELECT rtrim(qid) AS qid, query_thresh AS thresh, text, upper(engine) AS engine, coalesce(force, false) AS force, prefs, prefs[-1] AS last
FROM (SELECT *, list_filter(list_transform(string_split(index_pref, ','), lambda x: trim(x)), lambda x: x <> '') AS prefs FROM topics)) WHERE list_contains(prefs, '{tag}')"""
    if tag == "positional":
        rest = _FOLD.replace("FROM qt)", "FROM asked)").replace("JOIN d USING (doc_id), tot WHERE df >= floor(0.01 * n)", "JOIN d USING (doc_id) JOIN q USING (qid), tot WHERE df >= floor(0.01 * n) OR q.force").replace("SELECT mm.*,", "SELECT mm.*, q.engine,")
        s = f"s AS (SELECT qid, doc_id, round({_each(_POS)}, 9) AS score FROM h)"
    else:
        rest = _K.replace("FROM qt JOIN", "FROM asked JOIN").replace("GROUP BY qid HAVING sum(k * df) >= 0.01 * (SELECT n FROM tot)", "GROUP BY qid HAVING sum(k * df) >= 0.01 * (SELECT n FROM tot) OR qid IN (SELECT qid FROM q WHERE force)")
        s = f"{_HITS}s AS (SELECT qid, doc_id, round({_each(_SCORES)}, 9) AS score FROM h JOIN q USING (qid), tot GROUP BY qid, doc_id, engine)"
    return f"{with_sql(post, qt, mine)}{_THRESH}{rest}{s} SELECT s.qid, s.doc_id, d.docno, s.score, '{tag}' AS source FROM s JOIN d USING (doc_id) WHERE score IS NOT NULL AND NOT isnan(score)"


_ANS = "a AS (SELECT rtrim(qid) AS qid, doc_id, source, max(score) AS score, max(upper(trim(docno))) AS docno FROM results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"
_BEST = """pr0 AS (SELECT trim(qid) AS qid, unnest(string_split(index_pref, ',')) AS source, generate_subscripts(string_split(index_pref, ','), 1) AS i FROM topics),
pr AS (SELECT qid, trim(source) AS source, min(i) AS i FROM pr0 GROUP BY ALL),
best AS (SELECT qid, arg_min(source, i) AS source FROM pr SEMI JOIN a USING (qid, source) GROUP BY qid),
f AS (SELECT a.* FROM a SEMI JOIN best USING (qid, source))
"""
_FALL = f"WITH {_ANS}, {_BEST}"

QUERIES = {
    "postings_basic": postings_basic, "postings_positional": postings_positional, "lexicon_stats": lexicon_stats, "lexicon_report": lexicon_report, "doc_stats": doc_stats, "doc_weights_online": doc_weights_online,
    "prune_hard": prune_hard, "prune_soft": prune_soft, "term_stats": term_stats, "positional_filter": positional_filter,
    **{f"rank_{e.lower()}": _rank(e, False) for e in R.RANKERS}, **{f"rank_{e.lower()}_pos": _rank(e, True) for e in R.RANKERS},
    "query_threshold": query_threshold, "gate": gate, "extend_unique": extend_unique, "fallback": fallback, "topk_run": topk_run, "search": search,
    "postings_default": postings_default, "postings_default_positional": postings_default_positional,
    **{f"rank_{e.lower()}_default": _rank_default(e, False) for e in R.RANKERS}, **{f"rank_{e.lower()}_pos_default": _rank_default(e, True) for e in R.RANKERS},
    "stemmed_postings": stemmed_postings, "phrase_postings": phrase_postings, "stopped_postings": stopped_postings,
}

SQL = {
    "postings_basic": f"SELECT term, doc_id, tf FROM ({_POST})",
    "postings_positional": f"SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM ({_POST})",
    "lexicon_stats": f"{_WITH} SELECT * FROM lex",
    "lexicon_report": f"{_WITH} SELECT count(*) AS n_terms, max(df) AS max_df, min(df) AS min_df, round(avg(df), 6) AS mean_df, list_sort(list(df))[count(*) // 2 + 1] AS median_df FROM lex",
    "doc_stats": f"{_WITH} SELECT doc_id, docno, ord, term_count, max_tf, round(norm2, 4) AS norm2 FROM d",
    "doc_weights_online": f"{_WITH} SELECT doc_id, term, round(weight, 6) AS weight FROM w",
    "prune_hard": f"SELECT term, doc_id, tf FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id) AS r FROM ({_POST})) WHERE r <= 10",
    "prune_soft": f"""WITH s AS (SELECT *, avg(tf) OVER w + 1.5 * stddev_pop(tf) OVER w AS least, max(tf) OVER w AS top, max(doc_id) OVER w AS last, count(*) OVER w AS n FROM ({_POST}) WINDOW w AS (PARTITION BY term))
SELECT term, doc_id, tf FROM s WHERE n < 2 OR tf >= least OR (top < least AND doc_id = last)""",
    "term_stats": f"{_WITH}, words AS (SELECT DISTINCT t AS term FROM (SELECT translate({_CORE}, '('')', '-') AS t FROM qr) WHERE t <> '') SELECT words.term, round(ln((tot.n - df + 0.5) / (df + 0.5)), 6) AS idf, df, tf, CASE WHEN df IS NULL THEN 'unknown term' END AS error FROM words LEFT JOIN lex USING (term), tot",
    "positional_filter": f"""{_WITH}, nb AS (SELECT doc_id, pos, lower(term) AS first, lead(lower(term)) OVER w AS second, lead(pos) OVER w AS np FROM ({STREAM}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
pairs AS (SELECT first, second FROM (SELECT term AS first, lead(term) OVER (PARTITION BY qid ORDER BY pos) AS second FROM qt) WHERE second IS NOT NULL
  UNION SELECT first, second FROM nb WHERE np = pos + 1 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 0.01 * (SELECT n FROM tot)),
x AS (SELECT first, second, l.doc_id, list_filter(r.positions, lambda y: y <= list_max(l.positions) + 1) AS positions FROM pairs JOIN p l ON l.term = first JOIN p r ON r.term = second AND r.doc_id = l.doc_id)
SELECT first, second, doc_id, array_to_string(positions, ' ') AS positions FROM x WHERE len(positions) > 0""",
    **{f"rank_{e.lower()}": f"{_WITH}{_K}{_HITS}s AS (SELECT qid, doc_id, round({x}, 9) AS score FROM h, tot GROUP BY qid, doc_id) {_TOP}" for e, x in _SCORES.items()},
    **{f"rank_{e.lower()}_pos": f"{_WITH}{_FOLD}s AS (SELECT qid, doc_id, round({x}, 9) AS score FROM h) {_TOP}" for e, x in _POS.items()},
    **{f"rank_{e.lower()}_default": f"{with_sql(*KINDS['single'])}{_K}{_HITS}s AS (SELECT qid, doc_id, round({x}, 9) AS score FROM h, tot GROUP BY qid, doc_id) {_TOP}" for e, x in _SCORES.items()},
    **{f"rank_{e.lower()}_pos_default": f"{with_sql(*KINDS['positional'])}{_FOLD}s AS (SELECT qid, doc_id, round({x}, 9) AS score FROM h) {_TOP}" for e, x in _POS.items()},
    "postings_default": f"SELECT term, doc_id, tf FROM ({KINDS['single'][0]})",
    "postings_default_positional": f"SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM ({KINDS['positional'][0]})",
    "stemmed_postings": f"SELECT term, doc_id, tf FROM ({KINDS['stem'][0]})",
    "search": f"""WITH a AS ({' UNION ALL '.join(f'SELECT * FROM ({answers_sql(tag)})' for tag in KINDS)}), {_BEST}
SELECT qid, doc_id, docno, (r - 1)::INTEGER AS rank, score, source FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM f) WHERE r <= 100""",
    "query_threshold": f"""{_WITH}, x AS (SELECT qt.*, df, coalesce(thresh, 1.0) < 1 AS less FROM qt LEFT JOIN lex USING (term)),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN less THEN (df IS NULL)::INTEGER ELSE 0 END, CASE WHEN less THEN -coalesce(ln(((SELECT n FROM tot) - df + 0.5) / (df + 0.5)), 0.0) ELSE 0.0 END, pos) AS i, count(*) OVER (PARTITION BY qid) AS c FROM x)
SELECT qid, i::INTEGER AS pos, term FROM y WHERE NOT less OR (i - 1)::DOUBLE / c < thresh""",
    "phrase_postings": f"SELECT phrase AS term, doc_id, count(*)::INTEGER AS tf FROM ({_TEXT['phrase_terms']}) GROUP BY ALL",
    "stopped_postings": f"""WITH c AS ({default_chain_sql(f'SELECT doc_id, pos, term AS t, final AS f FROM ({STREAM})')}), st AS (SELECT regexp_replace(lower(trim(term)), '[\'\'’]', '', 'g') AS term FROM stops WHERE term IS NOT NULL)
SELECT t AS term, doc_id, count(*)::INTEGER AS tf FROM c WHERE f OR t NOT IN (SELECT term FROM st) GROUP BY ALL""",
    "gate": f"{_WITH} SELECT qid, sum(df)::BIGINT AS sum_df FROM qt JOIN lex USING (term) GROUP BY qid HAVING sum(df) >= 0.01 * (SELECT n FROM tot)",
    "extend_unique": f"WITH {_ANS} SELECT qid, doc_id, source, score FROM a WHERE source = 'single' UNION ALL SELECT qid, doc_id, source, score FROM a ANTI JOIN (SELECT qid, doc_id FROM a WHERE source = 'single') USING (qid, doc_id) WHERE source = 'positional'",
    "fallback": f"{_FALL} SELECT qid, source, doc_id, score FROM f",
    "topk_run": f"{_FALL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM f WHERE docno IS NOT NULL) SELECT concat_ws(' ', qid, 'Q0', docno, rank, printf('%.6f', score), source) AS value FROM r WHERE rank < 100",
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of every topic by BM25."""
    return R.rank(R.score(topics(spark, d), base_index(spark, d), "BM25"), 10).join(names(spark, d).select("doc_id", "docno"), "doc_id")
