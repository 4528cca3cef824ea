"""Ranking of batches of queries: scores as expressions, gates, thresholds, phrases, fallback."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termloom.operators.index import Index
from termloom.operators.skew import salted_join
from termloom.session import written

K1, K2, B = 1.2, 1.0, 0.75


@dataclass
class Totals:
    """n documents, v distinct terms, as scalar columns of the index."""

    n: Column
    v: Column

    @property
    def avgdl(self) -> Column:
        return self.v / self.n

    @property
    def mu(self) -> Column:
        return F.sqrt(self.avgdl)


def totals(index: Index, avgdl: str = "terms") -> Totals:
    """avgdl: `terms` is distinct terms by documents, `tokens` the mean length."""
    if index.counts:
        n, v, tokens = index.counts
        return Totals(F.lit(n), F.lit(tokens if avgdl == "tokens" else v))
    n = index.docs.agg(F.count("*").cast("double")).scalar()
    v = index.lexicon().agg(F.count("*").cast("double")).scalar()
    if avgdl == "tokens":
        v = index.docs.agg(F.sum("term_count").cast("double")).scalar()
    return Totals(n, v)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


# A ranker gives the share of one (query term, document): columns k (count in the query), tf, df, ctf, term_count.
Ranker = Callable[[Totals], Column]
RANKERS: dict[str, Ranker] = {}


def register_ranker(name: str) -> Callable[[Ranker], Ranker]:
    def put(f: Ranker) -> Ranker:
        RANKERS[name] = f
        return f

    return put


def _bm25(level: Column, t: Totals) -> Column:
    return 2 * level * (K1 + 1) / (level + K1 * ((1 - B) + B * F.col("term_count") / t.avgdl))


@register_ranker("BM25")
def bm25(t: Totals) -> Column:
    return F.col("k") * idf(t.n, F.col("df")) * _bm25(1 + F.log("tf"), t)


@register_ranker("COSINE")
def cosine(t: Totals) -> Column:
    return F.col("k") * F.col("k") * (1 + F.log("tf")) * idf(t.n, F.col("df"))


@register_ranker("LM")
def lm(t: Totals) -> Column:
    return F.col("k") * F.log(1000 * (F.col("tf") + t.mu * F.col("ctf") / t.v) / (F.col("term_count") + t.mu))


def positional_share(engine: str, t: Totals) -> Column:
    """The score of a document with m matched positions (column tf) among df matched documents."""
    level = 1 + F.log("tf")
    if engine == "BM25":
        return idf(t.n, F.col("df")) * _bm25(level, t)
    if engine == "COSINE":
        return level * idf(t.n, F.col("df")) / F.sqrt("norm2")
    return F.log(1000 * (F.col("tf") - t.mu / t.v) / (F.col("term_count") + t.mu))


def threshold_terms(terms: DataFrame, index: Index) -> DataFrame:
    """Query tokens (qid, pos, term, thresh) cut to the share `thresh` of highest idf, where it is below 1.

    Unknown terms come last, equal ones by position; pos is renumbered in that order. Others keep all tokens in order.
    """
    n = totals(index).n
    known = terms.join(index.lexicon().select("term", "df"), "term", "left")
    less = F.coalesce(F.col("thresh"), F.lit(1.0)) < 1
    w = W.partitionBy("qid")
    order = [F.when(less, F.col("df").isNull().cast("int")).otherwise(F.lit(0)), F.when(less, -F.coalesce(idf(n, F.col("df")), F.lit(0.0))).otherwise(F.lit(0.0)), F.col("pos")]
    r = known.withColumn("__i", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    kept = r.filter(~less | ((F.col("__i") - 1) / F.col("__n") < F.col("thresh")))
    return kept.withColumn("pos", F.col("__i")).select(*terms.columns)


def _by_engine(engine: str | None, share: Callable[[str], Column]) -> Column:
    """The share of one engine, or of the one each row names in its column engine."""
    if engine:
        return share(engine)
    out = F.lit(None).cast("double")
    for name in RANKERS:
        out = F.when(F.col("engine") == name, share(name)).otherwise(out)
    return out


def score(terms: DataFrame, index: Index, engine: str | None, force: bool = False, avgdl: str = "terms") -> DataFrame:
    """(qid, doc_id, score) of query tokens (qid, pos, term) on a non-positional index.

    Without an engine or with columns `engine` and `force` in terms, each query has its own. Only postings of query terms
    are read: lexicon and postings join the query's terms by term. Without force a query needs terms whose df sum to 1 %
    of the documents. Documents of which a score can't be computed have no row.
    """
    t = totals(index, avgdl)
    own = [c for c in ("engine", "force") if c in terms.columns]
    q = terms.groupBy("qid", *own, "term").agg(F.count("*").cast("double").alias("k"))
    q = q.join(index.lexicon().select("term", F.col("df").cast("double").alias("df"), F.col("tf").cast("double").alias("ctf")), "term")
    if not force:
        gate = q.groupBy("qid", *own).agg(F.sum(F.col("k") * F.col("df")).alias("__s"), F.sum(F.col("k") ** 3).alias("__q"))
        enough = F.col("__s") >= 0.01 * t.n
        gate = gate.filter(enough | F.col("force") if "force" in own else enough)
    else:
        gate = q.groupBy("qid", *own).agg(F.sum(F.col("k") ** 3).alias("__q"))
    q = q.join(gate.select("qid", "__q"), "qid")
    cosine_ = engine in (None, "COSINE")
    docs = index.docs.select("doc_id", F.col("term_count").cast("double").alias("term_count"), *(["norm2"] if cosine_ else []))
    p = index.postings.select("term", "doc_id", F.col("tf").cast("double").alias("tf"))
    hits = salted_join(p, q, "term", F.col("doc_id"), bound=terms).join(docs, "doc_id")
    by = [c for c in own if c == "engine"]
    norm = [F.first("norm2").alias("norm2"), F.first("__q").alias("__q")] if cosine_ else []
    s = hits.groupBy("qid", *by, "doc_id").agg(F.sum(_by_engine(engine, lambda e: RANKERS[e](t))).alias("score"), *norm)
    size = F.sqrt(F.col("norm2") * F.col("__q"))
    if engine == "COSINE":
        s = s.withColumn("score", F.try_divide(F.col("score"), size))
    elif not engine:
        s = s.withColumn("score", F.when(F.col("engine") == "COSINE", F.try_divide(F.col("score"), size)).otherwise(F.col("score")))
    return s.filter(F.col("score").isNotNull() & ~F.isnan("score")).select("qid", "doc_id", "score")


def filter_sequential(left: DataFrame, right: DataFrame, within: int | Column = 1) -> DataFrame:
    """(.., doc_id, positions): right positions of documents in both that are at most `within` beyond the greatest left one."""
    keys = [c for c in left.columns if c in right.columns and c != "positions"]
    j = left.withColumnRenamed("positions", "__l").join(right, keys)
    most = F.array_max("__l") + within
    j = j.withColumn("positions", F.filter("positions", lambda x: x <= most))
    return j.filter(F.size("positions") > 0).select(*keys, "positions")


def neighbours(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(first, second, doc_id, positions) for pairs of terms (first, second): filter_sequential of the two terms' postings in
    the documents that have both. Which documents have both is found without positions, so only theirs are moved."""
    lean = postings.select("term", "doc_id")
    one = salted_join(lean.withColumnRenamed("term", "first"), pairs, "first", F.col("doc_id"))
    both = one.join(lean.withColumnRenamed("term", "second"), ["second", "doc_id"])
    p = postings.select("term", "doc_id", "positions")
    left = both.join(p.withColumnRenamed("term", "first"), ["first", "doc_id"])
    right = both.join(p.withColumnRenamed("term", "second"), ["second", "doc_id"])
    cols = ["first", "second", "doc_id", "positions"]
    return filter_sequential(left.select(*cols), right.select(*cols))


def match_phrases(terms: DataFrame, index: Index) -> DataFrame:
    """(qid, doc_id, m): documents that hold a query's known terms one after the other, with the positions left at the end.

    A term that the index doesn't know widens the next step by one; those before the first known term don't. Instead of
    a chain of joins per term, the positions of a query's terms are gathered per document and folded in query order, so
    the plan has the same size for all lengths. A document takes part only if it has all known terms.
    """
    w = W.partitionBy("qid").orderBy("pos")
    lex = index.lexicon().select("term", F.lit(True).alias("__k"))
    t = terms.select("qid", "pos", "term").join(lex, "term", "left").withColumn("__i", F.row_number().over(w))
    t = t.filter("__k").withColumn("__before", F.lag("__i").over(w)).withColumn("within", F.col("__i") - F.coalesce("__before", F.col("__i") - 1))
    t = written(t.select("qid", "pos", "term", "within", F.count("*").over(W.partitionBy("qid")).alias("__need")), "steps")
    # documents with all terms of a query first, without positions; only theirs are gathered
    p = index.postings.select("term", "doc_id")
    all_ = salted_join(p, t.select("term", "qid", "__need"), "term", F.col("doc_id")).groupBy("qid", "doc_id").agg(F.count("*").alias("__n"), F.first("__need").alias("__need"))
    all_ = all_.filter(F.col("__n") == F.col("__need")).select("qid", "doc_id")
    wanted = all_.join(t.drop("__need"), "qid")
    asked = salted_join(index.postings.select("term", "doc_id", "positions"), t.select("term").distinct(), "term", F.col("doc_id"), bound=t)
    hits = wanted.join(asked, ["term", "doc_id"])
    hits = hits.groupBy("qid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "within", "positions"))).alias("g"))  # one entry per query token

    def step(acc: Column, x: Column) -> Column:
        most = F.array_max(acc) + x["within"]
        return F.filter(x["positions"], lambda y: y <= most)

    first = F.get("g", F.lit(0))["positions"]
    left = F.aggregate(F.slice("g", F.lit(2), F.greatest(F.size("g") - 1, F.lit(0))), first, step)
    return hits.select("qid", "doc_id", F.size(left).alias("m")).filter("m > 0")


def score_positional(terms: DataFrame, index: Index, engine: str | None, force: bool = False, avgdl: str = "terms") -> DataFrame:
    """(qid, doc_id, score) by matched phrases; without force 1 % of the documents (rounded down) must match. Columns
    `engine` and `force` of terms work as in score."""
    t = totals(index, avgdl)
    own = [c for c in ("engine", "force") if c in terms.columns]
    m = match_phrases(terms, index)
    per = m.groupBy("qid").agg(F.count("*").cast("double").alias("df"))
    if own:
        per = per.join(terms.select("qid", *own).distinct(), "qid")
    if not force:
        enough = F.col("df") >= F.floor(0.01 * t.n)
        per = per.filter(enough | F.col("force") if "force" in own else enough)
    norm = [F.expr("nullif(norm2, 0D)").alias("norm2")] if engine in (None, "COSINE") else []
    docs = index.docs.select("doc_id", F.col("term_count").cast("double").alias("term_count"), *norm)
    hits = m.select("qid", "doc_id", F.col("m").cast("double").alias("tf")).join(per, "qid").join(docs, "doc_id")
    return hits.withColumn("score", _by_engine(engine, lambda e: positional_share(e, t))).filter(F.col("score").isNotNull() & ~F.isnan("score")).select("qid", "doc_id", "score")


def rank(scored: DataFrame, limit: int | None = 100) -> DataFrame:
    """rank from 0 by score, equal scores by doc_id; each task cuts to `limit` before the shuffle."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    r = scored.withColumn("rank", F.row_number().over(w))
    return (r.filter(F.col("rank") <= limit) if limit else r).withColumn("rank", F.col("rank") - 1)


def distinct_queries(terms: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """The tokens of one query among those that ask an index the same, and (qid, __as): whose tokens stand for those of qid.

    Queries ask the same if their known terms are the same as often, on a positional index in the same order with as many
    unknown ones between, and `engine` and `force` are, where terms have them. Those without a known term have no answer
    and are in neither.
    """
    own = [c for c in ("engine", "force") if c in terms.columns]
    known = index.lexicon().select("term", F.lit(True).alias("__k"))
    if index.positional:
        t = terms.withColumn("__i", F.row_number().over(W.partitionBy("qid").orderBy("pos"))).join(known, "term")
        t = t.withColumn("__i", F.col("__i") - F.min("__i").over(W.partitionBy("qid")))
        key = F.struct("__i", "term")
    else:
        t, key = terms.join(known, "term"), F.col("term")
    t = t.groupBy("qid", *own).agg(F.sort_array(F.collect_list(key)).alias("__asked"))
    same = written(t.select("qid", F.min("qid").over(W.partitionBy("__asked", *own)).alias("__as")), "same")
    return terms.join(same.filter(F.col("qid") == F.col("__as")).select("qid"), "qid", "left_semi"), same


def best(terms: DataFrame, index: Index, engine: str | None, limit: int | None = 100, digits: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the best documents of each query by score or score_positional, rounded to `digits` before
    they are ranked. Queries that ask the same are answered once, and their `limit` documents repeated for each."""
    asked, same = distinct_queries(terms, index)
    s = (score_positional if index.positional else score)(asked, index, engine)
    if digits is not None:
        s = s.withColumn("score", F.round("score", digits))
    r = rank(s, limit).withColumnRenamed("qid", "__as")
    return same.join(r, "__as").select("qid", "doc_id", "score", "rank")


def extend_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left and those rows of right whose keys left doesn't have; repeated rows of right stay."""
    return left.unionByName(right.join(left.select(*keys).distinct(), keys, "left_anti").select(*left.columns))


def fall_back(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (qid, source, ..) of each query's first preferred source that has any.

    queries: (qid, index_pref), a comma-separated list; names nobody answers for are passed over, as are blanks.
    """
    pref = queries.select("qid", F.posexplode(F.split("index_pref", ",")).alias("__p", "source")).withColumn("source", F.trim("source"))
    pref = pref.groupBy("qid", "source").agg(F.min("__p").alias("__p"))
    some = answers.select("qid", "source").distinct().join(pref, ["qid", "source"])
    first = some.groupBy("qid").agg(F.min(F.struct("__p", "source")).alias("__b")).select("qid", F.col("__b.source").alias("source"))
    return answers.join(first, ["qid", "source"], "left_semi")


def term_stats(terms: DataFrame, index: Index) -> DataFrame:
    """(term, idf, df, tf, error) of texts looked up as they are, without filters."""
    n = totals(index).n
    t = terms.select("term").distinct().join(index.lexicon(), "term", "left")
    return t.select("term", idf(n, F.col("df")).alias("idf"), "df", "tf", F.when(F.col("df").isNull(), "unknown term").alias("error"))
