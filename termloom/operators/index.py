"""Inverted indexes as DataFrames: build, statistics, pruning, storage."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from termloom.functions.porter import stem_column
from termloom.functions.tokens import DEFAULT_CHAIN, LEAVE_LETTERS, apply_filters, tok
from termloom.operators.dates import dates
from termloom.operators.phrases import phrases
from termloom.operators.skew import chunked, with_key_stat, without
from termloom.session import written

TYPES = ("single-term", "single-term-positional", "stemmed", "phrase")


@dataclass
class Index:
    """postings(term, doc_id, tf[, positions]) and docs(doc_id, docno, ord, term_count, norm2, max_tf); meta tells how it was built."""

    postings: DataFrame
    docs: DataFrame
    meta: dict = field(default_factory=dict)
    lex: DataFrame | None = None
    counts: tuple[float, float, float] | None = None

    @property
    def positional(self) -> bool:
        return "positions" in self.postings.columns

    def lexicon(self) -> DataFrame:
        return self.lex if self.lex is not None else lexicon(self.postings)

    def stored(self) -> Index:
        """The same index with its tables written to the shared folder and its three totals known: for many queries."""
        p = self.postings if hasattr(self.postings, "_written_to") else written(self.postings, "postings")
        d = written(self.docs, "docs")
        lex = written(lexicon(p), "lexicon")
        n, tokens = d.agg(F.count("*"), F.coalesce(F.sum("term_count"), F.lit(0))).first()
        return Index(p, d, self.meta, lex, (float(n), float(lex.count()), float(tokens)))


def run_chain(tokens: DataFrame, chain: list[str], stopwords: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, sub, term, final): tokens (doc_id, pos, term, seg, final) through a chain of filters.

    Neighbouring filters without state are one expression over a token; dates and phrases are windows over a document.
    `stopwords` (term) and `porter` act on tokens that are not final.
    """
    t = tokens.withColumn("__o", F.array(F.lit(0)))
    group: list[str] = []

    def flush(t: DataFrame) -> DataFrame:
        if not group:
            return t
        out = apply_filters(F.array(tok(F.col("term"), F.col("final"))), list(group))
        if set(group) <= LEAVE_LETTERS:
            same = F.lower("term") if "lower" in group else F.col("term")
            out = F.when(F.col("term").rlike("^[A-Za-z]+$"), F.array(tok(same, F.col("final")))).otherwise(out)
        rest = [c for c in t.columns if c not in ("term", "final", "__o")]
        group.clear()
        t = t.select(*rest, "__o", F.posexplode(out).alias("__s", "__t"))
        return t.select(*rest, F.concat("__o", F.array("__s")).alias("__o"), F.col("__t.text").alias("term"), F.col("__t.final").alias("final"))

    for name in chain:
        if name not in ("dates", "phrases", "stopwords", "porter"):
            group.append(name)
            continue
        t = flush(t)
        if name == "dates":
            seen = t.withColumn("__p", F.struct("pos", "__o"))
            d = dates(seen.select("doc_id", "__p", "term", "final"), pos="__p")
            t = d.select("doc_id", F.col("__p.pos").alias("pos"), F.concat("__p.__o", F.array("sub")).alias("__o"), "term", "final")
        elif name == "phrases":
            return phrases(t).select("doc_id", "pos", F.lit(0).alias("sub"), F.col("phrase").alias("term"), F.lit(True).alias("final"))
        elif name == "stopwords":
            t = without(t, stopwords, "term", unless=F.col("final")).select(*t.columns)
        else:
            open_ = t.filter(~F.col("final") & F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("__n"))
            known = written(open_.withColumn("__stem", stem_column(F.col("term"))), "stems")  # every distinct term once
            done = with_key_stat(t.filter(~F.col("final")), known, "term", "__n").withColumn("term", F.col("__stem")).select(*t.columns)
            t = done.unionByName(t.filter("final")).withColumn("final", F.lit(True))
    t = flush(t)
    return t.select("doc_id", "pos", F.col("__o").alias("sub"), "term", "final")


def chain_of(kind: str, stopwords: bool = False) -> list[str]:
    if kind not in TYPES:
        raise ValueError(f"index type {kind!r} is none of {', '.join(TYPES)}")
    chain = ["phrases"] if kind == "phrase" else DEFAULT_CHAIN + (["porter"] if kind == "stemmed" else [])
    return chain + (["stopwords"] if stopwords else [])


def postings_of(terms: DataFrame, positional: bool = False) -> DataFrame:
    """(term, doc_id, tf[, positions]): positions sorted, repeated ones kept. Counts combine before the shuffle."""
    aggs = [F.count("*").cast("int").alias("tf")]
    if positional:
        aggs.append(F.sort_array(F.collect_list(F.col("pos").cast("int"))).alias("positions"))  # one term of one document
    return terms.groupBy("term", "doc_id").agg(*aggs)


def lexicon(postings: DataFrame) -> DataFrame:
    """(term, tf, df) from what is stored: terms without postings are gone."""
    return postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def document_lengths(postings: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, docno, ord, term_count): the document table without what only depends on the order of insertion."""
    per = postings.groupBy("doc_id").agg(F.sum("tf").alias("term_count"))
    return names.select("doc_id", "docno", "ord").join(per, "doc_id", "left").fillna(0, ["term_count"])


def document_table(postings: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, docno, ord, term_count, max_tf, norm2) for documents (doc_id, docno, ord); names must have a row per document.

    Weights are those at insertion, in the order `ord`: for the i-th document in which the term has its j-th posting,
    tf * ln((i - j + 0.5) / (j + 0.5)). norm2 is the sum of their squares.
    """
    w = online_weights(postings, names)
    per = w.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm2"), F.sum("tf").alias("term_count"), F.max("seen").alias("max_tf"))
    return names.select("doc_id", "docno", "ord").join(per, "doc_id", "left").fillna(0, ["term_count", "max_tf"]).fillna(0.0, ["norm2"])


def online_weights(postings: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, term, tf, weight, seen): document weights frozen at insertion, and the term's occurrences up to then.

    The running count of a term is a window over its postings by `ord`; terms are cut into blocks of `ord` so that no
    window holds a whole common term, and the counts of earlier blocks are added.
    """
    block = F.floor(F.col("ord") / 50_000).cast("long")
    p = postings.select("term", "doc_id", "tf").join(names.select("doc_id", "ord"), "doc_id").withColumn("__b", block)
    blocks = p.groupBy("term", "__b").agg(F.count("*").alias("__n"), F.sum("tf").alias("__t"))
    before = W.partitionBy("term").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("term", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__t0"))
    inside = W.partitionBy("term", "__b").orderBy("ord")
    p = p.withColumn("__j", F.row_number().over(inside)).withColumn("__s", F.sum("tf").over(inside)).join(blocks, ["term", "__b"])
    j = F.col("__j") + F.col("__n0")
    return p.select("doc_id", "term", "tf", (F.col("tf") * F.log((F.col("ord") - j + 0.5) / (j + 0.5))).alias("weight"), (F.col("__s") + F.col("__t0")).alias("seen"))


def build_index(tokens: DataFrame, names: DataFrame, kind: str = "single-term", stopwords: DataFrame | None = None, chain: list[str] | None = None, phrase_len: int = 2, phrase_limit: float = 0.2, norms: bool = True, store: bool = False) -> Index:
    """An index of tokens (doc_id, pos, term, seg, final) and documents (doc_id, docno, ord).

    The four kinds differ in chain and positions; `chain` overrides the chain. Phrase indexes do no other normalising. Without
    `norms` documents have no weights and no greatest tf: enough for all rankers but COSINE. With `store` the postings are
    written first, and all else is made of these.
    """
    chain = chain_of(kind, stopwords is not None) if chain is None else chain
    if chain[:1] == ["phrases"]:
        terms = phrases(tokens, phrase_len, phrase_limit).select("doc_id", "pos", F.col("phrase").alias("term"))
    else:
        terms = run_chain(tokens, chain, stopwords)
    p = postings_of(terms, kind == "single-term-positional")
    p = written(p, "postings") if store else p
    return Index(p, (document_table if norms else document_lengths)(p, names), {"type": kind, "chain": chain, "phrase_len": phrase_len, "phrase_limit": phrase_limit})


def prune_hard(postings: DataFrame, p: int) -> DataFrame:
    """The p documents of each term with the highest tf; equal ones go by doc_id. Each task cuts to p before the shuffle."""
    w = W.partitionBy("term").orderBy(F.desc("tf"), "doc_id")
    return postings.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= p).drop("__r")


def prune_soft(postings: DataFrame, p: float, most: int = 1_000_000) -> DataFrame:
    """Postings with tf of at least mean + p * deviation (of the population) of their term; if none, the highest doc_id.
    Terms with one posting keep it. Where a term has over `most` postings, such terms' figures are broadcast (with_key_stat)."""
    s = postings.groupBy("term").agg(F.avg("tf").alias("__a"), F.stddev_pop("tf").alias("__d"), F.max("tf").alias("__m"), F.max("doc_id").alias("__last"), F.count("*").alias("__n"))
    least = F.col("__a") + F.lit(p) * F.col("__d")
    s = written(s, "figures")
    hot = not s.filter(F.col("__n") > most).isEmpty()
    j = with_key_stat(postings, s, "term", "__n") if hot else postings.join(s, "term")
    keep = (F.col("__n") < 2) | (F.col("tf") >= least) | ((F.col("__m") < least) & (F.col("doc_id") == F.col("__last")))
    return j.filter(keep).select(*postings.columns)


def prune(index: Index, spec: str) -> Index:
    """`none`, `hard <int>` or `soft <float>`; documents keep their counts and norms."""
    what, _, arg = spec.strip().partition(" ")
    if what == "none":
        return index
    if what not in ("hard", "soft"):
        raise ValueError(f"pruning {spec!r} is none of: none, hard <int>, soft <float>")
    p = prune_hard(index.postings, int(arg)) if what == "hard" else prune_soft(index.postings, float(arg))
    return Index(p, index.docs, index.meta | {"pruning": spec})


def save(index: Index, path: str) -> None:
    """Postings in files by ranges of (term, doc_id) and sorted within, so that a reader skips files and row groups and a term of
    every document is spread over several; documents; meta as one JSON row."""
    spark = index.postings.sparkSession
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark.createDataFrame([(json.dumps(index.meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Index:
    meta = spark.read.text(f"{path}/meta").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), json.loads(meta[0]) if meta else {})


def lexicon_report(lex: DataFrame) -> DataFrame:
    """One row: terms, and greatest, least, mean and upper median df. The median comes from counts of each df."""
    per = written(lex.groupBy("df").agg(F.count("*").alias("k")), "df")  # as many rows as there are different df
    block = F.floor(F.log2("df")).cast("int")  # at most 63: sums of blocks, then within each
    sums = per.groupBy(block.alias("__b")).agg(F.sum("k").alias("__k"))
    sums = sums.select("__b", F.coalesce(F.sum("__k").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = W.partitionBy("__b").orderBy("df")
    cum = per.withColumn("__b", block).join(F.broadcast(sums), "__b").withColumn("upto", F.sum("k").over(w) + F.col("__before"))
    s = per.agg(F.sum("k").alias("n_terms"), F.max("df").alias("max_df"), F.min("df").alias("min_df"), (F.sum(F.col("df") * F.col("k")) / F.sum("k")).alias("mean_df"))
    half = F.floor(per.agg(F.sum("k")).scalar() / 2)
    return s.withColumn("median_df", cum.filter(F.col("upto") > half).agg(F.min("df")).scalar())


def dump_postings(postings: DataFrame) -> DataFrame:
    """(value): `term # docid freq` or `term # docid p1 p2 ..`; the last ` # ` parts the two, so terms may hold `#`."""
    rest = F.array_join(F.transform("positions", lambda x: x.cast("string")), " ") if "positions" in postings.columns else F.col("tf").cast("string")
    return postings.select(F.concat("term", F.lit(" # "), F.col("doc_id").cast("string"), F.lit(" "), rest).alias("value"))


def posting_strings(postings: DataFrame, entries: int = 1_000) -> DataFrame:
    """(term, part, list): the posting lists in print, `docid freq` or `docid p1 p2 ..` joined by ` | `, by doc_id. A list of
    over `entries` postings comes in parts of as many, so that no row or task holds all of a common term's."""
    rest = F.array_join(F.transform("positions", lambda x: x.cast("string")), " ") if "positions" in postings.columns else F.col("tf").cast("string")
    one = postings.select("term", "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), rest).alias("__one"))
    cut = chunked(one, ["term"], ["term", "doc_id"], chunk_rows=entries)
    parts = cut.groupBy("term", F.col("chunk").alias("part")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "__one"))).alias("__all"))
    return parts.select("term", "part", F.array_join(F.transform("__all", lambda x: x["__one"]), " | ").alias("list"))


def parse_postings(lines: DataFrame, positional: bool = False) -> DataFrame:
    """postings of dumped lines; lines that don't match are left out."""
    m = lambda i: F.regexp_extract("value", r"^(.*) # (-?[0-9]+) ([0-9 ]+)$", i)
    ok = lines.filter(F.col("value").rlike(r"^.* # -?[0-9]+ [0-9 ]+$"))
    if not positional:
        return ok.select(m(1).alias("term"), m(2).cast("long").alias("doc_id"), m(3).cast("int").alias("tf"))
    pos = F.transform(F.split(m(3), " "), lambda x: x.cast("int"))
    return ok.select(m(1).alias("term"), m(2).cast("long").alias("doc_id"), F.size(pos).alias("tf"), pos.alias("positions"))
