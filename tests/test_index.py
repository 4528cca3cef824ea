import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import tokens as T
from termloom.functions.tokens import native_tokens
from termloom.operators import index as I, rank as R, search as S
from termloom.operators.search import search
from termloom.sources import messages, trec


@pytest.fixture(scope="module")
def golden(spark):
    docs = spark.createDataFrame(
        [(2, "Since I was a young boy; I played the silver ball."), (3, "Since Ph.D's don't fly F-16 jets, but they might work for the CDC on the CDC-50 project")], "doc_id long, text string"
    )
    t = native_tokens(docs).select("doc_id", "pos", "term", F.lit(0).cast("long").alias("seg"), F.lit(False).alias("final"))
    names = spark.createDataFrame([(2, "A02", 1), (3, "A03", 2)], "doc_id long, docno string, ord long")
    return I.build_index(t, names, "single-term-positional", chain=["acronyms", "hyphens", "lower"])


def test_golden_index(golden):
    p = {(r.term, r.doc_id): r.positions for r in golden.postings.collect()}
    assert golden.lexicon().count() == 24
    assert p["cdc", 3] == [13, 16] and p["cdc50", 3] == [16] and p["the", 3] == [12, 15] and p["the", 2] == [9]
    s = {r.term: r for r in R.term_stats(golden.lexicon().select("term"), golden).collect()}
    assert s["since"].tf == 2 and s["since"].idf == pytest.approx(math.log(0.5 / 2.5)) and s["jets"].idf == pytest.approx(0)
    report = I.lexicon_report(golden.lexicon()).first()
    assert (report.n_terms, report.max_df, report.min_df, report.median_df) == (24, 2, 1, 1)


def test_sequential_filter(golden):
    of = lambda t: golden.postings.filter(F.col("term") == t).select("doc_id", "positions")
    run = lambda a, b, w: {r.doc_id: r.positions for r in R.filter_sequential(of(a), of(b), w).collect()}
    assert run("the", "cdc", 1) == {3: [13, 16]}
    assert run("cdc", "project", 1) == {3: [17]}
    assert run("since", "the", 12) == {3: [12], 2: [9]}


def test_phrase_match_against_fold(spark, golden):
    t = spark.createDataFrame([("q", 1, "the"), ("q", 2, "unknown"), ("q", 3, "cdc"), ("q", 4, "project"), ("r", 1, "zzz"), ("r", 2, "silver"), ("r", 3, "ball")], "qid string, pos int, term string")
    assert {(r.qid, r.doc_id, r.m) for r in R.match_phrases(t, golden).collect()} == {("q", 3, 1), ("r", 2, 1)}


def test_online_weights(spark):
    p = spark.createDataFrame([("x", 1, 2), ("x", 2, 1), ("y", 2, 3)], "term string, doc_id long, tf int")
    names = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "doc_id long, docno string, ord long")
    w = {(r.term, r.doc_id): r.weight for r in I.online_weights(p, names).collect()}
    assert w["x", 1] == pytest.approx(2 * math.log(0.5 / 1.5)) and w["x", 2] == pytest.approx(math.log(0.5 / 2.5)) and w["y", 2] == pytest.approx(3 * math.log(1.5 / 1.5))
    d = {r.doc_id: r for r in I.document_table(p, names).collect()}
    assert d[2].term_count == 4 and d[2].max_tf == 3 and d[3].term_count == 0 and d[3].norm2 == 0


def test_pruning(spark, golden):
    p = spark.createDataFrame([("x", d, tf) for d, tf in enumerate([1, 1, 5, 2])] + [("y", 9, 1), ("z", 1, 2), ("z", 2, 2)], "term string, doc_id long, tf int")
    assert {(r.term, r.doc_id) for r in I.prune_hard(p, 1).collect()} == {("x", 2), ("y", 9), ("z", 1)}
    assert I.prune_hard(p, 1000).count() == p.count()
    assert {(r.term, r.doc_id) for r in I.prune_soft(p, 1.0).collect()} == {("x", 2), ("y", 9), ("z", 1), ("z", 2)}
    assert {(r.term, r.doc_id) for r in I.prune_soft(p, 9.0).filter("term = 'x'").collect()} == {("x", 3)}
    with pytest.raises(ValueError):
        I.prune(golden, "medium 3")


def test_save_and_load(spark, golden, tmp_path):
    I.save(golden, str(tmp_path / "ix"))
    back = I.load(spark, str(tmp_path / "ix"))
    assert back.positional and back.meta == golden.meta
    assert sorted(map(str, back.lexicon().collect())) == sorted(map(str, golden.lexicon().collect()))
    lines = I.dump_postings(golden.postings)
    assert sorted(map(str, I.parse_postings(lines, True).collect())) == sorted(map(str, golden.postings.select("term", "doc_id", "tf", "positions").collect()))


def test_scores_by_hand(spark):
    tok = [(d, i + 1, w) for d, t in {1: "a b a", 2: "b c", 3: "c c d", 4: "e"}.items() for i, w in enumerate(t.split())]
    t = spark.createDataFrame(tok, "doc_id long, pos int, term string").select("*", F.lit(0).cast("long").alias("seg"), F.lit(False).alias("final"))
    names = spark.createDataFrame([(d, f"N{d}", d) for d in (1, 2, 3, 4)], "doc_id long, docno string, ord long")
    ix = I.build_index(t, names, chain=["lower"])
    q = spark.createDataFrame([("q", 1, "a"), ("q", 2, "c"), ("q", 3, "c"), ("q", 4, "zz")], "qid string, pos int, term string")
    n, v = 4, 5
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5))
    level = lambda tf, dl: 2 * (1 + math.log(tf)) * 2.2 / (1 + math.log(tf) + 1.2 * (0.25 + 0.75 * dl / (v / n)))
    got = {r.doc_id: r.score for r in R.score(q, ix, "BM25").collect()}
    assert got == pytest.approx({1: idf(1) * level(2, 3), 2: 2 * idf(2) * level(1, 2), 3: 2 * idf(2) * level(2, 3)})
    mu = math.sqrt(v / n)
    lm = {r.doc_id: r.score for r in R.score(q, ix, "LM").collect()}
    assert lm[1] == pytest.approx(math.log(1000 * (2 + mu * 2 / v) / (3 + mu)))
    both = q.withColumn("engine", F.lit("LM")).withColumn("force", F.lit(False))
    assert {r.doc_id: r.score for r in R.score(both, ix, None).collect()} == pytest.approx(lm)


def test_union_and_fallback(spark):
    left = spark.createDataFrame([(f"doc{i}", s) for i, s in [(1, 2.5), (2, 2.6), (3, 2.7), (4, 2.9), (5, 2.1)]], "d string, score double")
    right = spark.createDataFrame([("doc1", 3.5), ("doc7", 3.6), ("doc8", 3.7), ("doc2", 3.9), ("doc3", 3.1)], "d string, score double")
    assert [r.d for r in R.extend_unique(left, right, ["d"]).orderBy(F.desc("score")).collect()] == ["doc8", "doc7", "doc4", "doc3", "doc2", "doc1", "doc5"]
    q = spark.createDataFrame([("a", "x, single"), ("b", "stem"), ("c", None)], "qid string, index_pref string")
    a = spark.createDataFrame([("a", "single", 1), ("a", "stem", 2), ("c", "stem", 3)], "qid string, source string, doc_id int")
    assert [tuple(r) for r in R.fall_back(q, a).collect()] == [("a", "single", 1)]


def test_threshold(spark, golden):
    t = spark.createDataFrame([("q", 1, "since", 0.5), ("q", 2, "nope", 0.5), ("q", 3, "jets", 0.5), ("r", 1, "nope", None)], "qid string, pos int, term string, thresh double")
    got = sorted((r.qid, r.pos, r.term) for r in R.threshold_terms(t, golden).collect())
    assert got == [("q", 1, "jets"), ("q", 2, "since"), ("r", 1, "nope")]


def test_search_runs_prefs_and_force(spark, golden):
    q = spark.createDataFrame([("1 ", "silver ball", "bm25", "none,positional", False, 1.0), ("2", None, "LM", "positional", True, None), ("3", "the cdc", "nope", "positional", True, None)], "qid string, text string, engine string, index_pref string, force boolean, query_thresh double")
    got = search(q, {"positional": golden}).collect()
    assert [(r.qid, r.docno, r["rank"], r.source) for r in got] == [("1", "A02", 0, "positional")]


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f1").write_text("<DOC>\n<DOCNO> A-1 </DOCNO>\n<TEXT>one\n<B>two</B></TEXT></DOC>\n<DOC><TEXT>lost</TEXT></DOC><DOC>open")
    (tmp_path / ".hidden").write_text("<DOC><DOCNO>H</DOCNO><TEXT>x</TEXT></DOC>")
    d = trec.split_documents(trec.read_files(spark, str(tmp_path))).collect()
    assert [(r.docno, r.text, r.error) for r in d] == [("A-1", "one\n<B>two</B>", None), (None, "lost", "no DOCNO")]
    f = spark.createDataFrame([("<top>\n<num> Number: 301 \n<title> Topic: Crime \n<desc>x\n</top><top><title> Topic: lost\n",)], "text string")
    assert [tuple(r) for r in trec.read_topics(f).collect()] == [("301", "Crime")]
    r = spark.createDataFrame([("1", "D", 0, 1.5, "single"), ("1", "E", 100, 1.0, "single")], "qid string, docno string, rank int, score double, source string")
    lines = trec.run_lines(r)
    assert [x.value for x in lines.collect()] == ["1 Q0 D 0 1.500000 single"] and trec.read_run(lines).first().score == 1.5


def test_messages(spark):
    m = spark.createDataFrame([('{"Id":"1","Text":"a","Engine":"LM","IndexPref":"stem","QueryThresh":0.5}',), ("broken",)], "value string")
    q = messages.to_queries(m)
    assert [(r.qid, r.force) for r in q.collect()] == [("1", False), (None, False)]
    assert '"Engine":"LM"' in messages.from_queries(q).first().value
    d = messages.read_document_map(spark.createDataFrame([('[{"Id":10,"HumanId":"Fred","TermCount":64,"MaxTf":1,"TermTfIdf":{"test":2.42}}]',)], "value string"))
    assert d.first().weights == {"test": 2.42}
    assert '"HumanId":"Fred"' in messages.document_map_rows(d, spark.createDataFrame([(10, "test", 2.42)], "doc_id long, term string, weight double")).first().value
    r = spark.createDataFrame([("1", 0, "D", 1.5, "single"), ("1", 1, "E", 1.0, "single")], "qid string, rank int, docno string, score double, source string")
    assert '"Document":"D"' in messages.responses(r).first().value


def test_stream_append(spark, tmp_path):
    from termloom.streaming.append import append_postings

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "Cats and cats")], "doc_id long, text string").write.parquet(src)
    s = append_postings(spark.readStream.schema("doc_id long, text string").parquet(src), str(tmp_path / "out"), str(tmp_path / "chk")).start()
    s.processAllAvailable()
    s.stop()
    assert {(r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("cats", 2), ("and", 1)}


def test_queries_that_ask_the_same_are_answered_once(spark, golden):
    """Were each answered by itself, the hits of a table of queries would grow with its rows times the documents."""
    words = {"a": "the cdc", "b": "the CDC", "c": "nowhere the cdc", "d": "the nowhere cdc", "e": "cdc the", "f": "the", "g": "the the", "h": "nowhere"}
    t = spark.createDataFrame([(q, i, w.lower()) for q, x in words.items() for i, w in enumerate(x.split())], "qid string, pos int, term string")
    single = I.Index(golden.postings.drop("positions"), golden.docs, golden.meta)
    as_ = lambda i, t=t: {r.qid: r["__as"] for r in R.distinct_queries(t, i)[1].collect()}
    assert as_(golden) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g"}
    assert as_(single) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "f": "f", "g": "g"}
    assert as_(golden, t.withColumn("engine", F.when(F.col("qid") == "b", "LM").otherwise("BM25")).withColumn("force", F.col("qid") == "c")) == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "e", "f": "f", "g": "g"}
    for i, f in ((golden, R.score_positional), (single, R.score)):
        for engine in R.RANKERS:
            each = {(r.qid, r.doc_id, round(r.score, 9), r["rank"]) for r in R.rank(f(t, i, engine).withColumn("score", F.round("score", 9)), 1).collect()}
            assert each and {(r.qid, r.doc_id, round(r.score, 9), r["rank"]) for r in R.best(t, i, engine, 1, 9).collect()} == each


def test_plain_words_pass_the_chain_as_they_would_the_filters(spark):
    words = ["Word", "word", "CDC", "Ph.D", "F-16", "A/B", "x.pdf", "1,000", "Éa", "a_b", "-", "", None]
    t = spark.createDataFrame([(1, i, w, 0, f) for f in (False, True) for i, w in enumerate(words, 100 * f)], "doc_id long, pos int, term string, seg long, final boolean")
    for chain in (["digits"], ["hyphens", "slashes"], ["hyphens", "slashes", "acronyms", "filename", "lower"], ["null"]):
        out = T.apply_filters(F.array(T.tok(F.col("term"), F.col("final"))), chain)
        plain = {(r.pos, r.s, r.t.text, r.t.final) for r in t.select("pos", F.posexplode(out).alias("s", "t")).collect()}
        assert {(r.pos, r["sub"][-1], r.term, r.final) for r in I.run_chain(t, chain).collect()} == plain


def test_search_keeps_no_more_than_its_limit_of_an_index(spark, golden, monkeypatch):
    kept = []
    monkeypatch.setattr(S, "written", lambda df, name: (kept.append(df.count()) if name == "answers" else None) or df)
    q = spark.createDataFrame([(x, "the", "BM25", "positional", True, 1.0) for x in "ab"], "qid string, text string, engine string, index_pref string, force boolean, query_thresh double")
    assert sorted((r.qid, r["rank"]) for r in search(q, {"positional": golden}, limit=1).collect()) == [("a", 0), ("b", 0)]
    assert kept == [2]  # both documents have the word
