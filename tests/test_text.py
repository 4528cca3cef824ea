import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from termloom.functions import tokens as T
from termloom.functions.markup_tokens import read, tokenize
from termloom.functions.porter import stem, stem_column
from termloom.operators.dates import dates
from termloom.operators.phrases import phrases


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


GOLDEN = [
    ("(7 CFR) 8c(15)(A)", ["7", "CFR", "8c-15-A"]),
    ("welcome; this is jim's house. Not jims' house", ["welcome", "this", "is", "jims", "house", "Not", "jims", "house"]),
    ("8:43pm 100.242 100,000,1.10", ["8:43pm", "100.242", "100,000,1.10"]),
    ("7 $CFR Part£", ["7", "$CFR", "Part£"]),
    ("Vol. 59, No. 2", ["Vol", "59", "No", "2"]),
]


def test_native_golden(spark):
    got = T.native_tokens(texts(spark, *[g for g, _ in GOLDEN])).orderBy("doc_id", "pos").collect()
    for i, (_, want) in enumerate(GOLDEN):
        assert [r.term for r in got if r.doc_id == i] == want
        assert [r.pos for r in got if r.doc_id == i] == list(range(1, len(want) + 1))


def test_segments_golden(spark):
    got = T.phrase_segments(texts(spark, "welcome; this is jim's house. Not jims' house", "Vol. 59, No. 2")).orderBy("doc_id", "pos").collect()
    assert [r.seg for r in got if r.doc_id == 0] == [0, 1, 1, 1, 1, 2, 2, 2]
    assert len({r.seg for r in got if r.doc_id == 1}) == 4


def test_reader_golden():
    words = lambda s: [w for w, k, _ in read(s) if k == "Text"]
    assert words("[CN&hyph;94&hyph;003]") == ["CN-94-003"]
    assert words("Mayag&uuml;ez") == ["Mayagüez"]
    assert words("<a href=x>y") == ["href=x>y"]
    assert words("a &lt; b") == ["a", "b"]
    assert words('say "all of it" now') == ["say", "now"]
    assert words("AT&T Corp") == ["AT&TCorp"]
    assert words("x &amp") == ["x"] and words("x <b") == ["x"] and words('x "y') == ["x", "y"]  # input that breaks off ends
    assert [k for _, k, _ in read("<P>one</P><!-- no -->")] == ["Tag", "Text", "Tag"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 .,'()-$£;\n`é", max_size=25))
def test_reader_equals_rule_on_plain_text(s):
    """The reader and the rule of the column expressions agree where there is no markup."""
    cat = unicodedata.category
    want = []
    for run in re.findall(r"[^\s]+", s):
        while run and (cat(run[0])[0] == "P" or run[0] == "`"):
            run = run[1:]
        while run and cat(run[-1])[0] in "SP" and cat(run[-1]) not in ("Pd", "Sc"):
            run = run[:-1]
        term = run.translate({ord("("): "-", ord("'"): None, ord(")"): None})
        if term:
            want.append(term)
    assert [w for w, _, _ in read(s)] == want


def test_tokenize_unions_both_ways(spark):
    got = tokenize(texts(spark, "plain text", "<b>bold</b> &eacute;t", None, "")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.term) for r in got] == [(0, 1, "plain"), (0, 2, "text"), (1, 1, "bold"), (1, 2, "é"), (1, 3, "t")]


FILTERS = [
    ("acronyms", "Ph.D. Ph.D Phd PhD U.S.A USA M.S. M.S MS", "phd phd Phd PhD usa USA ms ms MS"),
    ("hyphens", "CDC-50 F-16 1-hour part-of-speech pre-rebellion 141-19 8c(15)(A)", "CDC50 CDC F16 1hour hour part of speech partofspeech prerebellion rebellion 141-19 8c(15)(A)"),
    ("slashes", "USAID/Cairo plain", "USAID Cairo plain"),
    ("digits", "10,0002,10 10,000,000 1000 1000000 1.242 12.00", "10,0002,10 10000000 1000 1000000 1.242 12"),
    ("filename", "test.jpg test.pdf test.html map", "test test.jpg test test.pdf test test.html map"),
    ("null", "some.one@mail.example jim", "some.one@mail.example jim"),
    ("lower", "The QUICK", "the quick"),
]


@pytest.mark.parametrize("name,words,want", FILTERS)
def test_filters(spark, name, words, want):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words.split())], "i int, term string")
    out = df.select("i", F.posexplode(T.apply_filters(F.array(T.tok(F.col("term"), False)), [name])).alias("s", "t")).orderBy("i", "s")
    assert [r.t.text for r in out.collect()] == want.split()


def test_final_tokens_pass(spark):
    df = spark.createDataFrame([("A-B", True), ("A-B", False)], "term string, final boolean")
    out = df.select("final", F.explode(T.apply_filters(F.array(T.tok(F.col("term"), F.col("final"))), ["hyphens", "lower"])).alias("t")).collect()
    assert sorted(r.t.text for r in out if r.final) == ["a-b"] and sorted(r.t.text for r in out if not r.final) == ["a", "b"]


def _dates(spark, words, final=()):
    df = spark.createDataFrame([(1, i, w, i in final) for i, w in enumerate(words.split())], "doc_id int, pos int, term string, final boolean")
    return " ".join(r.term for r in dates(df).orderBy("pos", "sub").collect())


def test_dates(spark):
    assert _dates(spark, "10/3/2013 9-31-13 10-03-95 10-03-203") == "10_03_2013 09_31_2013 10_03_1995 10-03-203"
    assert _dates(spark, "January 23rd 2013 January 1st Jan 2011") == "January 2013 01_23_2013 January 01_01_0000 January 2011 01_00_2011"
    assert _dates(spark, "1993-10-03 March") == "03_10_2003 March"
    assert _dates(spark, "May 5") == "May"  # a day that waits at the end is dropped
    assert _dates(spark, "May May 5") == "May May 5"  # the second of two months begins nothing
    assert _dates(spark, "May 31 x") == "May 31 05_00_0031 x"
    assert _dates(spark, "may x 5", final={1}) == "May x"


def test_phrases(spark):
    def run(words, segs=None, **kw):
        rows = [(1, i, w, (segs or {}).get(i, 0)) for i, w in enumerate(words.split())]
        return [r.phrase for r in phrases(spark.createDataFrame(rows, "doc_id int, pos int, term string, seg int"), **kw).orderBy("pos").collect()]

    assert run("a b c") == ["a b"]
    assert run("solar power") == []
    assert run("solar power", flush_last=True) == ["solar power"]
    assert run("a b c d", {2: 1, 3: 1}) == ["a b"]
    many = " ".join(f"w{i} the" for i in range(15))
    assert run(many)[:3] == ["w0", "w1", "w2"] and len(run(many)) == 15


def test_porter():
    for w, s in {"abatements": "abat", "abbeys": "abbei", "ability": "abil", "abed": "ab", "ions": "ion", "caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "generalizations": "gener", "sky": "sky", "naïve": "naïve", "a1s": "a1s"}.items():
        assert stem(w) == s


def test_stem_column_handles_nulls(spark):
    df = spark.createDataFrame([("running",), (None,), ("running",)], "t string")
    assert [r[0] for r in df.select(stem_column(F.col("t"))).collect()] == ["run", None, "run"]
