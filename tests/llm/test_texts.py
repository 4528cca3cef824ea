"""Sentences, markup and wrong encodings."""

import random
from collections import Counter

from pyspark.sql import functions as F

from termloom.llm import garbled as G, markup as M, sentences as S


def _corpus(r, n=400):
    """Passages with known sentences: abbreviations, initials, numbers, quotations, scripts without spaces."""
    name = lambda: r.choice(["Gar", "Wen", "Os", "Quin", "Bel"]) + r.choice(["ton", "wick", "dale", "mere"])
    noun = lambda: r.choice("harbor permit canal ledger mill".split())
    kinds = [
        lambda: f"The {noun()} near {name()} was taxed by Dr. {name()} again.", lambda: f"See No. {r.randint(1, 99)} and pp. 3-4 on the {noun()}.", lambda: f"Mr. {name()} paid $3,821.95 for it.", lambda: f"Was the {noun()} closed?",
        lambda: f'The order reads: "No {noun()} is open. No {noun()} is shut."', lambda: f'"Was it shut?" asked {name()}.', lambda: f"J. K. {name()} sold the {noun()} in {name()}!", lambda: f"The {noun()} (e.g. the log) rose by 4.5 percent, i.e. more.",
    ]
    cjk = [lambda: "费用上升5.2%，工厂关闭。", lambda: "他说：“仓库已关闭。请等。”", lambda: "桥梁是否修复？"]
    out = []
    for i in range(n):
        k, sep = (cjk, "") if i % 5 == 0 else (kinds, " ")
        out.append([r.choice(k)() for _ in range(r.randint(2, 5))])
        out[-1] = (sep, out[-1])
    return out


def test_sentences_held_out(spark):
    data = _corpus(random.Random(1))
    rows = [(i, sep.join(s)) for i, (sep, s) in enumerate(data)] + [(9001, None), (9002, "  "), (9003, "12 34. 5"), (9004, "One here\n\nTwo\nthere"), (9005, "กขค งจฉ 12 กขค")]
    df = spark.createDataFrame(rows, "passage_id long, text string")
    text = dict(rows)
    got: dict = {}
    for r in S.sentence_units(df, "passage_id", "text").collect():
        got.setdefault(r.passage_id, []).append(text[r.passage_id][r.sent_start : r.sent_end])
    right = total = 0
    for i, (_, s) in enumerate(data):
        right += sum((Counter(got[i]) & Counter(s)).values())
        total += len(s)
    assert right / total > 0.97
    assert not {9001, 9002, 9003} & got.keys()
    assert got[9004] == ["One here", "Two\nthere"] and got[9005] == ["กขค", "งจฉ 12 กขค"]
    assert S.sentence_units(df.limit(0), "passage_id", "text").count() == 0
    both = df.unionByName(df.limit(3)).withColumn("uid", F.lit("clash"))  # repeated rows, and a name used inside
    one, other = (Counter(map(tuple, S.sentence_units(both, "passage_id", "text", small=k).collect())) for k in (10**6, 0))
    assert one == other and max(one.values()) == 2  # counts broadcast or joined


def test_long_types_count_as_wholes():
    a, b = "x" * 40, "y" + "x" * 39
    assert S._kind(a) != S._kind(b) and len(S._kind(a)) < 40 and S._kind("Dr") == "dr"
    assert S._before("“字" + "字" * 60 + "。」字字", 66) == "」字字" and S._before("a" * 60 + ".", 60) == "a" * 60


def test_markup_held_out():
    crf = M.trained()
    good = 0
    for seed in range(7000, 7200):
        text, want, _ = M.labelled_page(seed)
        good += _elements(crf, text) == want
    assert good >= 196


def _elements(crf, text):
    bs = M.blocks(text)
    return [M.LABELS[y] for y in crf.decode(M.features(bs, text)) if 0 < y < 5] if bs else []


#: Pages by hand, not by the generator: (text, its elements as h, l, c, f).
_PAGES = [
    ("# Install\n\nRun this *first*:\n\n    pip install x\n    x --init\n\nThen see [the guide](g.md).\n\n## Options\n\n- `-v` verbose\n- `-q` quiet\n", "hchll"),
    ("Notes\n=====\n\n% of revenue fell by **5 %** this year.\n\n1. First\n2. Second\n\n```python\nprint(1)\n```\n\nDone.", "hllc"),
    ("\\documentclass{article}\n\\begin{document}\n\\section{Bounds}\nWe show \\emph{two} bounds.\n\\begin{align}\na &= b \\\\\nc &= d\n\\end{align}\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\\end{document}", "hfll"),
    ("\\subsection{Data}\n\\begin{tabular}{ll}\na & 1 \\\\\nb & 2\n\\end{tabular}\n\n\\begin{gather}\nx^2\n\\end{gather}\nAll \\textbf{values} are shown.", "hf"),
    ("== History ==\n\nThe '''mill''' was [[built]] in 1801.<ref>Census</ref>\n\n* weir\n* race\n\n<source lang=\"py\">\nx = 1\n</source>\n\n:<math>e^{i\\pi} = -1</math>\n\n[[Category:Mills]]", "hllcf"),
    ("<html><head><title>T</title><style>p{margin:0}</style></head><body><h1>Report</h1>\n<p>%5 growth was seen &amp; noted.</p>\n<ul>\n<li>A</li>\n<li>B <b>bold</b></li>\n</ul>\n<pre><code>a &lt; b\n</code></pre></body></html>", "hllc"),
    ("<DOC>\n<HEAD>Notice of Sale</HEAD>\n<TEXT>\nThe lot &blank; was sold.\n<LIST>\n<ITEM>lot 1</ITEM>\n<ITEM>lot 2</ITEM>\n</LIST>\n</TEXT>\n</DOC>", "hll"),
    ("Title of it\n-----------\n\nText with `code` and more.\n\n* a\n* b\n\n    continued b\n\n$$\na + b = c\n$$\n", "hllf"),
    ("<h2>Steps</h2>\n<ol><li>Open<li>Close</ol>\n<p>All <i>done</i>.<br>\n    indented text goes on</p>", "hll"),
    ("=== Setup ===\n\n# first\n# second\n\n<syntaxhighlight lang=\"bash\">\nmake\n</syntaxhighlight>\n\nSee {{main|x}}.", "hllc"),
    ("> quoted **text**\n\nPlain line with ~~old~~ words.\n\n~~~\nraw\n~~~\n", "c"),
    ("Only <em>inline</em> markup and \\$5 & co.", ""),
]


def test_markup_of_pages_by_hand():
    """Pages that the generator did not write; among them environments, tags and indented code."""
    crf = M.trained()
    names = {"h": "heading", "l": "list_item", "c": "code_block", "f": "formula"}
    wrong = [(t, got, want) for t, want in _PAGES if (got := _elements(crf, t)) != [names[x] for x in want]]
    assert not wrong


def test_no_text_is_lost():
    """A sign of a comment begins one only in TeX."""
    crf = M.trained()
    said = lambda t: M.clean(bs := M.blocks(t), crf.decode(M.features(bs, t)), "t" in M._style(t))
    assert "%5 growth" in said("<p>%5 growth was seen.</p>") and "% of revenue" in said("**x**\n\n% of revenue fell.")
    assert "note" not in said("\\section{A}\n% note\nText \\emph{here}.")


def test_markup_signs():
    for t in ("a <b>x</b>", "x &amp; y", "a **b** c", "[[x]]", "{{x|1}}", "''x''", "a \\emph{x}", "# T", "T\n====", "* a\n* b", "`x`", "<!-- c -->", "[x](#y)", "~~x~~", "3 \\$"):
        assert M.has_markup(t), t
    for t in ("R&D desk", "a < b and b > c", "covers 6 * 308 units", "list_7.txt and list_8.txt", "#796 in", "[sic] near", "im\n17. Jahrhundert", "6 *\n308", "HEADING & MORE\n\ntext"):
        assert not M.has_markup(t), t


def test_structure(spark):
    md = "# T\n\nText *a* b\n\n- one\n- two\n\n```\nx = 1\n```\n\n$a + b$"
    rows = [(1, md), (2, "plain"), (3, None), (4, ""), (5, "only <b>bold"), (6, "<ul><li>open <li>x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("z", "z")
    got = {r.doc_id: r for r in M.structure(df, "doc_id", "text").collect()}
    assert set(got) == {1, 5, 6}
    assert got[1].elems == ["heading", "list_item", "list_item", "code_block", "formula"] and got[5].elems == [] and got[6].elems == ["list_item", "list_item"]
    assert got[1].text_clean == "# T\n\nText a b\n\n- one\n\n- two\n\n```\nx = 1\n```\n\n$$a + b$$" and got[5].text_clean == "only bold"


def test_garbled_round_trip(spark):
    r = random.Random(4)
    latin = ["Der südliche Prüfer wird geöffnet", "Le marché privé a été réparé", "El camión añadió más", "The café’s fee — £5"]
    russian = ["Годовой договор для завода был закрыт", "Был ли архив измерен до марта", "Цена выросла на склад"]
    make = lambda k: ". ".join(r.choice(k) for _ in range(6)) + "."
    rows, bad = [], {}
    for i in range(400):
        t = make(russian if i % 4 == 0 else latin)
        w = t
        if i % 20 == 1:
            w = t.encode().decode("cp1252", "replace") if "\x9d" not in t else t
        elif i % 40 == 3:
            w = t.encode().decode("mac_roman")
        elif i % 40 == 4:
            w = t.encode("cp1251", "replace").decode("koi8_r")
        if w != t:
            bad[i] = t
        rows.append((i, w, f"s{i % 3}" if i % 7 else None))
    rows += [(900, None, "s0"), (901, "", "s0"), (902, "ascii only", "s1"), (903, "lost ��ber", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("q", "q")
    got = {x.doc_id: x for x in G.garbled(df, "doc_id", "text", "source").collect()}
    assert set(got) == set(bad) | {903}
    whole = [i for i in bad if "�" not in dict((a, b) for a, b, _ in rows)[i]]
    assert sum(got[i].text_fixed == bad[i] for i in whole) >= 0.95 * len(whole)
    assert got[903].swaps == ["lost"]


_CLEAN = {
    "latin": "Der südliche Prüfer öffnet die große Straße. Le marché privé a été réparé à Genève, ça va. El camión añadió más según el artículo único. Der Bär hörte über Fußwege. L’été, le père a créé la façade.",
    "cyrillic": "Годовой договор для завода был закрыт. Был ли архив измерен до марта. Цена выросла на склад, а завод закрыт.",
    "greek": "Το λιμάνι και η αποθήκη έκλεισαν. Η γέφυρα μετρήθηκε και η τιμή ανέβηκε.", "hebrew": "הנמל נסגר והמחסן נמכר. הגשר נמדד והמחיר עלה.",
    "arabic": "الميناء مغلق والمخزن مباع. الجسر مقاس والسعر مرتفع.", "thai": "ท่าเรือปิดและโกดังขายแล้ว สะพานวัดแล้วและราคาขึ้น",
}


def _model(texts, sources=None):
    sources = sources or [0] * len(texts)
    places, n, codes = G.count_sites(texts, sources)
    return places, n, G.Model(G.pairs_of(places, n), dict(map(tuple, codes.tolist())), {}, dict(Counter(sources)))


def _small_model(*more):
    return _model([t for t in [*_CLEAN.values(), *more] for _ in range(300)])[2]


def _read(text, wrote, read):
    """text written in one encoding and read in another, None if some byte has no character."""
    of = {b: c for c, b in G.byte_of(read).items()}
    try:
        return "".join(of[b] if b > 127 else chr(b) for b in text.encode(wrote))
    except (UnicodeEncodeError, KeyError):
        return None


def test_every_page_is_tried():
    """One letter in UTF-8 read as each page, and nothing else that looks wrong."""
    m = _small_model()
    for page in G.READ_AS:
        tried = 0
        for t in ("The Prüfer is in", "The große one", "The camión is in", "The único one", "The marché is in", "The façade is in", "The père is in", "The Bär is in"):
            w = _read(t, "utf-8", page)
            if w is not None:
                tried += 1
                assert G.restore(w, m, 0)[0] == t, (page, t, w)
        assert tried > 3, page


def test_every_swap_is_tried():
    """One damaged letter of Latin script, or one damaged word of another script, for each swap."""
    small = _small_model()
    words = {"cp1251": "договор", "koi8_r": "договор", "cp866": "договор", "mac_cyrillic": "договор", "iso8859_5": "договор", "cp1256": "الميناء", "iso8859_6": "الميناء", "cp874": "ท่าเรือปิดและโกดังขายแล้ว", "cp1253": "αποθήκη", "cp1255": "והמחסן"}
    for read, wrote in G.SWAPS:
        word = words.get(wrote)
        if {read, wrote} == {"cp1251", "mac_cyrillic"}:  # the same small letters
            word, m = word.upper(), _small_model("ДОГОВОР ЗАКРЫТ")
        else:
            m = small
        latin = ["marché", "père", "Bär", "camión", "façade"] + ["Straße"] * (wrote != "cp437")  # cp437 ß is latin á, as likely in a word
        given = [f"12 {word} 34"] if word else [f"The {x} is in" for x in latin]
        bad = [(t, w) for t in given if (w := _read(t, wrote, read)) and w != t]
        assert bad, (read, wrote)
        for t, w in bad:
            assert G.restore(w, m, 0)[0] == t, (read, wrote, t, w, G.restore(w, m, 0))


def test_quotes_in_another_page():
    """Curly quotes in UTF-8 read as cp1250 or cp1254: the leading character is as in latin, others aren't."""
    m = _small_model("He said “yes” to it – the harbor’s fee is 5 € now, the word “žal” too.")
    for page in ("cp1250", "cp1254"):
        for t in ("He said “yes", "The harbor’s fee – shut", "The price is 5 € now", "The word “žal"):
            if (w := _read(t, "utf-8", page)) is not None:
                assert G.restore(w, m, 0)[0] == t, (page, t, w)
    quoted = _read("He said “yes” to it", "utf-8", "cp1250")
    assert quoted == "He said â€śyesâ€ť to it" and G.restore(quoted, m, 0)[0] == "He said “yes” to it"


def test_elements_are_numbered_by_kind(spark):
    """Two kinds interleaved: each counts for itself; none where there is no element."""
    rows = [(1, "# A\n\n- x\n- y\n\n# B\n\n- z\n- w\n\ntext"), (2, "only <b>bold")]
    s = M.structure(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = s.select("doc_id", M.F.explode(M.numbered(M.F.col("elems"))).alias("e")).select("doc_id", "e.elem", "e.elem_no")
    want = {(1, "heading", 1), (1, "heading", 2), (1, "list_item", 1), (1, "list_item", 2), (1, "list_item", 3), (1, "list_item", 4), (2, "none", 0)}
    assert {tuple(r) for r in got.collect()} == want


def test_screen_agrees_with_restore():
    """Many texts at once give what each gives alone."""
    m = _small_model()
    texts = [*_CLEAN.values(), "ascii", "", "Der sÃ¼dliche PrÃ¼fer", "Der sÃƒÂ¼dliche PrÃƒÂ¼fer", "12 дПЗПЧПТ 34", "lost \ufffdber", "a\xa0é b"]
    texts += [w for t in _CLEAN.values() for page in G.READ_AS if (w := _read(t, "utf-8", page))]
    texts += [w for t in _CLEAN.values() for read, wrote in G.SWAPS if (w := _read(t, wrote, read))]
    got, used, _ = G.Screen(m).restored(texts, [0] * len(texts))
    for t, g, u in zip(texts, got, used):
        assert (g, u) == G.restore(t, m, 0), t
    few = G.Screen(m, keep=3)  # what is kept begins anew
    assert few.restored(texts, [0] * len(texts))[0] == got


_POLISH = "żółw gęś łąka źródło ćma ciężar książka mąż żona śnieg święto jutro może też już tylko chłopiec góra rzeka miasto zażółć gęślą jaźń wąż pięć dziesięć sześć będą mówić robić człowiek życie śmierć łódź kość miłość noc dzień świat źle dobrze różny każdy ważny duży mały zupełnie ścieżka wieś łóżko córka później północ południe".split()
_OTHERS = [
    "l’été père créé façade être même tête forêt où à déjà voilà marché privé réparé Genève ça garçon français hôtel île sûr naïf Noël œuvre cœur élève très après près".split(),
    "der südliche Prüfer öffnet große Straße Bär hörte Fußwege müssen können über für Tür schön hören größer weiß heiß Füße".split(),
]


def test_a_table_is_learnt_for_a_source(spark):
    """cp1250 read as latin is no swap that is listed: the letters come from the bigrams of other sources' texts."""
    assert ("latin", "cp1250") not in G.SWAPS
    r = random.Random(3)
    make = lambda w: " ".join(r.choice(w) for _ in range(30)) + "."
    rows, truth = [], {}
    for i in range(1500):
        rows.append((i, make(_POLISH if i % 2 else r.choice(_OTHERS)), f"s{i % 5}"))
    for i in range(1500, 1600):
        t = make(_POLISH if i % 3 else _OTHERS[0])
        w = _read(t, "cp1250", "latin") if i % 3 else t
        rows.append((i, w, "bad"))
        if w != t:
            truth[i] = t
    rows.append((1600, "Za¿ó³æ gêœl¹ jaŸñ", "bad"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in G.garbled(df, "doc_id", "text", "source").collect()}
    assert set(got) == set(truth) | {1600}
    assert got[1600].text_fixed == "Zażółć gęślą jaźń" and got[1600].swaps == ["learnt"]
    assert sum(got[i].text_fixed == t for i, t in truth.items()) >= 0.98 * len(truth)


def test_no_table_from_seldom_letters():
    """Letters of a language that only few texts of a source have are no signs of a wrong page."""
    r = random.Random(5)
    texts = [" ".join(r.choice(_OTHERS[i % 2]) for _ in range(30)) for i in range(600)] + ["erdő kő őr fű gyűrű hűvös nő ősz idő szőlő"] * 4
    places, n, m = _model(texts)
    assert G.learn_table(places[:, 1:], n.astype(float), m.pairs) == {}


def test_letters_of_one_damaged_word():
    """UTF-8 read as cp1250 where only one letter shows it."""
    m = _small_model("Może jutro będzie też dobrze.")
    for t in ("Może jutro.", "Ten sam też."):
        assert G.restore(_read(t, "utf-8", "cp1250"), m, 0)[0] == t


def test_garbled_of_odd_tables(spark):
    """Nothing, only ASCII, null keys, repeated rows and names used inside."""
    schema = "doc_id long, text string, source string, id string, what int"
    rows = [(None, "Der sÃ¼dliche PrÃ¼fer wird geÃ¶ffnet", None, "x", 1)] * 2 + [(5, "Der südliche Prüfer wird geöffnet", "s", "y", 2)] * 30 + [(6, "plain", "s", None, None), (7, None, None, None, None)]
    got = G.garbled(spark.createDataFrame(rows, schema), "doc_id", "text", "source").collect()
    assert [(r.doc_id, r.text_fixed) for r in got] == [(None, "Der südliche Prüfer wird geöffnet")] * 2
    assert G.garbled(spark.createDataFrame(rows[-2:], schema), "doc_id", "text", "source").count() == 0
    assert G.garbled(spark.createDataFrame([], schema), "doc_id", "text", "source").count() == 0
