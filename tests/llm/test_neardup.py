import random

from termloom.llm.neardup import _counted, document_pairs, missed, near_duplicates, trees_for
from termloom.session import discard


def _texts(r, n=160):
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            t = r.choice(out).split()
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.randint(25, 60))]
        out.append(" ".join(t))
    return out


def _exact(texts, words, threshold, least):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        if len(w) >= max(least, words):
            sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def _similar(a, b):
    x, y = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_pairs_equal_brute_force(spark):
    texts = _texts(random.Random(3)) + ["too short", "", None, "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("x", "x")
    for leaf in (24, 3):  # 3: nodes branch on, and blocks at the deepest level
        links, classes = near_duplicates(df, "doc_id", "text", 3, 0.5, 20, leaf=leaf, most=4, trees=12)
        got = {tuple(r) for r in document_pairs(links, classes, "doc_id").collect()}
        want = _exact(texts, 3, 0.5, 20)
        assert got <= want and len(got) >= 0.99 * len(want)


def test_copies(spark):
    a = " ".join(f"a{i}" for i in range(30))
    b = a + " more"
    df = spark.createDataFrame([(i, a if i < 9 else b, 7) for i in [*range(12), 3, 11]], "doc_id long, text string, rep int")
    links, classes = near_duplicates(df, "doc_id", "text")
    assert links.count() == 1 and classes.select("rep").distinct().count() == 2 and classes.count() == 12
    assert document_pairs(links, classes, "doc_id").count() == 66
    star = {tuple(r) for r in document_pairs(links, classes, "doc_id", copies=5).collect()}
    assert {(0, i) for i in range(1, 9)} <= star and any(x < 9 <= y for x, y in star)


def test_large_group_of_near_copies(spark):
    """Every two of 700 texts are alike: nodes don't shrink, so they are compared by blocks."""
    r, base = random.Random(8), [f"b{i}" for i in range(60)]
    texts = []
    for i in range(700):
        t = list(base)
        t[r.randrange(60)] = f"x{i}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, classes = near_duplicates(df, "doc_id", "text", 3, 0.5)
    assert links.count() == len(_exact(texts, 3, 0.5, 3)) and classes.count() == 700


def test_recall_at_every_level():
    """Trees of the level keep the share of missed pairs; 8 trees alone don't."""
    for level in range(2, 9):
        n = trees_for(0.5, 8, 2, level, 64, 0.0025)
        assert missed(0.5, n, 2, level, 64) <= 0.0025 and (level == 2) == (n == 8)
    assert missed(0.5, 8, 2, 8, 64) > 0.1 and trees_for(0.8, 8, 2, 8, 64, 0.0025) == 8


def test_group_near_the_threshold(spark):
    """Every two of 250 texts have a similarity of about 0.5 to 0.55: their nodes branch on, but aren't dense."""
    r = random.Random(5)
    parts = [" ".join(f"p{i}x{k}" for k in range(20)) for i in range(160)]
    texts = [" ".join(p for p in parts if r.random() < 0.7) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, _ = near_duplicates(df, "doc_id", "text", words=3, threshold=0.5, least_words=20)
    want = _exact(texts, 3, 0.5, 20)
    near = {(a, b) for a, b in want if _similar(texts[a], texts[b]) <= 0.55}
    got = {(x.a, x.b) for x in links.collect()}
    assert got <= want and len(near) > 3_000 and len(got & near) >= 0.995 * len(near)


def test_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 40)], "doc_id long, text string")
    links, classes = near_duplicates(df, "doc_id", "text")
    assert links.count() == 0 and classes.count() == 0


def test_large_nodes_stay_apart(spark):
    """A node that holds a third of all rows is counted as others are, without a shuffle of its rows."""
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i // 2, i) for i in range(900)], "node long, rep long")
    want = {}
    for r in rows.collect():
        want.setdefault(r.node, []).append(r.rep)
    want = {(n, x, len(v)) for n, v in want.items() if len(v) > 1 for x in v}
    for hot in (200_000, 50):
        got, sizes = _counted(rows, hot)
        assert {(r.node, r.rep, r.size) for r in got.collect()} == want
        discard(sizes)
