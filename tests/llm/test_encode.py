import os
import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import encode as E
from termloom.llm.packing import pack, plan_bins

pytestmark = pytest.mark.skipif(not os.path.isdir(E.FOLDER), reason="no vocabularies")


def test_halves_join_exactly():
    enc, r = E.byte_bpe(), random.Random(1)
    for _ in range(150):
        abc = r.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "aé漢ก😀", "AAAAab"])
        s = "".join(r.choice(abc) for _ in range(r.randint(1, 700)))
        for leaf in (5, 64):
            assert E.encode_stretch(enc, s.encode(), leaf) == enc._encode_single_piece(s.encode())


def test_long_texts_equal_the_library(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé漢 \n.,1'") for _ in range(r.randint(1, 12)))
    texts = [None, "", " ", "<|endoftext|> x", "a" * 5000, "ab" * 3000 + "   " + "é" * 900, " ".join(word() for _ in range(900)), "x\n\n" + "\n" * 700 + "y" * 700 + "  z", "ก" * 400 + "  " + "1" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    lib = Tokenizer.from_file(os.path.join(E.FOLDER, "byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for long_chars in (65_536, 300):
        assert {x.doc_id: x.ids for x in E.encode_corpus(df, "doc_id", "text", long_chars=long_chars).collect()} == want
    assert {x.doc_id: x.n_ids for x in E.encode_corpus(df, "doc_id", "text", long_chars=300, count=True).collect()} == {k: len(v) for k, v in want.items()}
    assert E.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_texts_join_exactly():
    """Parts cut anywhere and joined give the encoding of the whole."""
    enc, r = E.byte_bpe(), random.Random(2)
    units = ["a", "b", "é", "漢", " ", "  ", "\n", "'s", "'", "1", "23", ".", ",", "😀", "\u0301", "\t", "x'"]
    for _ in range(400):
        t = "".join(r.choice(units) for _ in range(r.randint(1, 300)))
        for part in (8, 50):
            assert E.encode_text(enc, t, 1024, part).tolist() == enc.encode_ordinary(t), t
    for t in ("a" * 3000, "漢" * 2000, " " * 900 + "x", "a" * 700 + "1" * 700 + "." * 700):
        assert E.encode_text(enc, t, 64, 256).tolist() == enc.encode_ordinary(t)


def test_repeated_long_rows_and_null_keys(spark):
    r = random.Random(6)
    long = " ".join("".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 9))) for _ in range(9000))
    rows = [(1, long), (1, long), (1, "short"), (1, "short"), (None, long[:20_000]), (None, long[20_000:]), (2, long[:16_385])]
    enc = E.byte_bpe()
    want = sorted((str(k), enc.encode_ordinary(t)) for k, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(0))
    assert sorted((str(x.doc_id), x.ids) for x in E.encode_corpus(df, "doc_id", "text").collect()) == want
    assert sorted((str(x.doc_id), x.n_ids) for x in E.encode_corpus(df, "doc_id", "text", count=True).collect()) == sorted((k, len(v)) for k, v in want)


def test_one_stretch_of_a_megabyte(spark):
    """A stretch that nothing splits, by byte slices over several tasks, against the whole tokenizer."""
    r = random.Random(8)
    t = "x " + "".join(r.choice("etaoinshrdlu") for _ in range(1_100_000)) + " y"
    got = E.encode_corpus(spark.createDataFrame([(1, t)], "doc_id long, text string"), "doc_id", "text").first().ids
    assert E.byte_bpe().decode(got) == t and got == E.byte_bpe().encode_ordinary(t)


def test_plan_holds_all_items():
    r = random.Random(7)
    for lengths in ((64,), (16, 32, 64)):
        for _ in range(40):
            counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(0, 30))}
            plan = plan_bins(counts, lengths)
            got: dict = {}
            for cap, bins, has in plan:
                assert cap in lengths and sum(s * k for s, k in has.items()) <= cap
                for s, k in has.items():
                    got[s] = got.get(s, 0) + k * bins
            assert got == counts


def test_pack(spark):
    items = [(1, 5000), (2, 0), (3, None), (4, 2048), (5, -3)] + [(i, 7) for i in range(10, 400)] + [(1000, 9), (1000, 9)]
    out = pack(spark.createDataFrame(items, "doc_id long, n long").withColumn("part", F.lit(1)), "doc_id", "n").collect()
    fill: dict = {}
    for r in out:
        if r.container is not None:
            fill[r.container] = fill.get(r.container, 0) + r.n_ids
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(n for _, n in items if n and n > 0)
    assert len(fill) == -(-sum(fill.values()) // 2048)
    assert sorted((r.start, r.n_ids) for r in out if r.doc_id == 1) == [(0, 2048), (2048, 2048), (4096, 904)]
    assert {r.doc_id for r in out if r.container is None} == {2, 3, 5} and sum(r.doc_id == 1000 for r in out) == 2
    assert pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n").count() == 0
