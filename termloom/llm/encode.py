"""Problem 8: ids of every text by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.session import table, written

#: Where the vocabularies lie, on every executor.
FOLDER = "/opt/tokenizers"
#: The public pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.zeros(0, dtype=np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k", folder: str = FOLDER):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _whole(enc, data: bytes) -> list[int]:
    """Merges over one unsplit stretch."""
    return enc._encode_single_piece(data)


def join_halves(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of the joined stretch from those of its halves.

    A window of ids around the join, one more on either side at first and then twice as many, is encoded again from its
    bytes until both sides agree: the pair of ids at either border of the window encodes to itself. A sequence in which
    every pair of neighbours encodes to itself is the sequence the merges give, so the result is exact. If the window
    grows over a half, it starts or ends where the half does and needs no check there.
    """
    if not left or not right:
        return left + right
    w = 1
    while True:
        a, b = left[max(0, len(left) - w) :], right[:w]
        mid = _whole(enc, enc.decode_bytes(a) + enc.decode_bytes(b))
        ok = True
        if w < len(left):
            x = [left[len(left) - w - 1], mid[0]]
            ok = _whole(enc, enc.decode_bytes(x)) == x
        if ok and w < len(right):
            x = [mid[-1], right[w]]
            ok = _whole(enc, enc.decode_bytes(x)) == x
        if ok:
            return left[: len(left) - len(a)] + mid + right[len(b) :]
        w *= 2


def merge_tree(enc, parts: list[list[int]]) -> list[int]:
    """Neighbouring parts joined pairwise until one is left."""
    while len(parts) > 1:
        parts = [join_halves(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def encode_stretch(enc, data: bytes, leaf: int = 512) -> list[int]:
    """One unsplit stretch, by halves: merges take time in the square of their length, so only leaves are merged whole."""
    return merge_tree(enc, [_whole(enc, data[i : i + leaf]) for i in range(0, len(data), leaf)])


@lru_cache(maxsize=4)
def _patterns(leaf: int):
    """The splitting pattern, stretches it leaves unsplit over `leaf` characters, and places where it splits in any case."""
    import regex

    long = regex.compile(rf"\p{{L}}{{{leaf},}}|\p{{N}}{{{leaf},}}|[^\s\p{{L}}\p{{N}}]{{{leaf},}}|\s{{{leaf},}}")
    # no piece goes on from a letter, a digit or a sign to another kind of character, but for `'s` and the like
    sure = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")
    return regex.compile(PATTERN), long, sure


def _plain(enc, text: str, leaf: int) -> list[int]:
    """ids of a text; stretches that the pattern leaves unsplit over `leaf` characters are encoded by halves."""
    pieces, long, _ = _patterns(leaf)
    if len(text) < leaf or not long.search(text):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for m in pieces.finditer(text):
        data = m.group().encode()
        out += encode_stretch(enc, data, leaf) if len(data) > leaf else _whole(enc, data)
    return out


def join_texts(enc, left: tuple[str, list[int]], right: tuple[str, list[int]], leaf: int = 1024) -> tuple[str, list[int]]:
    """The joined text and its ids from two texts and theirs.

    A window around the join, 32 characters on either side at first and then twice as many, is widened until it begins and ends
    at places where the pattern splits whatever stands around them: there both sides agree with the encoding of the whole.
    Only the window is encoded again. Where a side has no such place the window takes it whole.
    """
    a, b = left[0], right[0]
    sure = _patterns(leaf)[2]
    w, begin, end = 32, None, None
    while begin is None or end is None:
        if begin is None:
            at = max(0, len(a) - w)
            begin = max((m.start() for m in sure.finditer(a, at + (at > 0))), default=None if at else 0)
        if end is None:
            m = sure.search(b, 1, min(len(b), w))
            end = m.start() if m else len(b) if w >= len(b) else None
        w *= 2
    cut, skip = len(_plain(enc, a[begin:], leaf)), len(_plain(enc, b[:end], leaf))
    return a + b, left[1][: len(left[1]) - cut] + _plain(enc, a[begin:] + b[:end], leaf) + right[1][skip:]


def encode_text(enc, text: str, leaf: int = 1024, part: int = 4_096) -> np.ndarray:
    """ids of a text. One of over `part` characters is cut into parts wherever they end, each is encoded, and neighbours are
    joined pairwise in a tree."""
    if len(text) <= part:
        return np.array(_plain(enc, text, leaf), dtype=np.uint32) if len(text) >= leaf else enc.encode_to_numpy(text, disallowed_special=())
    done = [(x, _plain(enc, x, leaf)) for x in (text[i : i + part] for i in range(0, len(text), part))]
    while len(done) > 1:
        done = [join_texts(enc, done[i], done[i + 1], leaf) if i + 1 < len(done) else done[i] for i in range(0, len(done), 2)]
    return np.array(done[0][1], dtype=np.uint32)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)))


def _batches(batches: Iterable[pa.RecordBatch], name: str, folder: str, count: bool) -> Iterator[pa.RecordBatch]:
    enc = byte_bpe(name, folder)
    for b in batches:
        ids = [encode_text(enc, x) if x else _NONE for x in b.column(1).to_pylist()]
        col = pa.array([len(x) for x in ids], pa.int64()) if count else _lists(ids)
        yield pa.RecordBatch.from_arrays([b.column(0), col], ["id", "n_ids" if count else "ids"])


def _segments(batches: Iterable[pa.RecordBatch], long_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (uid, id, seg, part, stretch, data) of long texts: groups of whole pieces, and byte slices of pieces that alone are long."""
    pieces, _, _ = _patterns(1024)
    for b in batches:
        for key, text, uid in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
            rows: list[tuple[int, int, bool, bytes]] = []
            begin = at = seg = 0

            def plain(end: int) -> None:
                nonlocal begin, seg
                if end > begin:
                    rows.append((seg, 0, False, text[begin:end].encode()))
                    seg += 1
                begin = end

            last = 0  # the last place where a cut changes no piece: behind a piece that doesn't end in white space
            for m in pieces.finditer(text):
                if m.end() - m.start() > long_chars:
                    # white space before a long stretch must be encoded as the pieces it is
                    at = m.start()
                    plain(last)
                    for p in pieces.finditer(text, begin, at):
                        rows.append((seg, 0, True, p.group().encode()))
                        seg += 1
                    data = m.group().encode()
                    rows.extend((seg, i, True, data[o : o + long_chars]) for i, o in enumerate(range(0, len(data), long_chars)))
                    seg += 1
                    begin = last = m.end()
                    continue
                if not text[m.end() - 1].isspace():
                    last = m.end()
                    if last - begin >= long_chars:
                        plain(last)
            plain(len(text))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.bool_(), pa.binary()))]
            ids = pa.array([key.as_py()] * len(rows), b.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([pa.array([uid.as_py()] * len(rows), pa.int64()), ids, *cols], ["uid", "id", "seg", "part", "stretch", "data"])


def encode_corpus(docs: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, long_chars: int = 16_384, count: bool = False) -> DataFrame:
    """(key, ids): the list of ids (array<int>) of every text by a byte-level vocabulary; with count, (key, n_ids).

    Null and empty texts have the empty list. Strings that look like special tokens are ordinary text. Repeated rows
    give repeated rows. An empty table gives no rows; other columns are not read.

    Texts of over 4,096 characters are encoded by parts that are joined in a tree (join_texts). Those of over `long_chars`
    go apart: they are numbered, cut behind whole pieces of the splitting pattern, a piece that alone is longer is cut into byte
    slices, all parts are encoded in parallel, and the slices of one piece are joined pairwise in a tree (join_halves), so no
    task merges a long stretch whole. Null keys and keys that several long texts share are kept apart by the number.
    """
    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    out = f"id {kind}, " + ("n_ids bigint" if count else "ids array<int>")
    short = lean.filter(~is_long).mapInArrow(lambda b: _batches(b, tokenizer, folder, count), out)

    def encode(batches):
        enc = byte_bpe(tokenizer, folder)
        for b in batches:
            ids = [np.array(encode_stretch(enc, x), dtype=np.uint32) if s else encode_text(enc, x.decode()) for x, s in zip(b.column(5).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], _lists(ids)], ["uid", "id", "seg", "part", "stretch", "ids"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = byte_bpe(tokenizer, folder)
        ids: list[int] = []
        for _, g in pdf.sort_values(["seg", "part"]).groupby("seg"):
            ids += merge_tree(enc, [x.tolist() for x in g["ids"]])
        return pd.DataFrame({"id": pdf["id"].iloc[:1].to_numpy(), "n_ids" if count else "ids": [len(ids) if count else ids]})

    cols = f"uid bigint, id {kind}, seg int, part int, stretch boolean, "
    parts = lean.filter(is_long).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(lambda b: _segments(b, long_chars), cols + "data binary")
    parts = written(parts, "parts")  # the numbers are fixed
    parts = parts.repartition("uid", "seg", "part").mapInArrow(encode, cols + "ids array<int>")
    done = short.unionByName(parts.groupBy("uid").applyInPandas(merge, out))
    return done.withColumnRenamed("id", key)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
