"""Tokens of texts with tags, entities or quoted literals, which the column expressions can't read."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from termloom.functions.tokens import phrase_segments

#: What entities stand for; all others stand for nothing. Fixed values.
ENTITIES = {"hyph": "-", "lt": "<", "gt": ">", "times": "x", "eacute": "é", "uuml": "ü", "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "rsquo": "'", "lsquo": "'"}
_HYPHENS = frozenset("-­֊᠆‐‑⸗・﹣－･")


def _in_word(c: str) -> bool:
    k = unicodedata.category(c)
    return k[0] == "L" or k in ("Nd", "Pd") or c in _HYPHENS


@lru_cache(maxsize=1)
def _runs() -> tuple[re.Pattern, re.Pattern]:
    """Runs of characters that words are made of; words that are one such run, with one mark behind them at most."""
    inside = [i for i in range(0x110000) if _in_word(chr(i))]
    parts, begin = [], inside[0]
    for a, b in zip(inside, [*inside[1:], -1]):
        if b != a + 1:
            parts.append(f"{re.escape(chr(begin))}-{re.escape(chr(a))}")
            begin = b
    run = f"[{''.join(parts)}]+"
    return re.compile(run), re.compile(rf"(?=[^\W_])({run})(?:([.,;:!?)])(?=\s|\Z)|(?=\s|\Z))")


_category = lru_cache(maxsize=100_000)(unicodedata.category)


class _Reader:
    def __init__(self, s: str) -> None:
        self.s, self.i, self.seg, self.run = s, 0, 0, _runs()[0].match

    def unit(self) -> str:
        """One character, or a quoted literal that ends on its line."""
        s, i = self.s, self.i
        if s[i] == '"':
            j = i + 1
            while j < len(s) and s[j] not in '"\n':
                j += 2 if s[j] == "\\" else 1
            if j < len(s) and s[j] == '"':
                self.i = j + 1
                return s[i : j + 1]
        self.i += 1
        return s[i]

    def entity(self) -> str | None:
        """What an entity stands for, from `&` on. Text up to white space stands for itself and swallows it."""
        got = ""
        while self.i < len(self.s):
            u = self.unit()
            if u.isspace():
                return got if len(got) > 1 else None
            if u == ";":
                return ENTITIES.get(got[1:])
            got += u
        return got if len(got) > 1 else None

    def tag(self) -> str | None:
        """The text of a tag from `<` on; None for a comment or if white space comes first, from where text goes on."""
        self.i += 1
        if self.s[self.i : self.i + 1] == "!":
            end = self.s.find(">", self.i)
            self.i = len(self.s) if end < 0 else end + 1
            return None
        if self.s[self.i : self.i + 1] == "/":
            self.i += 1
        got = ""
        while self.i < len(self.s):
            u = self.unit()
            if u == ">":
                return got
            if u.isspace():
                return None
            got += u
        return None

    def word(self) -> str:
        """A word from its first sign on. levels: what is read since each sign inside it; a sign counts once text follows."""
        levels: list[str] = [""]
        signs: list[str] = []

        def close(text: str) -> None:
            """The innermost level ends with this text; the sign that opened it joins or goes."""
            sign = signs.pop()
            levels.pop()
            if text:
                levels[-1] += {"'": "", "(": "-", ")": ""}.get(sign, sign) + text
            elif _category(sign) == "Sc":
                levels[-1] += sign
            elif sign != "'":
                self.seg += 1

        while True:
            c = self.s[self.i : self.i + 1]
            if c == "&":
                e = self.entity()
                if e is not None:
                    levels[-1] += e
                elif levels[-1]:
                    if not signs:
                        return levels[0]
                    close(levels[-1])
            elif m := self.run(self.s, self.i):
                self.i = m.end()
                levels[-1] += m.group()
            elif c and c != "<" and _category(c)[0] in "SP":
                self.unit()
                signs.append(c)
                levels.append("")
            else:
                while signs:
                    close(levels[-1])
                return levels[0]


def read(s: str) -> Iterator[tuple[str, str, int]]:
    """(text, type, breaks before it) of the tokens of a text: Text, Symbol (entities between words) and Tag."""
    r, plain = _Reader(s), _runs()[1].match
    while r.i < len(s):
        if m := plain(s, r.i):
            yield m[1], "Text", r.seg
            r.seg += m[2] is not None
            r.i = m.end() + 1
            continue
        c = s[r.i]
        if c.isspace() or not c.isprintable():
            r.i += 1
        elif c == "<":
            name = r.tag()
            r.seg += 1
            if name is not None:
                yield name, "Tag", r.seg
        elif c == "&":
            e = r.entity()
            if e is not None:
                r.seg += 1
                yield e, "Symbol", 0
        elif c == "`" or _category(c)[0] == "P":
            r.seg += 1
            r.unit()
        else:
            seg, at = r.seg, r.i
            w = r.word()
            if w:
                yield w, "Text", seg
            elif r.i < len(s):
                r.i += 1
            if r.i == at:
                r.i += 1


def markup_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term, type, seg): Text and Symbol tokens; both count in pos, tags vanish."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, pos, words, kinds, segs = [], [], [], [], []
            for t in b.column(1).to_pylist():
                n = 0
                for w, kind_, seg in read(t):
                    if kind_ != "Tag":
                        n += 1
                        pos.append(n)
                        words.append(w)
                        kinds.append(kind_)
                        segs.append(seg)
                sizes.append(n)
            keys = b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int32()), pa.array(words, pa.string()), pa.array(kinds, pa.string()), pa.array(segs, pa.int64())], ["k", "pos", "term", "type", "seg"])

    lean = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return lean.mapInArrow(run, f"k {kind}, pos int, term string, type string, seg bigint").withColumnRenamed("k", key)


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term, type, seg) of every text: column expressions where a text has no `&`, `<` or `"`, else the reader."""
    marked = F.col(text).rlike('[&<"]')
    plain = phrase_segments(docs.filter(~marked), key, text).select(key, "pos", "term", F.lit("Text").alias("type"), "seg")
    return plain.unionByName(markup_tokens(docs.filter(marked), key, text))
