"""Problem 4: sentence units of texts in any language and script."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.operators.skew import with_key_stat
from termloom.session import table, written

END = ".!?…。！？｡।॥؟۔"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‹": "›", "《": "》", "【": "】"}
_CLOSE = set("”“»」』）)]›》】\"’'")
_MARKS = re.compile(r'[“”„«»「」『』（）()\[\]‹›《》【】"]')
_STOP = re.compile(rf"[{END}]+")
_THAI = re.compile(r"(?<=[ก-ฮะ-ฺเ-๎])\s+(?=[ก-ฮเ-ไ])")
_BLANK = re.compile(r"\r?\n[^\S\n]*\n\s*")
_INNER = frozenset("!?…。！？।؟")
_WORD = re.compile(r"[^\W_]+")
#: Common abbreviations before a name or a number, and those that may also end a sentence; fixed values.
BEFORE = frozenset("mr mrs ms dr dra sr sra prof capt sgt lt col gen rev hon mt st no nos fig figs vol art pp p ch sec eq cf vs e.g i.e approx ca abs nr bd vgl z s bzw núm pág p.ej m mme mlle n env ex al т ул г. д стр рис см гл др д-р डॉ सं श्री د م أ".split())
EITHER = frozenset("inc corp co ltd etc a.m p.m jr г руб usw u.s".split())


def _script(c: str) -> str:
    o = ord(c)
    if not c.isalpha():
        return "9" if c.isdigit() else "-"
    if o < 0x370:
        return "L"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x600 <= o < 0x780:
        return "A"
    if 0x900 <= o < 0xE00:
        return "D"
    if 0xE00 <= o < 0xE80:
        return "T"
    if 0x3040 <= o < 0x3100:
        return "K"
    return "H" if 0x3400 <= o < 0xA000 else "O"


def _shape(w: str) -> str:
    if not w:
        return "0"
    if w[0].isdigit():
        return "9" if w.replace(",", "").isdigit() else "9x"
    if not w[0].isalpha():
        return "-"
    n = "1" if len(w) == 1 else "3" if len(w) <= 3 else "n"
    case = "X" if w.isupper() else "Xx" if w[0].isupper() else "x" if w[0].islower() else "c"
    return case + n + ("." if "." in w else "")


def _kind(w: str) -> str:
    """The type a token counts as: lower case, digits as one sign; long ones (clauses of scripts without spaces) by a hash of
    the whole."""
    if w[:1].isdigit():
        return "9"
    w = w.lower()
    return w if len(w) <= 24 else "#" + blake2b(w.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _open_spans(s: str) -> list[tuple[int, int]]:
    """Spans of matched quotation marks and brackets of a paragraph."""
    stack: list[tuple[str, int]] = []
    spans = []
    for m in _MARKS.finditer(s):
        c, i = m.group(), m.start()
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if at is not None:
                spans.append((stack[at][1], i))
                del stack[at:]
            else:
                stack.append((c, i))
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS.get(stack[k][0], "")), None)
        if at is not None:
            spans.append((stack[at][1], i))
            del stack[at:]
        elif c in _PAIRS:
            stack.append((c, i))
    return spans


def _candidates(s: str) -> Iterator[tuple[int, int, str, int, bool, bool]]:
    """(stop, end, mark, next, inside, quoted) of a paragraph: where the mark begins, where the sentence would end with
    its closing marks, where what follows begins; whether a quotation or bracket is still open, and whether one was
    closed that began the sentence."""
    spans = _open_spans(s)
    closers = {b: a for a, b in spans}
    outer: list[list[int]] = []  # spans that lie in no other, in order
    for a, b in sorted(spans):
        if not outer or a > outer[-1][1]:
            outer.append([a, b])
    begins = [a for a, _ in outer]
    marks = sorted([(m.start(), m.end(), m.group()) for m in _STOP.finditer(s)] + [(m.start(), m.start(), "_") for m in _THAI.finditer(s)])
    for i, j, mark in marks:
        quoted = False
        while mark != "_":
            k = j
            while k < len(s) and s[k].isspace() and s[k] != "\n":
                k += 1
            if k in closers and (k == j or s[k] == "»"):
                p = closers[k] - 1
                while p >= 0 and s[p].isspace():
                    p -= 1
                quoted |= p < 0 or s[p] in END or s[p] in _CLOSE
                j = k + 1
            elif j < len(s) and s[j] in _CLOSE and s[j] not in "“'’" and j not in closers and s[j] != '"':
                j += 1
            else:
                break
            while j < len(s) and s[j] in END:
                j += 1
        n = j
        while n < len(s) and s[n].isspace():
            n += 1
        o = bisect_left(begins, j) - 1
        yield i, j, mark, n, o >= 0 and j <= outer[o][1], quoted


def _before(s: str, i: int) -> str:
    k = i
    while k and not s[k - 1].isspace() and s[k - 1] not in _INNER:  # what ends at a mark without a space after it is another token
        k -= 1
    w = s[k:i]
    if not k or s[k - 1].isspace():
        w = w.lstrip("([{“„«\"'‘¿¡「（")
    w = w.rstrip("”»\"')]}」）")
    head, _, tail = w.rpartition(".")
    return tail if tail and len(head) > 3 and head.isalpha() else w


def _after(s: str, n: int) -> str:
    if _script(s[n : n + 1] or "-") in "HKT":  # no spaces: one character
        return s[n]
    m = _WORD.match(s, n)
    return m.group() if m else s[n : n + 1]


class Stats:
    """How often a token type stands before a mark that ends a paragraph (ends) or not (mids), and begins a paragraph or
    follows a mark inside one. rates: the share of ends, and of begins, among all such types; the types need be no more than those of
    the texts at hand. Types with under `seen` occurrences tell nothing."""

    def __init__(self, rows: list[tuple[str, str, int, int]], rates: tuple[float, float], seen: int = 4) -> None:
        self.prev = {t: (a, b) for side, t, a, b in rows if side == "p" and a + b >= seen}
        self.next = {t: (a, b) for side, t, a, b in rows if side == "n" and a + b >= seen}
        self.rate = tuple(max(0.02, r) for r in rates)

    def bucket(self, side: int, kind: str) -> str:
        """-2 and -1: on the sure side too seldom for chance; 1: often enough; 0: unknown."""
        a, b = (self.prev if side == 0 else self.next).get(kind, (0, 0))
        if side and (kind == "9" or len(kind) == 1 and kind.isalpha() and kind.upper() != kind):  # numbers and initials begin sentences and follow abbreviations: they say nothing
            return "0"
        if a >= 2 and a >= 0.2 * self.rate[side] * (a + b):
            return "1"
        if not a + b:
            return "?"
        expected = self.rate[side] * (a + b)
        long = 2 * (len(kind) > 4)  # long types are seldom abbreviations: more must speak for it
        return "-2" if expected - a * 3 > 3 + long else "-1" if expected - a * 3 > 1 + 2 * long else "0"


def _counts(s: str) -> Iterator[tuple[str, str, int, int]]:
    if s[:1].strip():
        yield "n", _kind(_after(s, 0 if s[0].isalnum() else min(1, len(s) - 1))), 1, 0
    for i, j, mark, n, inside, _ in _candidates(s):
        if mark == "_" or inside or n == j < len(s) and _script(s[n]) not in "HK":
            continue
        last = n >= len(s)
        yield "p", _kind(_before(s, i)), int(last), int(not last)
        if not last:
            yield "n", _kind(_after(s, n if s[n].isalnum() else min(n + 1, len(s) - 1))), 0, 1


def features(s: str, c: tuple, stats: Stats) -> list[str]:
    i, j, mark, n, inside, quoted = c
    prev, nxt = _before(s, i), _after(s, n)
    first = nxt[:1]
    opener = first in "“„«\"'‘¿¡「（(『["
    inner = _after(s, n + 1) if opener else nxt
    gap = s[j:n]
    space = "end" if n >= len(s) else "0" if not gap else "n" if "\n" in gap else "1"
    ns = "end" if not first else "o" + _shape(inner)[:1] if opener else _shape(first)[:1] + ("x" if first.islower() else "") if _script(first) in "LC" else _script(first)
    if first and not first.isalnum() and not opener:
        ns = "punct" + first
    ps, pk = _shape(prev), mark if len(mark) == 1 else ".." if set(mark) <= {".", "…"} else mark[0] + "+"
    sc = _script(prev[-1]) if prev else "-"
    pa_, na = stats.bucket(0, _kind(prev)), stats.bucket(1, _kind(inner))
    low = prev.lower()
    lex = "b" if low in BEFORE else "e" if low in EITHER else "-"
    at = "q" if quoted else "c" if j > i + len(mark) else "-"
    out = [f"m{pk}", f"g{space}", f"m{pk}g{space}n{ns}", f"p{ps}", f"p{ps}n{ns}", f"p{ps}n{ns}g{space}", f"s{sc}m{pk}", f"a{pa_}", f"a{pa_}n{ns}m{pk}", f"b{na}", f"b{na}p{ps}", f"l{lex}n{ns}", f"q{at}n{ns}g{space}", f"in{inside}"]
    if at != "-" and ns == "K":
        out.append(f"k{first}")
    if pk in "。！？":
        out.append("full")
    return out


def _sure(s: str, c: tuple, stats: Stats) -> int | None:
    """1 or 0 where the context alone decides, else nothing."""
    i, j, mark, n, inside, _ = c
    if inside:
        return 0
    if mark == "_" or n >= len(s):
        return 1
    prev, nxt = _before(s, i), _after(s, n)
    a, b = stats.bucket(0, _kind(prev)), stats.bucket(1, _kind(nxt))
    tight = n == j
    if nxt[0] in ",;:-–—" or tight and (nxt[0].islower() or nxt[0].isdigit() or (len(prev) == 1 or "." in prev) and nxt[0].isalpha()) and mark == ".":
        return 0
    if mark == "." and (a == "-2" or nxt[0].islower() and b != "1" or prev.lower() in BEFORE or len(prev) == 1 and prev.isupper()):
        return 0
    if prev.lower() in ("inc", "corp", "co", "ltd") and nxt[0].isupper() and not tight:
        return 1
    if mark == "." and prev.isdigit() and b == "-2":
        return 0
    if mark == "." and prev.isdigit() and nxt[0].isdigit() and not tight:
        return 1
    if set(mark) <= {".", "…"} and len(mark) + mark.count("…") > 1 and (tight or nxt[0].islower()):
        return 0
    if j == i + len(mark) and set(mark) <= set("!?。！？।؟"):
        return 1
    if j > i + len(mark) and (nxt[0].islower() or tight and (b == "-2" or _script(nxt[0]) == "K" and s[j - 1] in "」』）")):
        return 0
    if j > i + len(mark) and b == "1":
        return 1
    if a != "-1" and not tight and (b == "1" and (len(prev) > 3 or a == "1") or len(prev) > 4 and prev.isalpha() and b in "?01" and not nxt[0].islower()):
        return 1
    return None


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for m in _BLANK.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


def train(texts: list[str], stats: Stats, rounds: int = 3, steps: int = 120, l2: float = 0.002) -> dict[str, float]:
    """Weights of a maximum-entropy classifier of candidate boundaries.

    Labels are the reliable ones: ends of paragraphs, each joined with the next paragraph as if it went on, marks whose
    context decides, and marks inside quotations and brackets. Candidates without label get the model's own expectation
    in later rounds.
    """
    paras = [p.strip() for t in texts for _, p in paragraphs(t) if p.strip()]
    rows: list[list[str]] = []
    label: list[float] = []
    for k, p in enumerate(paras):
        for c in _candidates(p):
            if c[3] < len(p):
                y = _sure(p, c, stats)
                rows.append(features(p, c, stats))
                label.append(-1.0 if y is None else float(y))
        follow = paras[(k + 1) % len(paras)]
        if p[-1:] and p[-1] in END and follow and _script(p.rstrip(END)[-1:] or "-") == _script(follow[:1]):
            s = p + ("" if _script(follow[0]) in "HK" or k % 12 == 0 else " ") + follow
            for c in _candidates(s):
                if c[1] == len(p):
                    rows.append(features(s, c, stats))
                    label.append(1.0)
    names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    if not rows:
        return {}
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([names[f] for r in rows for f in r])
    y = np.array(label)
    known = y >= 0
    w, target, weight = np.zeros(len(names)), np.where(known, y, 0.5), np.where(known, 1.0, 0.0)
    for r in range(rounds):
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):  # Adam over the whole sample
            p = 1 / (1 + np.exp(-np.bincount(at, w[col], len(rows))))
            g = np.bincount(col, (weight * (p - target))[at], len(w)) / max(1.0, weight.sum()) + l2 * w / 10
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        p = 1 / (1 + np.exp(-np.bincount(at, w[col], len(rows))))
        target, weight = np.where(known, y, p), np.where(known, 1.0, 0.3)
    return {f: float(w[i]) for f, i in names.items()}


def split(text: str | None, stats: Stats, weights: dict[str, float]) -> list[tuple[int, int]]:
    """(start, end) of the sentences in code points, white space around them left out."""
    if not text or not any(map(str.isalpha, text)):
        return []
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        part = text[a:b]
        if body := part.strip():
            lead = a + len(part) - len(part.lstrip())
            out.append((lead, lead + len(body)))

    for at, p in paragraphs(text):
        begin = 0
        for c in _candidates(p):
            if c[4] or c[3] >= len(p) or c[1] <= begin:
                continue
            if c[2] == "_" or sum(weights.get(f, 0.0) for f in features(p, c, stats)) > 0:
                add(at + begin, at + c[1])
                begin = c[1]
        add(at + begin, at + len(p))
    return out


def needed(text: str) -> set[tuple[str, str]]:
    """The (side, type) whose counts split looks at in a text."""
    out = set()
    for _, p in paragraphs(text):
        for c in _candidates(p):
            if c[3] < len(p) and not c[4]:
                nxt = _after(p, c[3])
                out |= {("p", _kind(_before(p, c[0]))), ("n", _kind(nxt)), ("n", _kind(_after(p, c[3] + 1)))}
    return out


def sentence_units(docs: DataFrame, key: str, text: str, sample: int = 3_000, seen: int = 4, small: int = 1_000_000) -> DataFrame:
    """(key, sent_start, sent_end): a row per sentence of every text.

    Null, empty and blank texts and texts without letters give no rows; repeated rows give repeated rows; other columns
    are not read. Counts of token types before and after marks cover all texts; a type with under `seen` occurrences tells
    nothing. The classifier is fitted on at most `sample` texts, those with the smallest hash of their key; every text is split.

    The counts are broadcast if there are at most `small` types; else every text gets those of its own types by joins, with
    the types of many texts apart. Both give the same rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())

    def count(batches):
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                for _, p in paragraphs(t):
                    for side, w, x, y in _counts(p.strip()):
                        n[side, w, 0] += x
                        n[side, w, 1] += y
            keys = sorted({(s, w) for s, w, _ in n})
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((s, w, n[s, w, 0], n[s, w, 1]) for s, w in keys)), (pa.string(), pa.string(), pa.int64(), pa.int64()))] if keys else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())], ["side", "type", "sure", "other"])

    counts = lean.select("text").mapInArrow(count, "side string, type string, sure bigint, other bigint")
    counts = written(counts.groupBy("side", "type").agg(F.sum("sure").alias("sure"), F.sum("other").alias("other")), "types")
    counts = counts.filter(F.col("sure") + F.col("other") >= seen)
    total = {r.side: r.sure / max(1, r.n) for r in counts.groupBy("side").agg(F.sum("sure").alias("sure"), F.sum(F.col("sure") + F.col("other")).alias("n")).collect()}
    rates = total.get("p", 0.0), total.get("n", 0.0)
    few = [r[0] for r in lean.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(sample).select("text").collect()]
    broadcast = counts.count() <= small
    if broadcast:
        rows = [tuple(r) for r in counts.collect()]
    else:
        mine = lean.sparkSession.createDataFrame(sorted(_sample_types(few)), "side string, type string")  # bounded by the sample
        rows = [tuple(r) for r in counts.join(F.broadcast(mine), ["side", "type"]).collect()]
    stats = Stats(rows, rates, seen)
    weights = train(few, stats)
    out = f"id {kind}, sent_start int, sent_end int"

    def units(batches):
        for b in batches:
            given = b.column(2).to_pylist() if b.num_columns > 2 else None
            spans = [split(t, stats if given is None else Stats([tuple(x.values()) for x in given[i] or []], rates, seen), weights) for i, t in enumerate(b.column(1).to_pylist())]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(spans)), [len(x) for x in spans]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i] for y in spans for x in y], pa.int32()) for i in (0, 1))], ["id", "sent_start", "sent_end"])

    if broadcast:
        return lean.mapInArrow(units, out).withColumnRenamed("id", key)

    def needs(batches):
        for b in batches:
            rows = [(u, s + t) for u, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, t in needed(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["uid", "what"])

    texts = written(lean.withColumn("uid", F.monotonically_increasing_id()), "texts")  # the numbers are fixed
    wanted = written(texts.select("uid", "text").mapInArrow(needs, "uid bigint, what string"), "wanted")
    known = counts.select(F.concat("side", "type").alias("what"), "side", "type", "sure", "other")
    known = written(known.join(wanted.groupBy("what").agg(F.count("*").alias("uses")), "what"), "known")
    got = with_key_stat(wanted, known, "what", "uses").groupBy("uid").agg(F.collect_list(F.struct("side", "type", "sure", "other")).alias("types"))  # of one text
    return texts.join(got, "uid", "left").select("id", "text", "types").mapInArrow(units, out).withColumnRenamed("id", key)


def _sample_types(texts: list[str]) -> set[tuple[str, str]]:
    """The types that train looks at: those of the paragraphs, and of each joined with the next."""
    paras = [p.strip() for t in texts for _, p in paragraphs(t) if p.strip()]
    out = set().union(*map(needed, texts)) if texts else set()
    for k, p in enumerate(paras):
        follow = paras[(k + 1) % len(paras)]
        for j in (i for c in _candidates(p) for i in (c[3], c[3] + 1) if i < len(p)):
            out.add(("n", _kind(_after(p, j))))
        out |= {("p", _kind(_before(p, c[0]))) for c in _candidates(p)}
        out |= {("n", _kind(_after(follow, j))) for j in (0, 1) if j < len(follow)}
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(table(spark, d, "passages"), "passage_id", "text")


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every document."""
    return sentence_units(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p4_found": p4_found, "p4_documents": p4_documents}
