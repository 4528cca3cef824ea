"""Problem 10: text that was decoded with a wrong encoding: find it and give it back."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.session import table, written

#: Code pages a byte may have been read as; "latin" takes windows-1252 and ISO 8859-1 for one, byte by byte.
READ_AS = ["latin", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "cp1250", "cp1254"]
#: (read as, written as) of single bytes: each is a substitution cipher of the upper half.
SWAPS = [
    ("latin", "cp1251"), ("latin", "koi8_r"), ("latin", "cp866"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"),
    ("cp866", "koi8_r"), ("cp1251", "mac_cyrillic"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("latin", "mac_roman"), ("latin", "cp437"),
    ("latin", "cp1256"), ("latin", "cp874"), ("latin", "cp1253"), ("latin", "cp1255"), ("latin", "iso8859_6"),
]
#: Encodings of two bytes, read as single bytes of "latin".
WIDE = ["gb18030", "euc_jp", "big5", "euc_kr", "cp932"]


#: The number of the swap that stands for a table learnt for the source.
LEARNT = len(SWAPS) + len(WIDE) + len(READ_AS)


@lru_cache(maxsize=None)
def byte_of(page: str) -> dict[str, int]:
    """The byte >= 0x80 of every character of a code page."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        for name in ("latin-1", "cp1252") if page == "latin" else (page,):
            try:
                out.setdefault(bytes([b]).decode(name), b)
            except UnicodeDecodeError:
                pass
    return out


def _set(chars) -> str:
    return "[" + "".join(map(re.escape, sorted(chars))) + "]"


@lru_cache(maxsize=None)
def utf8_runs(page: str) -> tuple[re.Pattern, frozenset[str], frozenset[str]]:
    """Runs of characters whose bytes in the code page are whole UTF-8 sequences; the leading and the other characters."""
    of = byte_of(page)
    by = lambda a, b: _set(c for c, x in of.items() if a <= x <= b)
    c = by(0x80, 0xBF)
    return re.compile(f"(?:{by(0xC2, 0xDF)}{c}|{by(0xE0, 0xEF)}{c}{c}|{by(0xF0, 0xF4)}{c}{c}{c})+"), frozenset(c for c, x in of.items() if 0xC2 <= x <= 0xF4), frozenset(c for c, x in of.items() if x < 0xC0)


@lru_cache(maxsize=None)
def own_chars(page: str) -> frozenset[str]:
    """The leading and other characters of UTF-8 sequences in a page that are another byte, or none, in latin."""
    return frozenset(c for c, b in byte_of(page).items() if b <= 0xF4 and byte_of("latin").get(c) != b)


@lru_cache(maxsize=None)
def cipher(read: str, wrote: str) -> dict[int, str]:
    """What to put for every character of a swap, for translate()."""
    out = {}
    for c, b in byte_of(read).items():
        try:
            out[ord(c)] = bytes([b]).decode(wrote)
        except UnicodeDecodeError:
            pass
    return {k: v for k, v in out.items() if chr(k) != v and len(v) == 1}


@lru_cache(maxsize=1)
def cipher_codes() -> np.ndarray:
    """What every swap puts for every character code of the first plane."""
    out = np.tile(np.arange(0x10000, dtype=np.uint32), (len(SWAPS), 1))
    for row, (read, wrote) in zip(out, SWAPS):
        for k, v in cipher(read, wrote).items():
            row[k] = ord(v)
    return out


@lru_cache(maxsize=1)
def swap_chars() -> list[frozenset[str]]:
    """The characters that each swap replaces."""
    return [frozenset(map(chr, cipher(*x))) for x in SWAPS]


_HIGH = re.compile(_set(byte_of("latin")) + "{4,}")
_SJIS = re.compile(f"(?:{_set(c for c, b in byte_of('latin').items() if 0x81 <= b <= 0x9F or 0xE0 <= b <= 0xFC)}(?:[@-~]|{_set(byte_of('latin'))})){{3,}}")
#: Classes of characters of the language model: ASCII letters one each, other ASCII a few, all ideographs, all Hangul and the
#: rest beyond the symbols one class, else one each. A class takes 14 bits.
_CLASSES = 0x2E80 + 0x200
IDEOGRAPH, HANGUL, REST = 1, 2, 3


@lru_cache(maxsize=1)
def token_chars() -> np.ndarray:
    """By character code: whether it is of a token (ASCII letters, and all above ASCII but white space)."""
    token = np.array([c > 0x7F and not chr(c).isspace() or chr(c).isalpha() for c in range(0x3001)])
    return np.concatenate([token, np.ones(0x110000 - len(token), bool)])


@lru_cache(maxsize=1)
def class_of() -> np.ndarray:
    k = np.full(0x110000, REST, np.int32)
    k[:0x80] = ord("!")
    k[9:14] = k[32] = ord(" ")
    k[48:58] = ord("0")
    for begin in (ord("a"), ord("A")):
        k[begin : begin + 26] = np.arange(begin, begin + 26)
    k[0x80:0x2E80] = np.arange(0x80, 0x2E80)
    k[0x3000:0x3200] = np.arange(0x200) + 0x2E80
    k[0x3400:0xA000] = k[0xF900:0xFB00] = IDEOGRAPH
    k[0xAC00:0xD7A4] = HANGUL
    return k


def _high(k):
    """Whether a class is one of characters beyond ASCII."""
    return (k >= 0x80) | (k <= REST)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


class Bigrams:
    """log P(next class | class), smoothed towards the single classes. Only pairs that were seen are kept, in a table hashed by
    the pair, so it takes as much memory as there are different pairs, not the square of the classes."""

    def __init__(self, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> None:
        seen = np.unique(np.concatenate([first, second, [ord(" "), ord("!"), ord("0"), IDEOGRAPH, HANGUL, REST]]).astype(np.int64))
        self.size = len(seen) + 1
        self.slot = np.full(_CLASSES, len(seen), np.int32)
        self.slot[seen] = np.arange(len(seen))
        a, b, n = self.slot[first].astype(np.int64), self.slot[second].astype(np.int64), n.astype(float)
        self.one = np.bincount(b, n, self.size)
        uni = (self.one + 0.02) / (n.sum() + 0.02 * self.size)
        rows = np.bincount(a, n, self.size)
        self.from_, self.to = (-np.log(rows + 4)).astype(np.float32), np.log(4 * uni).astype(np.float32)
        bits = max(10, int(8 * len(a)).bit_length())
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.full((1 << bits) + 64, -1, np.int64), np.zeros((1 << bits) + 64, np.float32)
        key, value = a * self.size + b, np.log((n + 4 * uni[b]) / (rows[a] + 4))
        at = self._hash(key)
        while len(key):  # the first of those that want a free place has it, the others go on to the next
            at_, i = np.unique(at, return_index=True)
            i = i[self.keys[at_] < 0]
            self.keys[at[i]], self.values[at[i]] = key[i], value[i]
            left = np.ones(len(key), bool)
            left[i] = False
            key, value, at = key[left], value[left], at[left] + 1

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def log(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For slots a, b of one shape."""
        key = a.astype(np.int64) * self.size + b
        at = self._hash(key)
        got = self.keys[at]
        out = np.where(got == key, self.values[at], self.from_[a] + self.to[b])
        more = np.nonzero((got != key) & (got >= 0))  # another pair's place
        while len(more[0]):
            at[more] += 1
            got = self.keys[at[more]]
            hit = got == key[more]
            out[tuple(m[hit] for m in more)] = self.values[at[more]][hit]
            more = tuple(m[~hit & (got >= 0)] for m in more)
        return out


class Model:
    """Bigrams of character classes, and characters within the classes of ideographs and the rest; how often each swap
    occurs, by source; tables learnt for sources."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], chars: dict[int, int], swaps: dict[tuple[int, int], int], docs: dict[int, int], tables: dict[int, dict[int, int]] | None = None) -> None:
        self.pairs, self.by_code = Bigrams(*pairs), None
        self.rare = {}
        of = class_of()
        for k in (IDEOGRAPH, HANGUL, REST):
            total = sum(c for x, c in chars.items() if of[x] == k)
            self.rare[k] = {x: float(np.log((c + 0.05) / (total + 500))) for x, c in chars.items() if of[x] == k and c > 0} | {-1: float(np.log(0.05 / (total + 500)))}
        total = sum(docs.values())
        self.prior = {}
        for h in range(-2, LEARNT + 1):
            everywhere = (sum(c for (_, x), c in swaps.items() if x == h) + 0.5) / (total + 1)
            for s, m in docs.items():
                self.prior[s, h] = float(np.log((swaps.get((s, h), 0) + 20 * everywhere) / (m + 20)))
            self.prior[None, h] = float(np.log(everywhere))
        self.tables = tables or {}

    def odds(self, source: int | None, h: int) -> float:
        return self.prior.get((source, h), self.prior[None, h])

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """By character code: the slot, and the log probability within its class."""
        if self.by_code is None:
            k = class_of()
            own = np.zeros(len(k), np.float32)
            for c, d in self.rare.items():
                own[k == c] = d[-1]
                for x, v in d.items():
                    if x >= 0:
                        own[x] = v
            self.by_code = self.pairs.slot[k], own
        return self.by_code

    def __getstate__(self) -> dict:
        return self.__dict__ | {"by_code": None}

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Log probability of every character code after the first (of the last axis); 0 between ASCII, which no swap changes."""
        slot, own = self.codes()
        high = x > 0x7F
        i = np.nonzero(high[..., 1:] | high[..., :-1])
        a, b = x[..., :-1][i], x[..., 1:][i]
        out = np.zeros(x[..., 1:].shape, np.float32)
        out[i] = self.pairs.log(slot[a], slot[b]) + own[b]
        return out

    def sums(self, s: str) -> np.ndarray:
        """sums[b + 1] - sums[a]: log probability of s[a:b] and of what follows it, given what stands before."""
        x = _codes("\n" + s + "\n")
        out = np.zeros(len(x))
        np.cumsum(self.steps(x), out=out[1:])
        return out

    def gains(self, s: str, sums: np.ndarray, runs: list[tuple[int, int, str]]) -> np.ndarray:
        """How much likelier the text gets by each (begin, end, new), all of them put in."""
        parts, at, begin, n = [], 0, [], 0
        for a, b, new in runs:
            parts += [s[at:a], new]
            n += a - at
            begin.append(n)
            n += len(new)
            at = b
        now = self.sums("".join(parts) + s[at:])
        a, b = (np.array([r[i] for r in runs]) for i in (0, 1))
        c = np.array(begin)
        return now[c + np.array([len(r[2]) for r in runs]) + 1] - now[c] - (sums[b + 1] - sums[a])


def count_sites(texts: list[str], buckets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, n, and codes with their n): how often each character beyond ASCII stands between its neighbours, by source, as
    rows (bucket, left, class, right) of classes; and the characters of the classes that many share."""
    x = _codes("\n" + "\n".join(texts) + "\n")
    k = class_of()[x].astype(np.int64)
    at = np.flatnonzero(_high(k))
    if not len(at):
        return np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    names, own = np.unique(np.array(buckets, np.int64), return_inverse=True)
    ends = np.cumsum([len(t) + 1 for t in texts])
    key = ((own[np.searchsorted(ends, at, side="left")] << 14 | k[at - 1]) << 14 | k[at]) << 14 | k[at + 1]
    v, n = np.unique(key, return_counts=True)
    low = (1 << 14) - 1
    shared = x[at][k[at] <= REST].astype(np.int64)
    return np.stack([names[v >> 42], v >> 28 & low, v >> 14 & low, v & low], 1), n, np.stack(np.unique(shared, return_counts=True), 1)


def pairs_of(places: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes of which one is beyond ASCII (others are the same in every reading) of rows of count_sites."""
    last = ~_high(places[:, 3])  # one beyond ASCII counts as the middle of the next place
    key = np.concatenate([places[:, 1] << 14 | places[:, 2], places[last, 2] << 14 | places[last, 3]])
    v, i = np.unique(key, return_inverse=True)
    return v >> 14, v & (1 << 14) - 1, np.bincount(i, np.concatenate([n, n[last]]))


def learn_table(places: np.ndarray, n: np.ndarray, pairs: Bigrams, rounds: int = 60, least: float = 12.0) -> dict[int, int]:
    """The letters that signs of a source stand for, by expectation-maximization against the bigrams of all texts.

    places are rows (left, class, right) of one source, n their counts. Each sign is a letter of an unknown table or itself:
    the expectation is the share of every letter in every place, given its neighbours (themselves, if signs, by what they
    stand for so far) and how often the sign stands for that letter; the maximization counts the shares. Signs that hardly ever
    look like another letter in the first round keep their meaning. A sign stands for a letter that comes to `least` expected
    occurrences and most of what isn't the sign itself; of signs that stand for one letter the most frequent does. A source has
    a table if three signs at least are hardly ever themselves; further signs of the page that those are of join it if they
    are another letter in a quarter of their places. So letters that are only seldom in their places, as in any clean text,
    make no table.
    """
    letters = np.array([c for c in range(0x80, 0x2E80) if chr(c).isalpha() and pairs.slot[c] < pairs.size - 1 and pairs.one[pairs.slot[c]] >= 20], np.int64)
    at = np.isin(places[:, 1], _page_chars())
    places, n = places[at], n[at]
    signs, of = np.unique(places[:, 1], return_inverse=True)
    seldom = np.bincount(of, n, len(signs)) < least
    if not len(letters) or seldom.all():
        return {}
    all_ = np.union1d(letters, signs)
    slots, own = pairs.slot[all_], np.searchsorted(all_, signs)
    table = np.exp(pairs.log(*np.broadcast_arrays(slots[:, None], slots[None])).astype(float))
    phi = np.where(np.isin(all_, letters), 0.5 / len(letters), 0.0) * np.ones((len(signs), 1))
    phi[np.arange(len(signs)), own] = 0.5
    phi[seldom] = 0
    phi[seldom, own[seldom]] = 1
    names = [np.unique(places[:, k], return_inverse=True) for k in (0, 2)]
    fixed = [pairs.log(*np.broadcast_arrays(pairs.slot[names[0][0]][:, None], slots[None])).astype(float), pairs.log(*np.broadcast_arrays(slots[None], pairs.slot[names[1][0]][:, None])).astype(float)]
    open_ = np.flatnonzero(~seldom)
    rows = {int(c): np.flatnonzero(of == c) for c in open_}
    for k in range(rounds):
        sides = []
        for (v, _), f, t in zip(names, fixed, (table, table.T)):
            mine = np.isin(v, signs)
            f = f.copy()
            f[mine] = np.log(phi[np.searchsorted(signs, v[mine])] @ t + 1e-300)
            sides.append(f)
        moved = 0.0
        for c in open_:
            i = rows[int(c)]
            to = np.flatnonzero(phi[c] > 1e-7)
            s = sides[0][names[0][1][i]][:, to] + sides[1][names[1][1][i]][:, to] + np.log(phi[c, to])
            q = np.exp(s - s.max(1, keepdims=True))
            share = (n[i, None] * q / q.sum(1, keepdims=True)).sum(0)
            new = np.zeros(len(all_))
            new[to] = share / share.sum()
            moved = max(moved, float(np.abs(new - phi[c]).max()))
            phi[c] = new
        if k in (0, 4, 9, 14):
            open_ = np.array([c for c in open_ if (1 - phi[c, own[c]]) * n[rows[int(c)]].sum() >= 1 and phi[c, own[c]] < (1.0 if k == 0 else 0.95)], np.int64)
            if (phi[open_, own[open_]] < 0.9 - 0.02 * k).sum() < 3:
                return {}
        if moved < 1e-3 or not len(open_):
            break
    found: dict[int, tuple[int, float, float]] = {}
    for c in open_:
        other = phi[c].copy()
        other[own[c]] = 0
        x, total = int(other.argmax()), float(n[rows[int(c)]].sum())
        if other[x] * total >= least and other[x] >= 0.7 * other.sum():
            found[int(signs[c])] = int(all_[x]), float(other[x] * total), float(other.sum())
    pure = {c for c, (_, _, share) in found.items() if share >= 0.8}
    pages = [set(map(ord, byte_of(p))) for p in READ_AS]
    page = next((p for p in pages if pure <= p), set())
    if len(pure) < 3:
        return {}
    best: dict[int, tuple[float, int]] = {}
    for c, (x, weight, share) in found.items():
        if c in page and share >= 0.25:
            best[x] = max(best.get(x, (0.0, 0)), (weight, c))
    return {c: x for x, (_, c) in best.items()}


@lru_cache(maxsize=1)
def _page_chars() -> np.ndarray:
    """What bytes from 0x80 on are read as by the pages that a table may be learnt for."""
    return np.array(sorted({ord(c) for page in READ_AS for c in byte_of(page)}))


def _put(s: str, runs: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, new in runs:
        parts += [s[at:a], new]
        at = b
    return "".join(parts) + s[at:]


def _decoded(run: str, page: str) -> str | None:
    """What UTF-8 the bytes of a run are, None if they aren't or stand for no characters."""
    of = byte_of(page)
    try:
        new = bytes(of[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if "Cn" in map(category, new) else new


def _utf8(s: str, chars: set[str], allowed: set[int] | None = None):
    """(swap, runs) of UTF-8 sequences read as a code page."""
    for j, page in enumerate(READ_AS):
        if allowed is not None and len(SWAPS) + len(WIDE) + j not in allowed:
            continue
        pattern, lead, rest = utf8_runs(page)
        if not (lead & chars and rest & chars):
            continue
        if page in ("cp1250", "cp1254") and own_chars(page).isdisjoint(chars):
            continue  # reads as latin does
        runs = [(r.start(), r.end(), new) for r in pattern.finditer(s) if (new := _decoded(r.group(), page))]
        if runs:
            yield len(SWAPS) + len(WIDE) + j, runs
            again = [(a, b, pattern.sub(lambda r: _decoded(r.group(), page) or r.group(), new)) for a, b, new in runs]  # noqa: B023
            if again != runs:  # read so twice: what lies between need not look like a text
                yield len(SWAPS) + len(WIDE) + j, again


def chance(s: str, runs: list[tuple[int, int, str]]) -> np.ndarray:
    """That characters happen to form whole sequences is evidence of its own, unless they are small letters as in any word."""
    return np.array([0.0 if s[a:b].islower() and s[a:b].isalpha() else 2.0 * len(new) for a, b, new in runs])


def _wide(s: str):
    """(swap, runs) of bytes of a two-byte encoding read as latin."""
    of = byte_of("latin")
    for pattern, names in ((_HIGH, WIDE[:4]), (_SJIS, WIDE[4:])):
        found = list(pattern.finditer(s))
        for name in names if found else ():
            runs = []
            for r in found:
                data = bytes(of.get(c, ord(c)) for c in r.group())
                for cut in (0, 1):
                    try:
                        runs.append((r.start(), r.end() - cut, data[: len(data) - cut].decode(name)))
                        break
                    except UnicodeDecodeError:
                        pass
            if runs:
                yield len(SWAPS) + WIDE.index(name), runs


#: What most swaps of single bytes leave behind: letters of odd cases within words, signs within words, rows of accents. They
#: are evidence, no condition: without them a swap has to gain more than its full odds.
_SWAP_SIGNS = re.compile(r"[а-яё][А-ЯЁ]|[А-ЯЁ]{2}|[Ѐ-ЏѐѓѕѓєѕіїјљњћќўџґҐ]|[─-▟]|[√¬’“”¤®©№°±≤≥¶§][а-яё]|[а-яё][√¬¤®©№°±≤≥¶§€]|[À-ÿ]{3}|[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]|[A-Za-z][¡-¿ƒ„…†‡ˆ‰Š‹ŒŽš›œžŸˆ˜∂∏π∫Ωαßγδε∞φ∩≡Γπ⌠⌡ⁿ■][a-z]")


def _exchange(x: np.ndarray, tried: list[int], own: dict[int, int] | None) -> np.ndarray:
    """What each of the swaps makes of character codes, a row each."""
    known = [h for h in tried if h != LEARNT]
    new = np.where(x > 0xFFFF, x, cipher_codes()[np.array(known, int)[:, None], np.minimum(x, 0xFFFF)])
    if len(known) < len(tried):
        row = x.copy()
        for c, to in own.items():
            row[x == c] = to
        new = np.concatenate([new, row[None]])
    return new


def _swapped(s: str, m: Model, chars: set[str], source: int | None, allowed: set[int] | None = None):
    """(swap, runs) of substitution ciphers: neighbouring tokens on which the swap gains, joined while their sum lasts.

    Every swap that replaces some character of the text is weighed, all at once, on the tokens that aren't ASCII; those
    whose gains don't come to the least that a run must have are out.
    """
    own = m.tables.get(source)
    tried = [h for h, c in enumerate(swap_chars()) if not c.isdisjoint(chars)] + [LEARNT] * bool(own and not chars.isdisjoint(map(chr, own)))
    if allowed is not None:
        tried = [h for h in tried if h in allowed]
    if not tried:
        return
    x = _codes("\n" + s + "\n")
    inside, high = token_chars()[x], np.cumsum(x > 0x7F)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    b, e = edges[::2], edges[1::2]
    b, e = (y[high[e] > high[b]] for y in (b, e))
    if not len(b):
        return
    sizes = e - b + 2  # with a character on either side
    ends = np.cumsum(sizes)
    x = x[np.arange(ends[-1]) + np.repeat(b - (ends - sizes), sizes)]
    new = _exchange(x, tried, own)
    steps = m.steps(new) - m.steps(x)
    steps[:, ends[:-1] - 1] = 0  # from one token to the next
    gains = np.add.reduceat(steps, ends - sizes, axis=1)
    for i in np.flatnonzero(np.maximum(gains, 0).sum(1) > 6):
        h = tried[i]
        key = own if h == LEARNT else cipher(*SWAPS[h])
        runs: list[tuple[int, int, str]] = []
        start, stop, total, top = 0, 0, 0.0, 0.0
        for begin, end, g in zip([*b.tolist(), 0], [*e.tolist(), 0], [*gains[i].tolist(), -1e9]):
            if top > 0 and total + g < max(0.0, top - 12):
                if top > 6 and stop - start > 2:
                    runs.append((start, stop, s[start:stop].translate(key)))
                total = top = 0.0
            if total <= 0:
                start, total, top = begin, 0.0, 0.0
            total += g
            if total > top:
                top, stop = total, end
        if runs:
            yield h, runs


def step(s: str, m: Model, source: int | None, allowed: set[int] | None = None, least: float = 0.0) -> tuple[str, int, float] | None:
    """(new text, swap, log odds): the swap with the greatest gain over the whole text put in; None if none gains. `allowed` are the swaps
    to look at (all), `least` the log odds that one must come to. Where a swap has good evidence elsewhere in the text, its runs
    that look slightly less likely go too."""
    chars = {c for c in set(s) if c > "\x7f"}
    best = sums = signs = None
    for family in ("utf8", "wide", "swap"):
        if family == "wide" and allowed is not None and not any(len(SWAPS) <= h < len(SWAPS) + len(WIDE) for h in allowed):
            continue
        for h, runs in _utf8(s, chars, allowed) if family == "utf8" else _wide(s) if family == "wide" else _swapped(s, m, chars, source, allowed):
            if sums is None:
                sums = m.sums(s)
            g = m.gains(s, sums, runs)
            if family == "utf8":
                g = g + chance(s, runs)
            evidence = g[g > 0].sum()
            keep = g > (-6 if evidence > 10 and family == "utf8" else 0)
            odds = m.odds(source, h)
            if family == "swap" and signs is None:
                signs = bool(_SWAP_SIGNS.search(s))
            total = float(g[keep].sum()) + (max(odds, -5) if family != "swap" or signs else odds)
            if total > least and (best is None or total > best[0]):
                best = total, h, [r for r, k in zip(runs, keep) if k]
    return (_put(s, best[2]), best[1], best[0]) if best else None


def restore(s: str, m: Model, source: int | None, rounds: int = 6) -> tuple[str, list[int]]:
    """(text given back as far as it can be, the swaps undone; -1 stands for lost characters) of one text."""
    used: list[int] = []
    if s.isascii():
        return s, used
    for _ in range(rounds):
        done = step(s, m, source)
        if done is None:
            break
        s = done[0]
        used.append(done[1])
    if "\ufffd" in s:
        used.append(-1)
    return s, used


_IN_TOKEN, _SWAPPED, _LEAD, _CONT, _LATIN, _SJIS_LEAD, _SJIS_NEXT = (1 << i for i in range(7))


@lru_cache(maxsize=1)
def _flags() -> np.ndarray:
    """By character code, what it can be part of."""
    out = np.zeros(0x110000, np.uint8)
    out[token_chars()] |= _IN_TOKEN
    latin = byte_of("latin")
    lead, rest = (frozenset().union(*(utf8_runs(p)[i] for p in READ_AS)) for i in (1, 2))
    for bit, chars in (
        (_SWAPPED, frozenset().union(*swap_chars())), (_LEAD, lead), (_CONT, rest), (_LATIN, latin),
        (_SJIS_LEAD, [c for c, b in latin.items() if 0x81 <= b <= 0x9F or 0xE0 <= b <= 0xFC]), (_SJIS_NEXT, [*latin, *map(chr, range(0x40, 0x7F))]),
    ):
        out[[ord(c) for c in chars]] |= bit
    return out


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches where it holds; it must not at either end."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[::2], edges[1::2]


class Screen:
    """What every text can gain at most, without reading it character by character in Python.

    A swap of single bytes gains on a text at most the sum of what it gains on those of its tokens where it gains; UTF-8 read
    as a page at most that of its stretches beyond ASCII. Tokens and stretches repeat, so their gains are kept, with the
    characters on either side.
    """

    def __init__(self, m: Model, keep: int = 300_000) -> None:
        self.m, self.keep = m, keep
        self.tokens: dict[str, int] = {}
        self.stretches: dict[str, int] = {}
        self.gain = np.zeros((0, LEARNT), np.float32)
        self.utf8 = np.zeros((0, len(READ_AS)), np.float32)

    def _tokens(self, new: list[str]) -> np.ndarray:
        """The gains of the swaps of single bytes on tokens that have a character on either side; 0 where there is none."""
        out = np.zeros((len(new), LEARNT), np.float32)
        if not new:
            return out
        x = _codes("".join(new))
        sizes = np.array([len(t) for t in new])
        ends = np.cumsum(sizes)
        base = self.m.steps(x)
        base[ends[:-1] - 1] = 0  # from one token to the next
        for h in range(len(SWAPS)):
            y = np.where(x > 0xFFFF, x, cipher_codes()[h][np.minimum(x, 0xFFFF)])
            moved = np.flatnonzero(y != x)
            if not len(moved):
                continue
            touched = np.zeros(len(x) + 1, bool)  # steps at which something changes
            touched[moved] = touched[np.maximum(moved, 1) - 1] = True
            touched[ends[:-1] - 1] = touched[len(x) - 1 :] = False
            i = np.flatnonzero(touched)
            diff = self.m.steps(np.stack([y[i], y[i + 1]], 1))[:, 0] - base[i]
            out[:, h] = np.maximum(np.bincount(np.searchsorted(ends, i, side="right"), diff, len(new)), 0)
        return out

    def _stretches(self, new: list[str]) -> np.ndarray:
        out = np.zeros((len(new), len(READ_AS)), np.float32)
        if not new:
            return out
        s = "".join(new)
        ends = np.cumsum([len(t) for t in new])
        sums = None
        for h, runs in _utf8(s, {c for c in set(s) if c > "\x7f"}):
            if sums is None:
                sums = self.m.sums(s)
            g = self.m.gains(s, sums, runs) + chance(s, runs)
            most = np.bincount(np.searchsorted(ends, [r[0] for r in runs], side="right"), np.maximum(g, 0), len(new))
            j = h - len(SWAPS) - len(WIDE)
            out[:, j] = np.maximum(out[:, j], most)
        return out

    def _rows(self, found: list[str], known: dict[str, int], gains: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray]:
        new = list(dict.fromkeys(t for t in found if t not in known))
        if len(known) + len(new) > self.keep:  # begin anew
            known.clear()
            gains, new = gains[:0], list(dict.fromkeys(found))
        known.update(zip(new, range(len(known), len(known) + len(new))))
        gains = np.concatenate([gains, fill(new)])
        return gains, np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def most(self, texts: list[str]) -> np.ndarray:
        """By text and swap, what the swap can gain at most; infinite for two-byte encodings where there is something to try."""
        out = np.zeros((len(texts), LEARNT), np.float32)
        s = "\n" + "\n".join(texts) + "\n"
        x, ends = _codes(s), np.cumsum([len(t) + 1 for t in texts])
        f = _flags()[x]
        owner = lambda at: np.searchsorted(ends, at, side="left")

        def gained(b: np.ndarray, e: np.ndarray, some: np.ndarray, known: dict[str, int], gains: np.ndarray, fill, first: int) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(some)])
            pick = upto[e] > upto[b]
            b, e = b[pick], e[pick]
            gains, at = self._rows([s[i:j] for i, j in zip((b - 1).tolist(), (e + 1).tolist())], known, gains, fill)
            whose = owner(b)
            for h in range(gains.shape[1]):
                out[:, first + h] = np.bincount(whose, gains[at, h], len(texts))
            return gains

        self.gain = gained(*_spans(f & _IN_TOKEN > 0), f & _SWAPPED > 0, self.tokens, self.gain, self._tokens, 0)
        pair = np.append((f[:-1] & _LEAD > 0) & (f[1:] & _CONT > 0), False)
        self.utf8 = gained(*_spans(x > 0x7F), pair, self.stretches, self.utf8, self._stretches, len(SWAPS) + len(WIDE))
        b, e = _spans(f & _LATIN > 0)
        wide = [b[e - b >= 4]]
        if len(x) > 6:
            two = (f[:-1] & _SJIS_LEAD > 0) & (f[1:] & _SJIS_NEXT > 0)
            wide.append(np.flatnonzero(two[:-4] & two[2:-2] & two[4:]))
        out[owner(np.concatenate(wide)), len(SWAPS) : len(SWAPS) + len(WIDE)] = np.inf
        return out

    def bounds(self, texts: list[str], sources: list[int]) -> np.ndarray:
        """By text and swap, the most that it can gain over its odds: where it isn't above 0, the swap isn't put in."""
        most = self.most(texts)
        names, at = np.unique(np.array(sources, np.int64), return_inverse=True)
        odds = np.array([[max(self.m.odds(int(b), h), -5) for h in range(LEARNT)] for b in names]).reshape(len(names), LEARNT)
        top = np.full((len(texts), LEARNT + 1), -np.inf)
        top[:, :LEARNT] = np.where(most > 0, most + odds[at] + 0.1, -np.inf)  # single precision
        top[:, : len(SWAPS)][most[:, : len(SWAPS)] <= 6] = -np.inf
        for i, (t, b) in enumerate(zip(texts, sources)):
            if b in self.m.tables and next(_swapped(t, self.m, set(map(chr, self.m.tables[b])) & set(t), b, {LEARNT}), None):
                top[i, LEARNT] = np.inf
        return top

    def restored(self, texts: list[str], sources: list[int], least: float = 0.0, margin: float = 0.0, rounds: int = 6) -> tuple[list[str], list[list[int]], np.ndarray]:
        """restore for many texts; and which of them are open: some swap was put in, or left, by less than the margin."""
        out, used = list(texts), [[] for _ in texts]
        top = self.bounds(texts, sources)
        open_ = np.zeros(len(texts), bool)
        at = np.arange(len(texts))
        for _ in range(rounds):
            again = []
            for i, row in zip(at.tolist(), top):
                allowed = np.flatnonzero(row > least)
                done = step(out[i], self.m, sources[i], set(allowed.tolist()), least) if len(allowed) else None
                if done:
                    out[i] = done[0]
                    used[i].append(done[1])
                    again.append(i)
                    open_[i] |= done[2] < least + margin
                else:
                    open_[i] |= row.max() > -margin
            if not again:
                break
            at = np.array(again)
            top = self.bounds([out[i] for i in again], [sources[i] for i in again])
        else:
            open_[at] = True
        for t, u in zip(out, used):
            if "\ufffd" in t:
                u.append(-1)
        return out, used, open_


#: What the rows of counts are: places, shared characters, swaps (-2 for records); of open texts in T, C, S.
_KINDS = "tcsTCS"
_OPEN, _DONE = 10, 11
_COUNTS = "what int, a bigint, b bigint, c bigint, d bigint, n bigint, id {kind}, text string, swaps array<string>"
_NAMES = [f"{w} as {r}" for r, w in SWAPS] + [f"{w} as latin" for w in WIDE] + [f"utf-8 as {r}" for r in READ_AS] + ["learnt"]


def _counted(kinds: str, rows: list[np.ndarray], key: pa.DataType) -> pa.RecordBatch:
    """Rows of counts."""
    m = sum(map(len, rows))
    what = np.repeat([_KINDS.index(k) for k in kinds], [len(r) for r in rows])
    cols = [pa.array(np.ascontiguousarray(x)) for x in np.concatenate([np.zeros((0, 5), np.int64), *rows]).T]
    return pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), *cols, pa.nulls(m, key), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.string()))], ["what", "a", "b", "c", "d", "n", "id", "text", "swaps"])


def _records(what: int, ids: pa.Array, texts: list[str], sources: list[int], swaps: list[list[str]]) -> pa.RecordBatch:
    """Rows of records."""
    m = len(texts)
    cols = [pa.array([what] * m, pa.int32()), pa.array(sources, pa.int64()), *[pa.nulls(m, pa.int64())] * 4, ids, pa.array(texts, pa.string()), pa.array(swaps, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, ["what", "a", "b", "c", "d", "n", "id", "text", "swaps"])


def _wide_rows(*cols) -> np.ndarray:
    """int64 rows of five columns."""
    n = len(cols[-1])
    return np.stack([np.broadcast_to(np.asarray(c, np.int64), n) for c in cols], 1) if n else np.zeros((0, 5), np.int64)


def _site_rows(texts: list[str], buckets: list[int], sign: int) -> list[np.ndarray]:
    places, n, codes = count_sites(texts, buckets)
    return [np.concatenate([places, sign * n[:, None]], 1), _wide_rows(codes[:, 0], 0, 0, 0, sign * codes[:, 1])]


def _pieces(batches, chars: int = 2_000_000) -> Iterator[tuple[pa.Array, list[str], list[int]]]:
    """(keys, texts, sources) of the texts beyond ASCII, in slices of bounded length."""
    for b in batches:
        texts, sources = b.column(1).to_pylist(), b.column(2).to_pylist()
        pick, n = [], 0
        for i, t in enumerate(texts):
            if not t.isascii():
                pick.append(i)
                n += len(t)
            if pick and (n >= chars or i + 1 == len(texts)):
                yield b.column(0).take(pa.array(pick)), [texts[j] for j in pick], [sources[j] for j in pick]
                pick, n = [], 0


def garbled(docs: DataFrame, key: str, text: str, source: str, rounds: int = 12, margin: float = 20.0, buckets: int = 1 << 20) -> DataFrame:
    """(key, text_fixed, swaps): the records of which a stretch was decoded wrongly, with the text given back.

    Unknown code-page swaps are taken for substitution ciphers that a source may use: of single bytes, of UTF-8 sequences
    read as a code page (once or repeatedly), of two-byte encodings, or by a table of letters learnt for the source.
    Expectation-maximization against bigrams of characters: the first bigrams come from all texts as they are. The first
    expectation undoes, in all texts, the swaps of known pages that make a stretch likelier, given how often the source uses
    them; then bigrams and swaps are counted again, and for every source learn_table looks for letters that its signs stand
    for (if there are any, all texts are gone through once more). A text is settled if every swap was put in, or left, by log
    odds of more than `margin`; the further rounds go over all others, until no count of a swap changes or there were `rounds`
    of them, and the last model decides these. Tables are put in by translate(), other swaps by decoding the bytes.

    swaps: names, `lost` for replacement characters (such a record is found, its lost characters are not invented), `learnt` for
    a table of the source. Null, empty and ASCII texts have no row; repeated rows give repeated rows; a null source is a source.
    Sources are told apart by a hash into `buckets`; two that fall together share their odds and their table. Broadcast are the
    pairs of character classes that occur (under 12,500 classes), the odds and the tables of buckets that have any.
    """
    kind = docs.schema[key].dataType.simpleString()
    bucket = F.pmod(F.crc32(F.coalesce(F.col(source).cast("string"), F.lit("")).cast("binary")), F.lit(buckets)).cast("long")
    lean = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), bucket.alias("source")).filter(F.col("text").isNotNull())
    schema = _COUNTS.format(kind=kind)

    def first(batches):
        for b in batches:
            names, n = np.unique(b.column(2).to_numpy(), return_counts=True)
            yield _counted("s", [_wide_rows(names, -2, 0, 0, n)], b.column(0).type)
            for ids, texts, sources in _pieces([b], 8_000_000):
                yield _counted("tc", _site_rows(texts, sources, 1), ids.type)

    def expect(model: Model, whole: bool):
        """Changes of the counts by what the model undoes, and how often each swap is, in settled and in open texts; of all
        texts also the open ones as they are, and what the settled ones that are found become."""

        def run(batches):
            screen = Screen(model)
            for ids, texts, sources in _pieces(batches):
                fixed, used, open_ = screen.restored(texts, sources, least=3.0, margin=margin)  # sure ones only, lest errors feed themselves
                for some, kinds in ((~open_, "stctc"), (open_, "STCTC")):
                    changed = [i for i in np.flatnonzero(some) if fixed[i] != texts[i]]
                    whose = [sources[i] for i in changed]
                    swaps = Counter((sources[i], h) for i in np.flatnonzero(some) for h in set(used[i]))
                    rows = [np.array([(b, h, 0, 0, n) for (b, h), n in swaps.items()], np.int64).reshape(-1, 5)]
                    yield _counted(kinds, rows + _site_rows([texts[i] for i in changed], whose, -1) + _site_rows([fixed[i] for i in changed], whose, 1), ids.type)
                if whole:
                    for what, pick, t in ((_OPEN, np.flatnonzero(open_).tolist(), texts), (_DONE, [i for i, u in enumerate(used) if u and not open_[i]], fixed)):
                        yield _records(what, ids.take(pa.array(pick, pa.int64())), [t[i] for i in pick], [sources[i] for i in pick], [_said(used[i]) for i in pick])

        return run

    def summed(*parts: DataFrame) -> DataFrame:
        place = [F.pmod("what", F.lit(3)).alias("what"), "a", "b", "c", "d"]
        rows = reduce(DataFrame.unionByName, [p.select(*place, "n") for p in parts])
        return rows.groupBy("what", "a", "b", "c", "d").agg(F.sum("n").alias("n")).filter("n <> 0")

    def fitted(counts: DataFrame, tables: dict[int, dict[int, int]]) -> tuple[Model, dict]:
        t = counts.filter("what = 0")
        left = t.select(F.col("b").alias("x"), F.col("c").alias("y"), "n")
        right = t.filter((F.col("d") > REST) & (F.col("d") < 0x80)).select(F.col("c").alias("x"), F.col("d").alias("y"), "n")
        pairs = left.unionByName(right).groupBy("x", "y").agg(F.sum("n").alias("n")).filter("n > 0").select(F.lit(0).alias("what"), "x", "y", "n")
        rest = counts.filter("what > 0").select("what", F.col("a").alias("x"), F.col("b").alias("y"), "n")
        got = pairs.unionByName(rest).toPandas()  # pairs and characters: bounded by the classes; swaps: by the buckets
        p, c, s = (got[got["what"] == w] for w in range(3))
        swaps = {(int(a), int(h)): int(n) for a, h, n in zip(s["x"], s["y"], s["n"])}
        docs_of = {a: n for (a, h), n in swaps.items() if h == -2}
        swaps = {k: n for k, n in swaps.items() if k[1] != -2}
        chars = dict(zip(map(int, c["x"]), map(int, c["n"])))
        return Model((p["x"].to_numpy(np.int64), p["y"].to_numpy(np.int64), p["n"].to_numpy(np.int64)), chars, swaps, docs_of, tables), swaps

    def learnt(counts: DataFrame, model: Model) -> dict[int, dict[int, int]]:
        """The table of every source that has one. A source's rows are bounded by the places that characters can have."""
        pairs = model.pairs

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            table_ = learn_table(pdf[["b", "c", "d"]].to_numpy(np.int64), pdf["n"].to_numpy(float), pairs)
            return pd.DataFrame({"source": int(pdf["a"].iloc[0]), "sign": list(table_), "letter": list(table_.values())}, columns=["source", "sign", "letter"])

        signs = [int(c) for c in _page_chars()]
        rows = counts.filter("what = 0 AND n > 0").filter(F.col("c").isin(signs)).groupBy("a").applyInPandas(run, "source bigint, sign bigint, letter bigint").collect()
        out: dict[int, dict[int, int]] = {}
        for r in rows:
            out.setdefault(r.source, {})[r.sign] = r.letter
        return out

    base = written(summed(lean.mapInArrow(first, schema)), "places")
    model, swaps = fitted(base, {})

    def gone_through(model: Model) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(counts of all but the open texts, those of the open ones, the open texts, records of the settled ones)."""
        full = written(lean.mapInArrow(expect(model, True), schema), "expected")
        kept = written(summed(base, full.filter("what < 3")), "counts")
        return kept, full.filter("what BETWEEN 3 AND 5"), full.filter(f"what = {_OPEN}").select("id", "text", F.col("a").alias("source")), full.filter(f"what = {_DONE}").select("id", F.col("text").alias("text_fixed"), "swaps")

    kept, part, left, done = gone_through(model)
    model, swaps = fitted(summed(kept, part), {})
    if tables := learnt(summed(kept, part), model):
        model.tables = tables
        kept, part, left, done = gone_through(model)
        model, swaps = fitted(summed(kept, part), tables)
    for _ in range(rounds):
        part = written(left.mapInArrow(expect(model, False), schema), "expected")
        before = swaps
        model, swaps = fitted(summed(kept, part), tables)
        if swaps == before:
            break

    def apply(batches):
        screen = Screen(model)
        for ids, texts, sources in _pieces(batches):
            fixed, used, _ = screen.restored(texts, sources)
            pick = [i for i, u in enumerate(used) if u]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pick, pa.int64())), pa.array([fixed[i] for i in pick], pa.string()), pa.array([_said(used[i]) for i in pick], pa.list_(pa.string()))], ["id", "text_fixed", "swaps"])

    found = done.unionByName(left.mapInArrow(apply, f"id {kind}, text_fixed string, swaps array<string>"))
    return found.withColumnRenamed("id", key)


def _said(used: list[int]) -> list[str]:
    return sorted({"lost" if h < 0 else _NAMES[h] for h in used})


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", "text_fixed", F.concat_ws(", ", "swaps").alias("swaps"))


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
