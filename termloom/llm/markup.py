"""Problem 6: clean text and its structure from markup of several kinds."""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from termloom.session import table

LABELS = ["other", "heading", "list_item", "code_block", "formula", "dropped"]
#: Elements that begin and end blocks; of the raw ones the whole content is one block.
_BLOCK = frozenset("html head body title text doc p div section article ul ol li list item table tr td th thead tbody dl dt dd blockquote h1 h2 h3 h4 h5 h6 pre code math script style syntaxhighlight source nav header footer main form hr br center".split())
_RAW = frozenset("pre script style syntaxhighlight source math".split())
_VOID = frozenset("br hr img input meta link".split())
_KEEP = frozenset("h1 h2 h3 h4 h5 h6 li item title dt dd".split())
_RAWTEX = frozenset("verbatim lstlisting minted equation equation* align align* gather gather* displaymath math tabular".split())
_ITEM = re.compile(r"\s*(?:[*+-]|\d{1,3}[.)]) +\S")
_PARTS = (
    r"(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?P<fence>^[ ]{0,3}(?P<tick>```+|~~~+)[^\n`]*$\n(?P<fenced>.*?)(?:^[ ]{0,3}(?P=tick)[ ]*$|\Z))"
    r"|(?P<begin>\\begin\{(?P<benv>[\w*]+)\}(?:\[[^\]\n]*\])?)"
    r"|(?P<end>\\end\{(?P<eenv>[\w*]+)\})"
    r"|(?P<dollars>^\$\$(?P<dd>.*?)\$\$[ ]*$)"
    r"|(?P<square>^[ ]*\\\[(?P<sq>.*?)\\\][ ]*$)"
    r"|(?P<item>\\item\b(?:\[[^\]\n]*\])?)"
    r"|(?P<tag></?(?P<name>[A-Za-z][\w:-]*)(?P<attrs>(?:\s+[^<>\n]*)?)/?>)"
    r"|(?P<nl>\n)"
)
_UNIT = re.compile(_PARTS, re.S | re.M)
#: The same, and code by indentation after a blank line.
_UNIT_INDENT = re.compile(r"(?P<indent>(?:\A|(?<=\n\n))(?:(?: {4}|\t)[^\n]*\S[^\n]*(?:\n|\Z)(?:[ \t]*\n(?= {4}|\t))*)+)|" + _PARTS, re.S | re.M)
_INDENTED = re.compile(r"(?:\A|\n\n)(?: {4}|\t)")
_SIGN = re.compile(
    r"(?=[<&{*~`\\_#=$>\[\]'\n])(?:</?[A-Za-z][\w:-]*(?:\s[^<>\n]*)?/?>|<!--|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]\w+);|\[\[[^\]\n]+\]\]|\{\{[^}\n]*\}\}|''|\*\*\S|~~\S|`[^`\n]+`|\]\([^)\n]*\)|\[\^\w+\]"
    r"|\\(?:[A-Za-z]+|[$&%#_{}\[\]()])|(?<![\w*])\*\w[^*\n]*\w\*(?![\w*])|(?<![\w_])_\w[^_\n]*\w_(?![\w_])|(?<!\w)[*_]\w[*_](?!\w)|~\\|^#{1,6} \S|^={2,6} ?[^=\n]+={2,6} *$|^(?:```|~~~)|(?<=[^\n ])\n(?:=+|-{3,}) *$|^\$\$|^\$[^$\n]+\$ *$|^\{\||^>{1,3} \S)",
    re.M,
)
_LISTS = re.compile(r"(?:\A|\n[ \t]*\n)(?:[*+-]|1[.)]|[#]) +\S[^\n]*(?:\n|\Z)|(?:^|\n)([*+-]|\d+[.)]) +\S[^\n]*\n(?:[*+-]|\d+[.)]) +\S")
_PREFIX = [(n, re.compile(p)) for n, p in (
    ("atx", r"#{1,6} +\S"), ("wiki=", r"(={1,6}) *[^=\s].*?\1\s*$"), ("rule", r"(?:=+|-{3,}|\*{3,})\s*$"), ("bullet*", r"\*+ +\S"), ("bullet-", r"- +\S"), ("bullet+", r"\+ +\S"), ("number", r"\d{1,3}[.)] +\S"), ("hash#", r"#+[^#\s]"),
    ("colon", r"[:;]+ *\S"), ("texhead", r"\\(?:part|chapter|(?:sub)*section|paragraph|title)\*?\{"), ("dollar", r"\$[^$]+\$\s*$"), ("round", r"\\\(.*\\\)\s*$"), ("texcmd", r"\\[A-Za-z]+"), ("percent", r"%"), ("quote", r"> "), ("table", r"\||\{\|"), ("cat", r"\[\[\w+:[^\]]*\]\]\s*$"),
)]


#: Every list has such a line.
_LINE = re.compile(r"^(?:[*+#-]|\d+[.)]) +\S", re.M)
#: Every sign has one of these.
_ANY = re.compile(r"[<&{*~`\\_#=$>\[\]]|''|---")


def has_markup(text: str) -> bool:
    return bool(_ANY.search(text) and _SIGN.search(text) or _LINE.search(text) and _LISTS.search(text))


class Block:
    __slots__ = ("path", "text", "blank", "first", "at", "prefix", "under")

    def __init__(self, path: tuple[str, ...], text: str, blank: bool, first: bool, at: int) -> None:
        self.path, self.text, self.blank, self.first, self.at, self.prefix, self.under = path, text, blank, first, at, "", False


def blocks(text: str) -> list[Block]:
    """Leaf blocks with the path of what they stand in: elements, environments, fences; outside of raw ones a line each."""
    out: list[Block] = []
    stack: list[str] = []
    buf: list[str] = []
    blank = True
    fresh = True
    at = begin = 0
    indented = bool(_INDENTED.search(text)) and _style(text) in ("m", "-")
    unit = _UNIT_INDENT if indented else _UNIT

    def take(a: int, b: int) -> None:
        nonlocal begin
        if not buf:
            begin = a
        buf.append(text[a:b])

    def flush() -> None:
        nonlocal blank, fresh
        s = "".join(buf)
        buf.clear()
        if s.strip():
            out.append(Block(tuple(stack), s, blank, fresh, begin + len(s) - len(s.lstrip())))
            blank = fresh = False

    def whole(kind: str, s: str, a: int) -> None:
        nonlocal blank, fresh
        flush()
        out.append(Block((*stack, kind), s, blank, True, a))
        blank = fresh = False

    n = len(text)
    while at < n:
        m = unit.search(text, at)
        if not m:
            take(at, n)
            break
        take(at, m.start())
        at = m.end()
        if m.group("comment") is not None:
            pass
        elif m.group("nl") is not None:
            line = "".join(buf)
            if stack and stack[-1].lower() in _KEEP and line.strip():
                buf.append(" ")
                if text[at : at + 1] == "\n":
                    flush()
                    blank = True
            else:
                if not line.strip():
                    blank = True
                flush()
        elif m.group("fence") is not None:
            whole("fence", m.group("fenced"), m.start())
        elif indented and m.group("indent") is not None:
            if not stack and not "".join(buf).strip() and not (out and _ITEM.match(out[-1].text)):
                whole("indent", m.group("indent"), m.start())
                blank = True
            else:  # a line as any other
                at = text.find("\n", m.start()) + 1 or n
                take(m.start(), at)
                flush()
        elif m.group("dollars") is not None:
            whole("$$", m.group("dd"), m.start())
        elif m.group("square") is not None:
            whole("\\[", m.group("sq"), m.start())
        elif m.group("begin") is not None:
            flush()
            env = m.group("benv")
            if env in _RAWTEX:
                e = text.find("\\end{" + env + "}", at)
                e = n if e < 0 else e
                whole("tex:" + env, text[at:e], m.start())
                at = min(n, e + len(env) + 6)
            else:
                stack.append("tex:" + env)
                fresh = True
        elif m.group("end") is not None:
            flush()
            env = "tex:" + m.group("eenv")
            if env in stack:
                del stack[len(stack) - 1 - stack[::-1].index(env) :]
        elif m.group("item") is not None:
            flush()
            if stack and stack[-1] == "\\item":
                stack.pop()
            stack.append("\\item")
            fresh = True
        elif m.group("tag") is not None:
            name = m.group("name")
            low = name.lower()
            attrs = m.group("attrs") or ""
            closing = m.group()[1] == "/"
            math = low == "span" and "math" in attrs or low == "math"
            if low == "code" and not (name.isupper() or (not "".join(buf).strip() and text[at : at + 1] == "\n")) or low not in _BLOCK and not math:
                continue  # inline
            flush()
            if low in _VOID:
                continue
            if closing:
                hit = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].lower() == low), None)
                if hit is not None:
                    del stack[hit:]
                continue
            if low in _RAW or math or low == "code":
                tag = name if not math or low == "math" else "span"
                e = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                stop = e.start() if e else n
                whole("math" if math else name, text[at:stop], m.start())
                at = e.end() if e else n
                continue
            if low in ("li", "item", "p", "dt", "dd", "tr", "td", "th") or low[0] == "h" and low[1:].isdigit():
                same = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].lower() == low or stack[i].lower() == "p" or (stack[i][0] in "hH" and stack[i][1:].isdigit())), None)
                if same is not None and not any(x.lower() in ("ul", "ol", "list") for x in stack[same + 1 :]):
                    del stack[same:]
            elif stack and stack[-1].lower() == "p" and low in ("ul", "ol", "list", "div", "table"):
                stack.pop()
            stack.append(name)
            fresh = True
    flush()
    for i, b in enumerate(out):
        s = b.text.strip()
        raw = bool(b.path) and (b.path[-1] in ("fence", "indent", "$$", "\\[", "math") or b.path[-1].lower() in _RAW or b.path[-1].lower() == "code" or b.path[-1].startswith("tex:") and b.path[-1][4:] in _RAWTEX)
        b.prefix = "raw" if raw else next((n for n, p in _PREFIX if p.match(s)), "none")
        if b.prefix == "rule" and i and not b.blank and out[i - 1].prefix not in ("raw", "rule"):
            out[i - 1].under = True
    return out


def _style(text: str) -> str:
    """What kinds of markup a text has, as a word."""
    wiki = bool(re.search(r"\[\[|'''?|^==+ ?[^=\n]+==+ *$|\{\{|<ref|<math|<syntaxhigh", text, re.M))
    tex = bool(re.search(r"\\(?:begin|(?:sub)*section|emph|text\w\w|item|documentclass|footnote|cite)\b", text))
    tags = bool(re.search(r"</?(?:p|h\d|ul|ol|li|body|html|HEAD|BODY|TEXT|LIST|P|H\d)\b", text))
    mark = bool(re.search(r"\*\*\w|(?<![\w*])\*\w|`|\]\(|~~\w|^[=-]{3,} *$|\[\^|^#{2,6} ", text, re.M))
    return "wtgm"[0] * wiki + "wtgm"[1] * tex + "wtgm"[2] * tags + "m" * mark or "-"


def features(bs: list[Block], text: str) -> list[list[str]]:
    style = _style(text)
    out = []
    for i, b in enumerate(bs):
        s = b.text.strip()
        prev, nxt = (bs[i - 1] if i else None), (bs[i + 1] if i + 1 < len(bs) else None)
        up = b.path[-1] if b.path else "-"
        run = ("p" if prev is not None and prev.prefix == b.prefix and not b.blank else "") + ("n" if nxt is not None and nxt.prefix == b.prefix and not nxt.blank else "")
        last = s[-1:]
        n = len(s)
        signs = sum(c in "=<>()[]{};:\\^_|" for c in s) * 8 // max(n, 1)
        size = "0" if n < 3 else "1" if n < 40 else "2" if n < 90 else "3"
        inner = up.lower()
        f = ["bias", f"up={inner}", f"UP={up}", f"pre={b.prefix}", f"pre={b.prefix}|{style}", f"pre={b.prefix}|{run}", f"pre={b.prefix}|{run}|{style}", f"pre={b.prefix}|b{int(b.blank)}", f"pre={b.prefix}|b{int(b.blank)}|{run}|{size}", f"under={int(b.under)}", f"size={size}", f"end={'.' if last in '.!?。！？।؟…”“»」' else 'a' if last.isalnum() else 'o'}", f"signs={min(signs, 3)}", f"first={int(b.first)}|{inner}", f"next={nxt.prefix if nxt else 'end'}", f"prev={prev.prefix if prev else 'begin'}"]
        f += [f"in={x.lower()}" for x in b.path[:-1]]
        if "html" in (x.lower() for x in b.path) and inner == "head":
            f.append("htmlhead")
        out.append(f)
    return out


# ---------------------------------------------------------------------------------------------------------------- pages
def _words(r: random.Random, n: int) -> str:
    abc = r.choice(["abcdefghijklmnoprstuvwz", "abcdeéèilmnoprstuü", "абвгдежзиклмнопрсту", "的县港水库报告工厂合同", "अबकदगहलमनप", "กขคงจชดตนบ", "ابتدرسعقلمن"])
    out = ["".join(r.choice(abc) for _ in range(r.randint(2, 9))) for _ in range(n)]
    for i in range(len(out)):
        if r.random() < 0.12:
            out[i] = r.choice([str(r.randint(1, 999)), f"{out[i][0].upper()}&{out[i][-1].upper()}", f"#{r.randint(1, 99)}", f"{r.randint(1, 99)}.", f"{r.randint(1, 9)} *", f"{out[i]}_{r.randint(1, 99)}.csv", "(cf.", "<", ">", f"${r.randint(1, 99)},{r.randint(100, 999)}.{r.randint(10, 99)}", "—"])
    return " ".join(out).capitalize()


def _sentence(r: random.Random) -> str:
    return _words(r, r.randint(4, 14)) + r.choice([".", ".", "!", "?", "。", ".”"])


def _math(r: random.Random) -> str:
    a, b = r.choice(["\\alpha", "\\beta", "x", "Q", "w_{3}", "h"]), r.randint(1, 99)
    return r.choice([f"{a} + y = {b}.{b}", f"{a} = \\sqrt{{{b} + v^2}}", f"\\sum_{{i=1}}^{{{b}}} t_i \\leq {b}", f"{a} = \\frac{{N - {b}}}{{{b}}}", f"{a} = {b} \\cdot A^{{2}}", "E = mc^2"])


def _code(r: random.Random) -> str:
    return "\n".join(r.choice([f"set x_limit = {r.randint(1, 99)}", "for i in items: total += i * 2", "print(a, b)", "load f.dat -> g[3]", "if n > 4 then mark(q)", "x = {1: 2}", "# a note", "- step one", "return y;"]) for _ in range(r.randint(1, 5)))


def labelled_page(seed: int) -> tuple[str, list[str], list[tuple[int, int, str]]]:
    """A made page of one kind of markup, the labels of its elements in order, and where each stretch of it came from:
    (begin, end, label). What isn't within one is other text."""
    r = random.Random(seed)
    kind = r.choice(["html", "soup", "md", "wiki", "tex", "sgml"])
    plan = [r.choice(["heading", "text", "text", "list", "code", "formula", "text"]) for _ in range(r.randint(1, 9))]
    parts, want, labels = [], [], []
    level, mark, number = r.randint(1, 6), r.choice("-*+"), r.random() < 0.3
    setext, tick, low = r.random() < 0.4, r.choice(["```", "~~~"]), r.random() < 0.5
    esc = lambda s: html.escape(s, quote=False) if kind in ("html", "soup", "sgml") else s

    def inline(s: str) -> str:
        w = s.split(" ")
        for i in range(len(w)):
            if r.random() < 0.06 and w[i].isalpha():
                w[i] = {"html": f"<b>{w[i]}</b>", "soup": f"<span style=\"c\">{w[i]}</span>", "md": r.choice([f"**{w[i]}**", f"`{w[i]}`", f"[{w[i]}](#a)", f"*{w[i]}*", f"~~{w[i]}~~"]), "wiki": r.choice([f"''{w[i]}''", f"[[{w[i]}]]", f"{w[i]}<ref>n</ref>"]), "tex": r.choice([f"\\emph{{{w[i]}}}", f"{{\\it {w[i]}}}", f"{w[i]}~\\cite{{k}}"]), "sgml": f"<HL>{w[i]}</HL>"}[kind]
        return " ".join(w)

    for p in plan:
        if p == "heading":
            t = esc(_words(r, r.randint(1, 4)))
            want.append("heading")
            labels.append("heading")
            parts.append({"html": f"<h{level}>{t}</h{level}>", "soup": f"<H{level} id=\"s\">{t}</H{level}>", "md": f"{t}\n{'=-'[level % 2] * max(3, len(t))}" if setext else "#" * level + f" {t}", "wiki": "=" * max(2, level) + f" {t} " + "=" * max(2, level), "tex": f"\\{r.choice(['section', 'subsection', 'section*', 'subsubsection'])}{{{t}}}", "sgml": f"<HEAD>\n{t}\n</HEAD>" if low else f"<HEAD>{t}</HEAD>"}[kind])
        elif p == "text":
            labels.append("other")
            s = inline(esc(" ".join(_sentence(r) for _ in range(r.randint(1, 5)))))
            if r.random() < 0.5:  # wrapped
                s = re.sub(r"(.{30,70}?) ", "\\1\n", s)
            parts.append({"html": f"<p>{s}</p>", "soup": r.choice([f"<P class=tx>{s}", f"{s}<br/><br>", s]), "sgml": r.choice([f"<BODY>\n{s}\n</BODY>", f"<!-- QZ a -->\n{s}\n<!-- /end -->"])}.get(kind, s))
        elif p == "list":
            k = [esc(_words(r, r.randint(1, 4))) for _ in range(r.randint(2, 5))]
            want += ["list_item"] * len(k)
            labels.append("list_item")
            tag = r.choice(["ul", "ol"])
            sep = "\n" if low else ""
            parts.append({"html": f"<{tag}>{sep}" + sep.join(f"<li>{x}</li>" for x in k) + f"{sep}</{tag}>", "soup": f"<{tag}>\n" + "\n".join(f"<LI>{x}" for x in k) + f"</{tag}>", "md": "\n".join((f"{i + 1}. " if number else mark + " ") + x for i, x in enumerate(k)), "wiki": "\n".join(("# " if number else "* ") + x for x in k), "tex": "\\begin{itemize}\n" + "\n".join(f"\\item {x}" for x in k) + "\n\\end{itemize}", "sgml": "<LIST>\n" + "\n".join(f"<ITEM>{x}</ITEM>" for x in k) + "\n</LIST>"}[kind])
        elif p == "code":
            c = esc(_code(r))
            want.append("code_block")
            labels.append("code_block")
            env = r.choice(["verbatim", "lstlisting", "minted"])
            spaced = not parts or not _ITEM.match(parts[-1].splitlines()[-1])  # after a list it would go on with its item
            parts.append({"html": r.choice([f"<pre><code>{c}</code></pre>", f"<pre>{c}</pre>"]), "soup": f"<PRE>\n{c}\n</PRE>", "md": "\n".join("    " + x for x in c.split("\n")) if spaced and r.random() < 0.3 else f"{tick}{r.choice(['', 'text', 'conf'])}\n{c}\n{tick}", "wiki": r.choice([f"<pre>{c}</pre>", f'<syntaxhighlight lang="text">\n{c}\n</syntaxhighlight>', f'<source lang="py">\n{c}\n</source>']), "tex": f"\\begin{{{env}}}\n{c}\n\\end{{{env}}}", "sgml": f"<CODE>\n{c}\n</CODE>"}[kind])
        else:
            m = _math(r)
            want.append("formula")
            labels.append("formula")
            many = r.choice(["equation", "align", "align*", "gather", "displaymath"])
            parts.append({"html": r.choice([f'<span class="math">\\({m}\\)</span>', f"\\({m}\\)"]), "soup": r.choice([f'<span class="math">\\({m}\\)</span>', f"\\({m}\\)"]), "md": r.choice([f"$$\n{m}\n$$", f"${m}$"]), "wiki": r.choice([f"<math>{m}</math>", f':<math display="block">{m}</math>']), "tex": r.choice([f"\\[ {m} \\]", f"\\begin{{{many}}}\n{m}\n\\end{{{many}}}", f"$${m}$$"]), "sgml": f"<MATH>{m}</MATH>"}[kind])
    before, after = "", ""
    if kind == "html" or kind == "soup":
        before = r.choice(["", "", "<script>var k=2;</script>\n", "<html><head><style>p{margin:2px}</style></head><body>\n"])
    if kind == "tex":
        before = r.choice(["", "\\documentclass{article}\n\\begin{document}\n% note\n"])
        if r.random() < 0.2:
            parts.append("\\begin{tabular}{ll}\n" + " \\\\\n".join(f"{_words(r, 1)} & {r.randint(1, 99)}" for _ in range(3)) + "\n\\end{tabular}")
            labels.append("other")
    if kind == "sgml":
        before = r.choice(["", "<TEXT>\n"])
    if kind == "wiki":
        after = r.choice(["", "\n\n[[Category:Xy]]", "\n{{stub|9}}"])
    spans = [(0, len(before), "dropped")] if before.startswith(("<script", "<html")) else []
    at, gap = len(before), "\n" if kind == "soup" and low else "\n\n"
    for part, y in zip(parts, labels):
        under = part.rfind("\n") if y == "heading" and kind == "md" and setext else len(part)
        spans.append((at + len(part) - len(part.lstrip(":")), at + under, y))  # a wiki indent is no part of it
        at += len(part) + len(gap)
    return before + gap.join(parts) + after, want, spans


def _gold(bs: list[Block], spans: list[tuple[int, int, str]]) -> list[int]:
    """Labels of the blocks of a made page: those of the stretches they begin in."""
    begins = [a for a, _, _ in spans]
    out = []
    for b in bs:
        i = bisect_right(begins, b.at) - 1
        out.append(LABELS.index(spans[i][2] if i >= 0 and b.at < spans[i][1] else "other"))
    return out


class Crf:
    """Linear-chain conditional random field."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(len(LABELS))
        return np.array([sum((self.weights[x] for x in f if x in self.weights), zero) for f in feats])

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi."""
        e = self.scores(feats)
        best, back = e[0], []
        for row in e[1:]:
            s = best[:, None] + self.trans
            back.append(s.argmax(0))
            best = s.max(0) + row
        y = [int(best.argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]


@lru_cache(maxsize=1)
def trained(pages: int = 800, steps: int = 120, l2: float = 1e-4) -> Crf:
    """Weights that maximise the likelihood of the labels of made pages (a fixed sample, the same everywhere), by Adam over forward-backward sums of all pages at once."""
    data = []
    for seed in range(pages):
        text, _, spans = labelled_page(seed)
        bs = blocks(text)
        if bs:
            data.append((features(bs, text), _gold(bs, spans)))
    data.sort(key=lambda d: -len(d[1]))  # so that the pages that have a t-th block are the first ones
    names = {f: i for i, f in enumerate(sorted({f for x, _ in data for row in x for f in row}))}
    k, n, sizes = len(LABELS), len(data), np.array([len(y) for _, y in data])
    active = [int((sizes > t).sum()) for t in range(sizes[0])]
    off = np.concatenate([[0], np.cumsum(active)])  # block t of page i is row off[t] + i
    page = np.concatenate([np.arange(m) for m in active])
    cur = np.arange(active[0], off[-1])
    prev = cur - np.repeat(active[:-1], active[1:])
    last = off[sizes - 1] + np.arange(n)
    rows = [data[i][0][t] for t, m in enumerate(active) for i in range(m)]
    y = np.array([data[i][1][t] for t, m in enumerate(active) for i in range(m)])
    at, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([names[f] for r in rows for f in r])
    order = np.argsort(col, kind="stable")
    cuts, row_cuts = np.searchsorted(col[order], np.arange(len(names))), np.searchsorted(at, np.arange(len(rows)))
    by_col = at[order]
    w, tr, gold = np.zeros((len(names), k)), np.zeros((k, k)), np.eye(k)[y]
    gold_tr = np.zeros((k, k))
    np.add.at(gold_tr, (y[prev], y[cur]), 1)
    opt = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]

    def lse(a, axis):
        m = a.max(axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = np.add.reduceat(w[col], row_cuts, axis=0)
        al, be = e.copy(), np.zeros_like(e)
        for t in range(1, len(active)):
            al[off[t] : off[t + 1]] += lse(al[off[t - 1] : off[t - 1] + active[t], :, None] + tr, 1)
        for t in range(len(active) - 2, -1, -1):
            nxt = slice(off[t + 1], off[t + 2])
            be[off[t] : off[t] + active[t + 1]] = lse(tr + (e[nxt] + be[nxt])[:, None, :], 2)
        z = lse(al[last], 1)[page]
        diff = np.exp(al + be - z[:, None]) - gold
        pair = np.exp(al[prev][:, :, None] + tr + (e + be)[cur][:, None, :] - z[cur][:, None, None])
        g = np.add.reduceat(diff[by_col], cuts, axis=0) / n + l2 * w
        gt = (pair.sum(0) - gold_tr) / n + l2 * tr
        for x, d, j in ((w, g, 0), (tr, gt, 2)):
            opt[j] = 0.9 * opt[j] + 0.1 * d
            opt[j + 1] = 0.99 * opt[j + 1] + 0.01 * d * d
            x -= 0.1 * (opt[j] / (1 - 0.9**step)) / (np.sqrt(opt[j + 1] / (1 - 0.99**step)) + 1e-8)
    return Crf({f: w[i] for f, i in names.items()}, tr)


_ENT = {"blank": " ", "hyph": "-"}
_INLINE = [(re.compile(p, re.S), r) for p, r in (
    (r"<!--.*?-->", ""), (r"<ref[^<>]*>.*?</ref>", ""), (r"\{\{[^{}]*\}\}", ""), (r"~?\\cite\{[^{}]*\}", ""), (r"\\footnote\{[^{}]*\}", ""), (r"\[\^\w+\]", ""), (r"</?[A-Za-z][\w:-]*(?:\s[^<>\n]*)?/?>", ""),
    (r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1"), (r"\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1"), (r"'''?", ""), (r"\*\*([^*\n]+)\*\*", r"\1"), (r"~~([^~\n]+)~~", r"\1"), (r"`([^`\n]+)`", r"\1"),
    (r"(?<![\w*])\*(\w[^*\n]*?)\*(?![\w*])", r"\1"), (r"(?<![\w_])_(\w[^_\n]*?)_(?![\w_])", r"\1"), (r"\\(?:emph|text\w\w)\{([^{}]*)\}", r"\1"), (r"\{\\\w+ ([^{}]*)\}", r"\1"), (r"\\([$&%#_{}])", r"\1"),
)]


def _plain(s: str) -> str:
    for p, r in _INLINE:
        s = p.sub(r, s)
    return re.sub(r"[ \t]+", " ", html.unescape(re.sub(r"&(blank|hyph);", lambda m: _ENT[m.group(1)], s))).strip()


def clean(bs: list[Block], labels: list[int], tex: bool = False) -> str:
    """Text with `# ` before headings, `- ` before list items, code and formulas fenced; scripts, styles and comments gone."""
    out: list[str] = []
    for b, y in zip(bs, labels):
        name, s = LABELS[y], b.text.strip()
        if name == "dropped" or b.prefix == "rule" or re.match(r"\\(?:documentclass|usepackage|maketitle)|\[\[Category:", s) or tex and name == "other" and s[0] == "%":
            continue
        if name == "code_block":
            out.append("```\n" + html.unescape(re.sub(r"</?code[^<>]*>", "", b.text.strip("\n"))) + "\n```")
        elif name == "formula":
            out.append("$$" + re.sub(r"^\$|\$$|^\\\(|\\\)$", "", s) + "$$")
        elif name == "heading":
            s = re.sub(r"^#+\s*|^=+\s*|\s*=+$", "", s)
            out.append("# " + _plain(re.sub(r"^\\\w+\*?\{(.*)\}$", r"\1", s)))
        elif name == "list_item":
            out.append("- " + _plain(re.sub(r"^(?:[*+#-]+|\d+[.)])\s+", "", s)))
        else:
            t = _plain(s)
            if t and out and not b.blank and not b.first and not out[-1].startswith(("# ", "- ", "```", "$$")):
                out[-1] += " " + t
            elif t:
                out.append(t)
    return "\n\n".join(out)


def structure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, elems, text_clean) of every text with markup of any kind.

    elems: heading, list_item, code_block and formula in text order; empty if there is none. Null, empty and blank texts
    and texts without markup have no row; repeated rows give repeated rows; other columns are not read. Unclosed or
    stray elements end with the text. Every text is parsed whole into leaf blocks, labelled by the field in one pass.
    """
    kind = docs.schema[key].dataType.simpleString()
    crf = trained()

    def run(batches):
        for b in batches:
            ids, elems, texts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and has_markup(t):
                    bs = blocks(t)
                    labels = crf.decode(features(bs, t)) if bs else []
                    ids.append(i)
                    elems.append([LABELS[y] for y in labels if 0 < y < 5])
                    texts.append(clean(bs, labels, "t" in _style(t)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(elems, pa.list_(pa.string())), pa.array(texts, pa.string())], ["id", "elems", "text_clean"])

    lean = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return lean.mapInArrow(run, f"id {kind}, elems array<string>, text_clean string").withColumnRenamed("id", key)


def numbered(elems: Column) -> Column:
    """An array (elem, elem_no) of an array of elements in text order: numbers count from 1 within each kind. An empty array
    gives (none, 0)."""
    def of(kind: str) -> Column:
        return F.transform(F.filter(elems, lambda x: x == kind), lambda x, i: F.struct(x.alias("elem"), (i + 1).cast("int").alias("elem_no")))

    none = F.array(F.struct(F.lit("none").alias("elem"), F.lit(0).alias("elem_no")))
    return F.when(F.size(elems) == 0, none).otherwise(F.concat(*map(of, LABELS[1:5])))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The elements of the documents with markup, each kind numbered by itself; `none` where there is no element."""
    s = structure(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.explode(numbered(F.col("elems"))).alias("e")).select("doc_id", "e.elem", "e.elem_no")


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of the documents with markup."""
    return structure(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "text_clean")


QUERIES = {"p6_found": p6_found, "p6_text": p6_text}
