"""Tokenising texts without markup as column expressions, and the registry of token filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Runs a word may be part of; what is cut from their ends. Java and RE2 read these classes alike.
RUN = r"[\p{L}\p{Nd}\p{S}\p{P}]+"
LEAD = r"^[\p{P}`]+"
TRAIL = r"[\p{Pc}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\p{Sm}\p{Sk}\p{So}]+$"


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def core(run: Column) -> Column:
    """A run without the punctuation it begins with and the signs it ends with (letters, digits, dashes and currency stay)."""
    return F.regexp_replace(F.regexp_replace(run, LEAD, ""), TRAIL, "")


def term(run: Column) -> Column:
    """`(` within a word turns to `-`; `'` and `)` vanish."""
    return F.translate(core(run), "(')", "-")


def native_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term): tokens of texts read as plain text, pos from 1. Null and empty texts have none."""
    words = F.filter(F.transform(runs(F.col(text)), term), lambda x: x != "")
    return docs.select(key, F.posexplode(words).alias("pos", "term")).withColumn("pos", F.col("pos") + 1)


def phrase_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term, seg): tokens with the number of phrase breaks before them.

    A break comes before a token whose run began with punctuation, and after one whose cut end has a sign other than `'`.
    A run that is dropped whole breaks too.
    """
    r = docs.select(key, F.posexplode(runs(F.col(text))).alias("i", "run"))
    body = F.regexp_replace("run", LEAD, "")
    tail = F.expr("substring(body, length(core) + 1)")
    r = r.withColumn("body", body).withColumn("core", F.regexp_replace("body", TRAIL, "")).withColumn("term", F.translate("core", "(')", "-"))
    gone = F.col("term") == ""
    before = (F.length("run") > F.length("body")).cast("int")
    after = (gone | (F.regexp_replace(tail, "'", "") != "")).cast("int")
    w = W.partitionBy(key).orderBy("i")
    seg = F.sum(before).over(w) + F.coalesce(F.sum(after).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = r.withColumn("seg", seg.cast("long")).filter(~gone)
    return kept.select(key, F.row_number().over(w).alias("pos"), "term", "seg")


# A filter takes the text of a token that is not final and gives the list of tokens it becomes: (text, final).
Filter = Callable[[Column], Column]
REGISTRY: dict[str, Filter] = {}
#: Filters that also see final tokens, and keep them final.
SEES_FINAL = {"lower", "null"}
#: Filters that do nothing to a word of ASCII letters alone but write it in lower case; most tokens are such words.
LEAVE_LETTERS = {"digits", "hyphens", "slashes", "acronyms", "filename", "lower", "null"}
DEFAULT_CHAIN = ["digits", "dates", "hyphens", "slashes", "acronyms", "filename", "lower"]


def register(name: str) -> Callable[[Filter], Filter]:
    def put(f: Filter) -> Filter:
        REGISTRY[name] = f
        return f

    return put


def tok(text: Column, final: bool | Column) -> Column:
    return F.struct(text.alias("text"), (F.lit(final) if isinstance(final, bool) else final).alias("final"))


def _one(text: Column, final: bool | Column) -> Column:
    return F.array(tok(text, final))


@register("digits")
def digits(t: Column) -> Column:
    """Thousands separators go from well-formed numbers; a fraction that is zero goes too. A changed token is final."""
    whole = F.regexp_replace(F.regexp_extract(t, r"^([0-9,]+)", 1), ",", "")
    part = F.regexp_extract(t, r"\.([0-9]+)$", 1)
    new = F.when(F.coalesce(part.try_cast("bigint"), F.lit(0)) > 0, F.concat(whole, F.lit("."), part)).otherwise(whole)
    return F.when(t.rlike(r"^[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?$"), _one(new, new != t)).otherwise(_one(t, False))


#: Word beginnings that are no words of their own; fixed values.
PREFIXES = ["anti", "co", "de", "hyper", "hypo", "infra", "intra", "macro", "micro", "non", "pre", "pseudo", "re", "semi", "sub", "supra", "trans", "un"]
#: Characters with the Unicode property Hyphen.
HYPHENS = r"[\x{2D}\x{AD}\x{58A}\x{1806}\x{2010}\x{2011}\x{2E17}\x{30FB}\x{FE63}\x{FF0D}\x{FF65}]"


#: Letters, a hyphen and digits, and the other way round; words with capitals parted by points. Fixed values.
LETTERS_DIGITS, DIGITS_LETTERS = r"^([A-z]+)-([0-9]+)$", r"^([0-9]+)-([A-z]+)$"
ACRONYM = r"[A-Z][a-z]*(?:\.[A-Z][a-z]*)+"


@register("hyphens")
def hyphens(t: Column) -> Column:
    """Letters and digits on two sides join (with the letters apart if three or more); words split, or join after a prefix."""
    a1, n1 = (F.regexp_extract(t, LETTERS_DIGITS, i) for i in (1, 2))
    n2, a2 = (F.regexp_extract(t, DIGITS_LETTERS, i) for i in (1, 2))
    both = lambda x, y, z: F.when(F.length(z) >= 3, F.array(tok(F.concat(x, y), True), tok(z, True))).otherwise(_one(F.concat(x, y), True))
    parts = F.filter(F.split(t, HYPHENS), lambda x: x != "")
    joined = tok(F.array_join(parts, ""), True)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    two = F.when(first.isin(PREFIXES), F.array(joined, tok(second, True))).otherwise(F.array(tok(first, True), tok(second, True)))
    more = F.concat(F.transform(parts, lambda x: tok(x, True)), F.array(joined))
    return F.when(a1 != "", both(a1, n1, a1)).when(n2 != "", both(n2, a2, a2)).when(t.rlike(r"\p{Nd}"), _one(t, False)).when(F.size(parts) == 1, _one(t, False)).when(F.size(parts) == 2, two).otherwise(more)


@register("slashes")
def slashes(t: Column) -> Column:
    parts = F.split(t, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(parts, lambda x: tok(x, True))).otherwise(_one(t, False))


@register("acronyms")
def acronyms(t: Column) -> Column:
    return F.when(t.rlike(ACRONYM), _one(F.lower(F.translate(t, ".", "")), True)).otherwise(_one(t, False))


#: Known file name extensions; fixed values.
EXTENSIONS = "aiff aif au avi bat bmp class java csk cvs dbf dif doc docx eps exe fm gif hqx htm html jpg mac map mdb mid midi mov qt mtb mtw pdf p t png ppt psd psp qxd ra sit tar tif txt wav xls xlsx zip".split()


@register("filename")
def filename(t: Column) -> Column:
    """The stem of a file name without its dots, then the name."""
    stem = F.translate(F.regexp_extract(t, r"^(.*)\.[^.]*$", 1), ".", "")
    known = t.contains(".") & F.substring_index(t, ".", -1).isin(EXTENSIONS)
    return F.when(known, F.array(tok(stem, True), tok(t, False))).otherwise(_one(t, False))


@register("lower")
def lower(t: Column) -> Column:
    return _one(F.lower(t), False)


@register("null")
def null(t: Column) -> Column:
    return _one(t, False)


def _step(f: Filter, sees_final: bool) -> Callable[[Column], Column]:
    if sees_final:
        return lambda x: F.transform(f(x["text"]), lambda y: tok(y["text"], x["final"]))
    return lambda x: F.when(x["final"], F.array(x)).otherwise(f(x["text"]))


def apply_filters(tokens: Column, names: list[str]) -> Column:
    """An array of (text, final) run through filters; final tokens pass by all but those that see them."""
    for n in names:
        tokens = F.flatten(F.transform(tokens, _step(REGISTRY[n], n in SEES_FINAL)))
    return tokens


def vocabulary_filter(terms: DataFrame, names: list[str], col: str = "term") -> DataFrame:
    """(term, sub, text, final) for every distinct term: filters without state depend on the text alone, so they run once
    per distinct text, not once per token."""
    out = apply_filters(_one(F.col(col), False), names)
    return terms.select(col).distinct().select(col, F.posexplode(out).alias("sub", "t")).select(col, "sub", "t.text", "t.final")
