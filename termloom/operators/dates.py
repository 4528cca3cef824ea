"""Dates in a token stream, as windows over the tokens of a document instead of a machine with state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: month-day-year in figures, at the end of a token; a fixed value.
FIGURES = r"(1[0-2]|[1-9]|0[1-9])[-/]([0-9]|[0-3][0-9]?)[-/]([0-9]{2}|[0-9]{4})$"
#: Years below 100 up to this are of the 21st century.
CENTURY = 20


def month_of(text: Column) -> Column:
    """1 to 12 for an English month or its first three letters in any case, else null."""
    names = {n.lower(): i + 1 for i, n in enumerate(MONTHS)} | {n[:3].lower(): i + 1 for i, n in enumerate(MONTHS)}
    number = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.lower(text)]
    return F.when(F.length(text).between(3, 9) & F.lower(text).isin(*names), number)  # few tokens get as far as the map


def figures(text: Column) -> Column:
    """MM_DD_YYYY of a token that ends in a date in figures, else null."""
    m, d, y = (F.regexp_extract(text, FIGURES, i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y <= CENTURY, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return F.when((d >= 1) & (d <= 31), F.format_string("%02d_%02d_%04d", m, d, year))


def dates(tokens: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "term", final: str = "final") -> DataFrame:
    """(doc, pos, sub, text, final): the tokens, with dates added and days within dates taken out.

    A month name becomes its full English name. After it a day (1 to 30, with or without st, rd, th) waits for a year: a
    number gives itself and MM_DD_YYYY, another token MM_DD_0000 before itself; at the end of the document it is
    dropped. A month followed by a number that is no day gives the number and MM_00_YYYY. The token after a month is
    never a month itself: of neighbouring month names the first, third and so on begin a date. Final tokens pass.
    """
    t, digits = F.col("__t"), F.col("__t").rlike("[0-9]")  # patterns run only over tokens with a digit
    part = tokens.select(F.col(doc), F.col(pos), F.col(text).alias("__t"), F.col(final).alias("__final"))
    w = W.partitionBy(doc, "__final").orderBy(pos)  # final tokens are apart: they neither are nor part dates
    day = F.regexp_extract(t, r"^(\+?[0-9]+)[thsrd]*$", 1).try_cast("bigint")
    part = part.withColumn("__m", month_of(t)).withColumn("__n", digits & t.rlike(r"^[+-]?[0-9]{1,18}$")).withColumn("__f", F.when(digits & t.rlike("[-/]"), figures(t)))
    part = part.withColumn("__d", F.when(digits, F.when((day >= 1) & (day <= 30), day)))
    # months in a row: the first, third, ... after a token that is none begin a date. All windows have one order.
    part = part.withColumn("__r", F.row_number().over(w))
    gap = F.col("__r") - F.coalesce(F.max(F.when(F.col("__m").isNull(), F.col("__r"))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    part = part.withColumn("__s", F.col("__m").isNotNull() & (gap % 2 == 1))
    for i in (1, 2):
        part = part.withColumn(f"__l{i}", F.lag(F.struct("__m", "__s", "__d"), i).over(w))
    part = part.select("*", F.col("__l1.__m").alias("__m1"), F.col("__l1.__s").alias("__s1"), F.col("__l1.__d").alias("__d1"), F.col("__l2.__m").alias("__m2"), F.col("__l2.__s").alias("__s2"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    dated = yes("__s2") & F.col("__d1").isNotNull()  # a day stands before this token, a month before that
    one = lambda x, f: F.struct(x.alias("text"), F.lit(f).alias("final"))
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("__m"))
    number = t.try_cast("bigint")
    begin = F.when(yes("__s1"), F.array(one(t, False))).when(F.col("__f").isNotNull(), F.array(one(F.col("__f"), True))).when(F.col("__s"), F.array(one(name, True))).otherwise(F.array(one(t, False)))
    full = F.format_string("%02d_%02d_%04d", F.col("__m2"), F.col("__d1"), number)
    open_ = F.format_string("%02d_%02d_0000", F.col("__m2"), F.col("__d1"))
    out = (
        F.when(F.col("__final"), F.array(one(t, True)))
        .when(dated & F.col("__n"), F.array(one(t, False), one(full, True)))
        .when(dated, F.concat(F.array(one(open_, True)), begin))
        .when(yes("__s1") & F.col("__d").isNotNull(), F.filter(F.array(one(t, False)), lambda x: F.lit(False)))
        .when(yes("__s1") & F.col("__n"), F.array(one(t, False), one(F.format_string("%02d_00_%04d", F.col("__m1"), number), True)))
        .otherwise(begin)
    )
    return part.select(doc, pos, F.posexplode(out).alias("sub", "t")).select(doc, pos, "sub", F.col("t.text").alias(text), F.col("t.final").alias(final))
