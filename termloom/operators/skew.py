"""Per-key results without imbalance: exact offset chunking and bounded hot-key splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from termloom.session import parallelism, written

#: Names the operators add while they work; input columns of these names are never read by them.
_FILE, _ROW = "__file", "__row"


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def with_key_stat(rows: DataFrame, stat: DataFrame, key: str, weight: str, max_hot: int = 1000) -> DataFrame:
    """rows joined with one stat row per key, hot keys apart.

    A key is hot if its weight is at least 1/max_hot of all weight, so there are at most max_hot hot keys: only those
    are broadcast, whatever the size of the data. All other keys go through an ordinary join, in which none of them can
    hold more than 1/max_hot of the rows. Null keys find no partner.
    """
    total = stat.agg(F.sum(weight)).scalar()
    hot = F.broadcast(stat.filter(F.col(weight) * F.lit(max_hot) >= total))
    cold = stat.filter(F.col(weight) * F.lit(max_hot) < total)
    a = rows.join(hot, key)
    b = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return a.unionByName(b)


def small_enough(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table may be broadcast: it has at most so many rows. Reads no more than those."""
    return df.limit(rows + 1).count() <= rows


def without(rows: DataFrame, other: DataFrame, key: str, unless: Column | None = None, most: int = 100_000) -> DataFrame:
    """rows whose key isn't among those of `other`, and those for which `unless` holds. `other` is broadcast if it has at most
    `most` keys; else the join splits skewed partitions at run time, as it does for a left side. Null keys stay."""
    keys = other.select(F.col(key).alias("__key")).filter(F.col(key).isNotNull()).distinct().withColumn("__there", F.lit(True))
    keys = F.broadcast(keys) if small_enough(keys, most) else keys
    there = F.coalesce(F.col("__there"), F.lit(False))
    kept = rows.join(keys, F.col(key) == F.col("__key"), "left").filter(~there if unless is None else unless | ~there)
    return kept.drop("__key", "__there")


def salted_join(many: DataFrame, few: DataFrame, key: str, spread: Column, salts: int = 16, most: int = 100_000, bound: DataFrame | None = None) -> DataFrame:
    """many and few joined by key, where a key may hold a large part of `many`. `few` is broadcast if it, or a table `bound` that
    has no fewer rows and is cheaper to count, has at most `most` rows; else the rows of a key are spread over `salts` tasks by `spread`, and `few` is repeated as often."""
    if small_enough(few if bound is None else bound, most):
        return many.join(F.broadcast(few), key)
    a = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    b = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [key, "__salt"]).drop("__salt")


def number_rows(rows: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Number the rows of every key from 0 in the given order, without a window over a whole key.

    Rows are ordered over all partitions and written to the shared folder; a row's number is the rows of its key in
    earlier partitions (prefix sum) plus its place among the key's rows in its own. Both come from the written files, so
    a task that is run again gives the same numbers. Returns the written rows with `__file` and `__row`, and the offsets
    (`__file`, keys, `__n`, `__first`, `__before`): number = __before + __row - __first.

    Rows that are equal in keys and order get different numbers, in no defined order among them; they lie in one
    partition, so the order should tell rows apart. Null keys are keys.
    """
    slices = slices or parallelism(rows.sparkSession)
    laid = written(rows.repartitionByRange(slices, *order).sortWithinPartitions(*keys, *order), "numbered")
    laid = laid.select("*", F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
    per = laid.groupBy(_FILE, *keys).agg(F.count("*").alias("__n"), F.min(_ROW).alias("__first"))
    w = W.partitionBy(*keys).orderBy(_FILE).rowsBetween(W.unboundedPreceding, -1)
    return laid, per.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))


def chunked(rows: DataFrame, keys: list[str], order: list[str], chunk_rows: int | None = None, slices: int | None = None) -> DataFrame:
    """rows with `chunk`: row number within the key div chunk_rows, so no (key, chunk) has more than chunk_rows rows.

    Keys of at most chunk_rows rows have chunk 0 without numbering; the others, at most rows/chunk_rows of them, are
    numbered by number_rows. chunk_rows defaults to a share of all rows: total / (8 * slices), 10,000 at least.
    An empty input gives an empty result. Input columns named chunk are replaced.
    """
    n_slices = slices or parallelism(rows.sparkSession)
    laid, offsets = number_rows(rows, keys, order, n_slices)
    if chunk_rows is None:
        n = laid.count()
        chunk_rows = max(10_000, n // (8 * n_slices))
    sizes = offsets.groupBy(*keys).agg(F.sum("__n").alias("__size")).filter(F.col("__size") > chunk_rows)
    hot = sizes.select(*keys)
    hot = F.broadcast(hot) if small_enough(hot) else hot  # at most rows / chunk_rows keys, by default a multiple of the slices
    out = [c for c in rows.columns if c != "chunk"]
    plain = laid.alias("l").join(hot.alias("h"), _same(keys, "l", "h"), "left_anti").select(*out, F.lit(0).cast("long").alias("chunk"))
    part = laid.alias("l").join(hot.alias("h"), _same(keys, "l", "h"), "left_semi")
    number = F.col("o.__before") - F.col("o.__first") + F.col(f"l.{_ROW}")
    off = offsets.alias("o").join(hot.alias("h"), _same(keys, "o", "h"), "left_semi")
    many = (
        part.alias("l")
        .join(off.alias("o"), (F.col(f"l.{_FILE}") == F.col(f"o.{_FILE}")) & _same(keys, "l", "o"))
        .select(*[F.col(f"l.{c}") for c in out], F.floor(number / chunk_rows).cast("long").alias("chunk"))
    )
    return plain.unionByName(many)


def chunk_states(chunks: DataFrame, keys: list[str], order: list[str], distinct: str | None = None) -> DataFrame:
    """One state per (keys, chunk): rows, first and last of the order, and the runs of `distinct` (the leading order column)."""
    place = F.struct(*[F.col(c) for c in order])
    if distinct:
        w = W.partitionBy(*keys, "chunk").orderBy(*order)  # bounded: a chunk's rows
        before = F.lag(F.struct(distinct)).over(w)
        chunks = chunks.withColumn("__new", (before.isNull() | ~before[distinct].eqNullSafe(F.col(distinct))).cast("long"))
    aggs = [F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")]
    return chunks.groupBy(*keys, "chunk").agg(*aggs, *([F.sum("__new").alias("runs")] if distinct else []))


def merge_states(states: DataFrame, keys: list[str], distinct: str | None = None) -> DataFrame:
    """Merge ordered chunk states: sizes add up, and a run that goes on over a chunk's border counts once."""
    aggs = [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("chunks")]
    if distinct:
        w = W.partitionBy(*keys).orderBy("chunk")  # chunks of a key: rows of the key / chunk_rows
        over = F.lag("last").over(w)
        states = states.withColumn("__joined", F.coalesce((over[distinct].eqNullSafe(F.col("first")[distinct]) & over.isNotNull()).cast("long"), F.lit(0)))
        aggs.append((F.sum("runs") - F.sum("__joined")).alias("runs"))
    return states.groupBy(*keys).agg(*aggs)


def key_sizes(rows: DataFrame, keys: list[str], order: list[str], distinct: str | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Per key: n rows, first and last place, chunks, and with `distinct` the number of its distinct values (`runs`).

    `distinct` must lead `order`. Null keys form a key. Repeated rows count as often as they come. An empty table gives
    no rows. Other columns of the input are not read.
    """
    if distinct and order[0] != distinct:
        raise ValueError("the column counted must lead the order")
    lean = rows.select(*dict.fromkeys([*keys, *order]))
    return merge_states(chunk_states(chunked(lean, keys, order, chunk_rows), keys, order, distinct), keys, distinct)


def process_chunks(rows: DataFrame, keys: list[str], order: list[str], fn, schema: str, chunk_rows: int | None = None) -> DataFrame:
    """fn(pandas frame of one chunk, in order) for every (keys, chunk): no call sees more than chunk_rows rows."""

    def run(pdf):
        return fn(pdf.sort_values(order, kind="stable"))

    return chunked(rows, keys, order, chunk_rows).groupBy(*keys, "chunk").applyInPandas(run, schema)
