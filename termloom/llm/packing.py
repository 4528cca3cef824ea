"""Problem 9: items of varying length in containers of fixed capacity, with little room left."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.llm.encode import FOLDER, encode_corpus
from termloom.operators.skew import number_rows
from termloom.session import table, written


class _Open:
    """Open bins by room left: bins of equal contents are one group [room, bins, contents, capacity]."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.groups: dict[int, list[list]] = {}

    def add(self, g: list) -> None:
        if g[0] not in self.groups:
            insort(self.rooms, g[0])
        self.groups.setdefault(g[0], []).append(g)

    def tightest(self, size: int) -> list | None:
        i = bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        g = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room], self.rooms[i]
        return g


def _fill(room: int, left: dict[int, int], sizes: list[int], first: int) -> int:
    """Tokens a new bin of this room would hold: the item that opens it, then the largest that fit of what is left."""
    used, take = first, {first: 1}
    while True:
        i = bisect_left(sizes, room - used + 1) - 1
        while i >= 0 and left[sizes[i]] <= take.get(sizes[i], 0):
            i -= 1
        if i < 0:
            return used
        s = sizes[i]
        k = min((room - used) // s, left[s] - take.get(s, 0))
        used += k * s
        take[s] = take.get(s, 0) + k


def plan_bins(counts: dict[int, int], lengths: tuple[int, ...], overhead: int = 16) -> list[tuple[int, int, dict[int, int]]]:
    """(capacity, bins, items per bin by size) of a variable-capacity best-fit over how many items have each size.

    Sizes go in falling order; an item goes to the open bin with the least room that holds it. Where none does, a bin is
    opened, of the length that costs least for a token it would hold: (length + overhead) / fill, filled with the
    largest items left that fit. At last each bin gets the smallest length that holds its contents. Equal bins are kept
    as one group, so the work depends on the number of sizes and groups, not of items: at most max(lengths) sizes.
    """
    lengths = tuple(sorted(lengths))
    left = {s: c for s, c in counts.items() if c > 0 and s > 0}
    sizes = sorted(left)
    open_, done = _Open(), []

    def put(g: list, size: int, c: int) -> int:
        room, bins, has, cap = g
        per = room // size
        full, rest = divmod(min(c, per * bins), per)
        if full:
            open_.add([room - per * size, full, has | {size: has.get(size, 0) + per}, cap])
        if rest:
            open_.add([room - rest * size, 1, has | {size: has.get(size, 0) + rest}, cap])
        if bins > full + (rest > 0):
            open_.add([room, bins - full - (rest > 0), has, cap])
        return c - full * per - rest

    for size in reversed(sizes):
        c = left[size]
        while c:
            g = open_.tightest(size)
            if g is None:
                cap = min((x for x in lengths if x >= size), key=lambda x: ((x + overhead) / _fill(x, left | {size: c}, sizes, size), -x))
                g = [cap, -(-c // (cap // size)), {}, cap]
            c = put(g, size, c)
        left[size] = 0
    for room in open_.rooms:
        for _, bins, has, cap in open_.groups[room]:
            used = sum(s * k for s, k in has.items())
            done.append((next(x for x in lengths if x >= used), bins, has))
    return done


def pack(items: DataFrame, key: str, size: str, lengths: tuple[int, ...] = (2048,), overhead: int = 16) -> DataFrame:
    """(container, capacity, key, part, start, n_ids): every item in a container, whole unless larger than the largest length.

    Larger items are cut into parts of the largest length and a rest. Null, zero or negative sizes take no room: one
    row with a null container and capacity, n_ids 0. Repeated rows are items of their own. An empty table gives no rows.

    The number of items of each size (at most max(lengths) rows) is planned on the driver by plan_bins; items are
    numbered within their size by the exact offsets of number_rows, so a size that a third of all items have is spread
    over all tasks, and each finds its container by its number in a table of the plan's intervals.
    """
    cap = max(lengths)
    kind = items.schema[key].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    base = items.select(F.col(key).alias("id"), n.alias("n"))
    parts = base.filter("n > 0").select("id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {cap}"))).alias("part", "k"), "n")
    parts = parts.select("id", "part", (F.col("k") * cap).alias("start"), F.least(F.lit(cap).cast("long"), F.col("n") - F.col("k") * cap).alias("size"))
    laid, offsets = number_rows(parts, ["size"], ["size", "id", "part"])
    counts = {int(r[0]): int(r[1]) for r in offsets.groupBy("size").agg(F.sum("__n")).collect()}  # at most cap rows
    plan = plan_bins(counts, lengths, overhead)
    taken: dict[int, int] = {}
    spans: list[tuple[int, int, int, int, int]] = []  # size, first number, items a bin, first bin, capacity
    at = 1
    for length, bins, has in plan:
        for s, k in has.items():
            spans.append((s, taken.get(s, 0), k, at, length))
            taken[s] = taken.get(s, 0) + k * bins
        at += bins
    spans.sort()
    cols = np.array(spans or [(0, 0, 1, 0, 0)], dtype=np.int64).T
    place = cols[0] * (1 << 50) + cols[1]

    def look(batches):
        for b in batches:
            s, r = (b.column(i).to_numpy() for i in (3, 4))
            i = np.searchsorted(place, s.astype(np.int64) * (1 << 50) + r, side="right") - 1
            bin_ = cols[3][i] + (r - cols[1][i]) // cols[2][i]
            yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(cols[4][i]), *b.columns[:4]], ["container", "capacity", "id", "part", "start", "n_ids"])

    out = f"container bigint, capacity bigint, id {kind}, part int, start bigint, n_ids bigint"
    numbered = laid.join(offsets, ["__file", "size"]).select("id", "part", "start", "size", (F.col("__before") + F.col("__row") - F.col("__first")).alias("number"))
    none = base.filter("n = 0").select(F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("capacity"), "id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), "n")
    return numbered.mapInArrow(look, out).unionByName(none.withColumnRenamed("n", "n_ids")).withColumnRenamed("id", key)


def sized_texts(docs: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, n_ids), written once: the tokenizer runs over every text a single time."""
    return written(encode_corpus(docs, key, text, tokenizer, folder, count=True), "sizes")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of one capacity, 2,048 ids."""
    return pack(sized_texts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_ids", (2048,))


def p9_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Containers of several permitted lengths, each downsized to its contents."""
    return pack(sized_texts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_ids", (512, 1024, 2048))


QUERIES = {"p9_containers": p9_containers, "p9_lengths": p9_lengths}
