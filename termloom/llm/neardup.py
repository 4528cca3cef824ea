"""Problem 2: pairs of records with almost the same content, by a chosen-path set similarity join."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.operators.skew import small_enough
from termloom.session import discard, table, written

WORDS = re.compile(r"[^\W_]+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str | None], words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct hashed runs of `words` words of every text, sorted; none if it has under `least` words."""
    lists = [WORDS.findall(t.lower()) if t else [] for t in texts]
    lists = [x if len(x) >= max(least, words) else [] for x in lists]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    flat = np.array([w for x in lists for w in x], dtype=object)
    codes, names = pd.factorize(flat)
    h = pd.util.hash_array(names.astype(object), categorize=False)[codes]
    doc = np.repeat(np.arange(len(texts)), sizes)
    runs = h[: len(h) - words + 1].copy()
    for i in range(1, words):
        runs = _mix(runs) + h[i : len(h) - words + 1 + i]
    runs = _mix(runs)
    whole = doc[: len(runs)] == doc[words - 1 :]
    runs, doc = runs[whole], doc[: len(runs)][whole]
    stops = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
    at = 0
    for stop in stops:
        runs[at:stop].sort()
        at = stop
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    runs, doc = runs[new], doc[new]
    return runs, np.cumsum(np.bincount(doc, minlength=len(texts)))


def _slices(b: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[tuple[pa.Array, list]]:
    """A batch in slices of bounded text."""
    texts, at, n = b.column(1).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= chars or i + 1 == len(texts):
            yield b.column(0).slice(at, i + 1 - at), texts[at : i + 1]
            at, n = i + 1, 0


def _sketches(batches, words: int, least: int, width: int):
    rng = np.random.default_rng(20)
    mul, add = (rng.integers(0, 1 << 31, width, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    for b in batches:
        for ids, texts in _slices(b):
            runs, ends = shingles(texts, words, least)
            begins = np.concatenate([[0], ends[:-1]])
            has = np.flatnonzero(ends > begins)
            if not len(has):
                continue
            at = begins[has]
            low, top = np.empty((width, len(has)), np.uint32), (runs >> _U(32)).astype(np.uint32)
            hashed = np.empty_like(top)
            for j in range(width):
                np.multiply(top, mul[j], out=hashed)
                np.add(hashed, add[j], out=hashed)
                np.minimum.reduceat(hashed, at, out=low[j])
            low = (low.T * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
            k1, k2 = np.add.reduceat(_mix(runs), at), np.add.reduceat(_mix(runs ^ _U(0x9E3779B97F4A7C15)), at)
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * width), len(has), [None, pa.py_buffer(low.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(has)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array((ends - begins)[has].astype(np.int32)), sketch], ["id", "k1", "k2", "n", "sketch"]
            )


def _grid(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), -1)


def _children(node: np.ndarray, sketch: np.ndarray, branches: int) -> np.ndarray:
    """The children (rows, branches) of a node for each row: a node picks distinct places of the sketch by its own hash,
    and a row goes to the child named by its minwise token there."""
    width, rows = sketch.shape[1], np.arange(len(node))
    out, step = np.empty((len(node), branches), _U), _mix(node ^ _U(0xD6E8FEB86659FD93))
    first = step % _U(width)
    for i in range(branches):  # distinct places: steps of an odd part of the width
        place = (first + _U(i) * ((step >> _U(32)) % _U(width // branches) + _U(1))) % _U(width)
        out[:, i] = _mix(_mix(node + place + _U(1)) + sketch[rows, place.astype(np.int64)].astype(_U))
    return out


def missed(similarity: float, trees: int, branches: int, level: int, width: int) -> float:
    """The share of pairs of a similarity that meet in no node of `level` of any tree; the places of a sketch in which two
    sets agree vary around their similarity, so it is the mean over them."""
    out = 0.0
    for k in range(width + 1):
        meet = 1.0
        for _ in range(level):
            meet = 1 - (1 - k / width * meet) ** branches
        out += comb(width, k) * similarity**k * (1 - similarity) ** (width - k) * (1 - meet) ** trees
    return out


def trees_for(similarity: float, least: int, branches: int, level: int, width: int, miss: float) -> int:
    """Trees (`least` at least) of which nodes of `level` miss at most `miss` of the pairs of a similarity."""
    n = least
    while missed(similarity, n, branches, level, width) > miss:
        n += 1
    return n


def _start(batches, first: int, trees: int, branches: int, depth: int):
    """Rows of the trees from `first` to before `trees`."""
    for b in batches:
        sketch = _grid(b.column(1))
        if not len(sketch):
            continue
        nodes = np.repeat(_mix(np.arange(first + 1, trees + 1, dtype=_U) * _U(0xA24BAED4963EE407))[None, :], len(sketch), 0).reshape(-1)
        each = trees - first
        for _ in range(depth):
            nodes = _children(nodes, np.repeat(sketch, each, 0), branches).reshape(-1)
            each *= branches
        yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(sketch)), each)))], ["node", "rep"])


def _deeper(batches, branches: int):
    for b in batches:
        if b.num_rows:
            kids = _children(b.column(0).to_numpy().view(_U), _grid(b.column(2)), branches).reshape(-1)
            from_ = pa.array(np.repeat(np.arange(b.num_rows), branches))
            yield pa.RecordBatch.from_arrays([pa.array(kids.view(np.int64)), b.column(1).take(from_), b.column(3).take(from_)], ["node", "rep", "above"])


def _alike(a: str, b: str, width: int, least: int):
    """Whether two sketches agree in at least `least` places."""

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), width) for s in (x, y))
        return pd.Series((p == q).sum(1) >= least)

    return agree(a, b)


def _counted(rows: DataFrame, hot: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(rows, table to discard once they are written): rows of nodes that hold two at least, with their size; counts combine before the shuffle. The counts are hashed, so
    the rows, many times as many, need no sort. Rows of nodes of over `hot` rows (so at most rows / hot nodes), as boilerplate
    makes them, don't move to one task: the counts of those nodes go to them."""
    sizes = written(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    large = sizes.filter(F.col("size") > hot)
    if large.isEmpty() or not small_enough(large):
        return rows.join(sizes.hint("shuffle_hash"), "node"), sizes
    cold = rows.join(F.broadcast(large.select("node")), "node", "left_anti").join(sizes.filter(F.col("size") <= hot).hint("shuffle_hash"), "node")
    return rows.join(F.broadcast(large), "node").unionByName(cold), sizes


def candidate_pairs(reps: DataFrame, kind: str, trees: list[int], branches: int, depth: int, leaf: int, most: int, block: int = 256) -> DataFrame:
    """(a, b): distinct pairs that share a leaf of some tree.

    Nodes of up to `leaf` rows are compared exhaustively; larger ones branch on. A node that is hardly smaller than the one
    above it (0.7 of its rows or more), or still large at the deepest level `most`, holds rows that agree in most tokens:
    it is cut into blocks of about `block` rows by a hash and every pair of blocks is compared, so nothing is lost, no task
    sees more than two blocks, and a large group of near copies doesn't branch down to the deepest level.

    trees: the number for each level from `depth` to `most`, not falling. Every row has those of `depth`; a row of which
    some node branches on to a level has the trees of that level too. Two rows that don't both have them were only ever
    together in nodes that ended before it.
    """
    schema = f"node bigint, rep {kind}"
    leaves: list[DataFrame] = []

    def settled(rows: DataFrame, level: int, name: str) -> DataFrame:
        """The rows of nodes that branch on; all others go to the leaves."""
        rows, sizes = _counted(rows)
        rows = written(rows, name)
        discard(sizes)
        large = F.col("size") > leaf
        dense = large & (F.lit(level == most) | F.coalesce(F.col("size") >= 0.7 * F.col("above"), F.lit(False)))
        blocks = F.when(dense, F.ceil(F.col("size") / block)).otherwise(1).cast("int")
        mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        sides = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), F.when(mine == j, 0).when(mine < j, 1).otherwise(2).alias("side")))
        cut = rows.filter(dense).select("node", "rep", F.explode(sides).alias("p")).select(F.xxhash64("node", "p.i", "p.j").alias("node"), "rep", "p.side")
        leaves.append(rows.filter(~large).select("node", "rep", F.lit(0).alias("side")).unionByName(cut))
        return rows.filter(large & ~dense)

    def started(some: DataFrame, first: int, to: int) -> DataFrame:
        return some.select("rep", "sketch").mapInArrow(lambda b: _start(b, first, to, branches, depth), schema).withColumn("above", F.lit(None).cast("long"))

    def deeper(big: DataFrame) -> DataFrame:
        return big.join(reps.select("rep", "sketch"), "rep").select("node", "rep", "sketch", "size").mapInArrow(lambda b: _deeper(b, branches), schema + ", above bigint")

    big = settled(started(reps, 0, trees[0]), depth, f"nodes{depth}")
    for level in range(depth + 1, most + 1):
        if big.isEmpty():
            break
        first, to = trees[level - 1 - depth], trees[level - depth]
        if to > first:
            more = started(reps.join(big.select("rep").distinct(), "rep", "left_semi"), first, to)
            for i in range(depth, level):
                more = settled(more if i == depth else deeper(more), i, f"nodes{i}of{level}")
            big = big.unionByName(more)
        big = settled(deeper(big), level, f"nodes{level}")
    groups = reduce(DataFrame.unionByName, leaves).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rep", "side"))).alias("g"))  # a leaf, or two blocks at most
    each = groups.select("g", F.posexplode("g").alias("i", "a")).select("a", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("b"))
    each = each.filter("a.rep < b.rep AND (a.side = 0 OR a.side <> b.side)").select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    return each.groupBy("a", "b").agg(F.count("*").alias("shared"))


def near_duplicates(
    docs: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.8, least_words: int = 0,
    trees: int = 8, branches: int = 2, depth: int = 2, leaf: int = 24, most: int = 8, width: int = 64, miss: float = 0.0025,
) -> tuple[DataFrame, DataFrame]:
    """(links, classes): a chosen-path set similarity join over sets of runs of `words` words.

    links: (a, b, similarity), a < b, pairs of representatives of different sets with exact Jaccard similarity of at
    least `threshold`. classes: (key, rep), every document that takes part with the least key among those of an equal
    set. Texts with under max(words, least_words) words, null and empty ones take part in nothing. Repeated rows count
    once; a key must not have different texts (rows with a null key are left out). Empty tables give empty results. Words are runs of letters and digits of the lower-cased text.

    Every set gets `width` minwise tokens. Independent trees branch each node `branches` ways by tokens at places its
    hash picks, from `depth` levels on until a node has at most `leaf` rows. A pair meets the seldomer the deeper its
    nodes go (at similarity 0.5 in a tree of 2, 4, 8 levels with probability 0.61, 0.45, 0.30, and less where its
    sketches happen to agree less), so each level has the trees by which pairs at the threshold are missed at a rate of
    `miss` at most (`trees` at least): at 0.5 8, 17, 69 at 2, 4, 8 levels; pairs above it are missed less. Pairs
    whose sketches agree too little for the threshold (4 standard deviations below) go before the exact check.
    """
    kind = docs.schema[key].dataType.simpleString()
    lean = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    sketched = lean.mapInArrow(lambda b: _sketches(b, words, least_words, width), f"id {kind}, k1 bigint, k2 bigint, n int, sketch binary")
    sketched = written(sketched, "sketches")
    sets = ["k1", "k2", "n"]
    reps = written(sketched.groupBy(*sets).agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "reps")
    classes = written(sketched.select("id", *sets).join(reps.select(*sets, "rep"), sets).select("id", "rep").distinct(), "classes")
    discard(sketched)
    lowest = max(1, int(width * threshold - 4 * (width * threshold * (1 - threshold)) ** 0.5))
    # n bounds similarity by the ratio of sizes
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    by_level = [trees_for(threshold, trees, branches, level, width, miss) for level in range(depth, most + 1)]
    pairs = candidate_pairs(reps, kind, by_level, branches, depth, leaf, most).select("a", "b")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold)
    pairs = written(pairs.filter(_alike("s_a", "s_b", width, lowest)).select("a", "b"), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def hashes(batches):
        for b in batches:
            for ids, texts in _slices(b):
                runs, stop = shingles(texts, words, least_words)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(runs.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, lists], ["id", "runs"])

    full = lean.join(ends, "id", "left_semi").mapInArrow(hashes, f"id {kind}, runs array<bigint>")
    of = lambda c: full.select(F.col("id").alias(c), F.col("runs").alias(f"r_{c}"))
    both = F.size(F.array_intersect("r_a", "r_b"))
    checked = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", both.alias("both"), (F.size("r_a") + F.size("r_b")).alias("sum"))
    links = checked.filter(F.col("both") >= F.lit(threshold) * (F.col("sum") - F.col("both")))
    links = links.select("a", "b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))
    return written(links, "links"), classes.withColumnRenamed("id", key)


def document_pairs(links: DataFrame, classes: DataFrame, key: str, copies: int = 1_000) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: links and equal sets, as pairs of documents.

    Classes of over `copies` equal documents come as pairs of each with the representative, and links of such classes
    as the pair of representatives: together with the membership that loses no link between different texts.
    """
    m = classes.select(F.col(key).alias("id"), "rep")
    sizes = m.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1")
    small = m.join(sizes.filter(F.col("k") <= copies).select("rep"), "rep")
    inside = small.alias("x").join(small.alias("y"), "rep").filter("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    star = m.join(sizes.filter(F.col("k") > copies).select("rep"), "rep").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    spread = m.join(sizes.filter(F.col("k") > copies).select("rep"), "rep", "left_anti").unionByName(sizes.filter(F.col("k") > copies).select(F.col("rep").alias("id"), "rep"))
    x, y = (spread.select(F.col("rep").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    between = links.select("a", "b").join(x, "a").join(y, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    out = between.unionByName(inside).unionByName(star)
    return out.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links, classes = near_duplicates(table(spark, d, "documents"), "doc_id", "text", words=3, threshold=0.5, least_words=20)
    return document_pairs(links, classes, "doc_id")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: the representative of its equal set and the set's links, five words and 0.8."""
    links, classes = near_duplicates(table(spark, d, "documents"), "doc_id", "text")
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return classes.join(ends, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes}


def _sets_sql(words: int, least: int) -> str:
    """The distinct runs of words of every document that takes part."""
    run = " || ' ' || ".join(f"l[i + {k}]" if k else "l[i]" for k in range(words))
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(l) - {words - 1}), lambda i: {run})) AS sh FROM w WHERE len(l) >= {least}),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, ',' ORDER BY sh)) AS whole FROM s GROUP BY doc_id)"""


#: For the small tables: all documents that share a run are compared.
SQL = {
    "p2_found": f"""{_sets_sql(3, 20)}, c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL)
SELECT a AS doc_id_a, b AS doc_id_b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.5 * (x.n + y.n - k)""",
    "p2_classes": f"""{_sets_sql(5, 5)}, cl AS (SELECT *, min(doc_id) OVER (PARTITION BY whole) AS rep FROM n), r AS (SELECT s.* FROM s JOIN cl USING (doc_id) WHERE doc_id = rep),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM r a JOIN r b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, count(*) AS n_links FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) GROUP BY a)
SELECT doc_id, rep AS class_id, coalesce(n_links, 0) AS n_links FROM cl LEFT JOIN links ON a = rep""",
}
