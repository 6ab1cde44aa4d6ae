"""MinHash near-dedup with min-max hashing.

Under each permutation of the hashed shingles both the least and the greatest value are kept: a signature of 2 * PERMUTATIONS
values for PERMUTATIONS evaluations a shingle, each value agreeing with probability J, with less variance than as many minima. The
values are banded (32 bands of 6 for J = 0.85, 38 of 5 for 0.8), so that a pair at the threshold is missed with a chance of about 3 in 10 million. What shares a bucket is compared by the whole signature, a byte of each value, and belongs to
one coarse group if the estimate of J comes within DEVIATIONS of its error to the threshold, so that chains of loosely similar texts, which meet in buckets by chance, do not grow together. Inside
coarse groups pairs are confirmed on their full sets, so that links come from exact Jaccard similarity alone.

Texts with equal sets are one class with one representative, so exact copies cost nothing further. A coarse group that one task
can hold is one block; a larger one is cut into cells by set size (sets whose sizes differ by more than the threshold
allows cannot link) and hash, and each pair of cells that may hold links is a block. A block yields a spanning forest of its links,
never all pairs. No bucket, group or partner count is capped.

A bucket of any size is cut into cells and pairs of cells likewise; buckets with the same members are looked at once. Within a task a signature is compared only
with those that are not yet in its group, so that a large group of near copies costs little more than its size.

A very long text is one set in a task's memory, 8 bytes a shingle. Null, empty and blank texts have empty sets and link with nothing. Rows with one id are one document and share its result. A row without an
id gets its class's component. Only the id and the text are read, so that other columns cannot clash. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import lean, perhaps_in, table, written
from tidewell.llm.components import components

PERMUTATIONS, MOST_MISSED = 96, 1e-6
#: For contracts that state none: five words and 0.8.
SHINGLE, PERCENT = 5, 80
ROWS = 256
CACHED, CACHED_BYTES = 200_000, 64
#: Documents and shingles in a cell of a block, at most, about.
CELL, CELL_SHINGLES = 512, 1_000_000
#: Signatures in a cell of a bucket, at most, about; how many standard errors an estimate may lie below the threshold.
SIGNATURES, DEVIATIONS = 4096, 6
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
S = np.uint64(32)


class Words(dict):
    """Hashes of words, kept for short ones."""

    def __missing__(self, word: bytes) -> int:
        if len(word) > CACHED_BYTES:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) > CACHED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S)) * M3
    x = (x ^ (x >> S)) * M2
    return x ^ (x >> S)


def shingles(text: str | None, width: int, hashes: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z in lower case, split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    out = h[: n - width + 1].copy()
    for k in range(1, width):
        out = mixed(out * M1 + h[k : n - width + 1 + k])
    return np.unique(mixed(out))


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1024) -> np.ndarray:
    """The minima, then the maxima, of a * x + b."""
    low, high = None, None
    for at in range(0, len(x), step):
        y = a * x[None, at : at + step] + b
        lo, hi = y.min(axis=1), y.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.concatenate([low, high])


def spread(values: np.ndarray | None) -> np.ndarray | None:
    return None if values is None else mixed(values)


def banding(percent: int) -> tuple[int, int]:
    """Bands and values in each: as long as they may be for a pair at the threshold to be missed with a chance of MOST_MISSED at most."""
    j = percent / 100
    missed = lambda size: (1 - j**size) ** (2 * PERMUTATIONS // size)
    size = max((k for k in range(1, 2 * PERMUTATIONS + 1) if missed(k) <= MOST_MISSED), default=1)
    return 2 * PERMUTATIONS // size, size


def bands(values: np.ndarray, number: int, size: int) -> np.ndarray:
    grid = values[: number * size].reshape(number, size)
    out = np.arange(1, number + 1, dtype=np.uint64) * M1
    for k in range(size):
        out = mixed(out * M2 + grid[:, k])
    return out.view(np.int64)


def least_size(percent: int) -> int:
    """The smallest union of two different sets that may link, less one."""
    return next(n for n in range(1, 102) if 100 * n >= percent * (n + 1))


def sketches(docs: DataFrame, id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """id, n (set size), key (a digest of the set; null if empty), buckets and signature (a byte of each value) of every row."""
    least, (number, size) = least_size(percent), banding(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        a, b = permutations(PERMUTATIONS)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sets = [shingles(x, width, words) for x in batch.column(1).to_pylist()]
                keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                values = [signature(x, a, b) if len(x) >= least else None for x in sets]
                found = [None if v is None else bands(v, number, size).tolist() for v in values]
                short = [None if v is None else (v >> np.uint64(56)).astype(np.uint8).tobytes() for v in map(spread, values)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["id", "n", "key", "buckets", "signature"])

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(lean(sketch), "id long, n long, key binary, buckets array<bigint>, signature binary")


def linked(percent: int, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a matrix."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    counts = np.diff(np.r_[starts, len(flat)])
    out = np.zeros(m * m, np.int64)
    for d in range(2, 9):  # rare shingles pair by pair
        rows = owner[starts[counts == d][:, None] + np.arange(d)]
        for i, j in combinations(range(d), 2):
            out += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m) if len(rows) else 0
    out = out.reshape(m, m)
    out += out.T
    often = np.flatnonzero(counts > 8)
    for at in range(0, len(often), 4096):  # frequent ones by a matrix product
        part = often[at : at + 4096]
        grid = np.zeros((m, len(part)), np.float32)
        n = counts[part]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[part], n)
        grid[owner[place], np.repeat(np.arange(len(part)), n)] = 1
        out += (grid @ grid.T).astype(np.int64)
    return out


def block_links(ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a block; sides: 0 and 1 where only pairs across count, else all 0."""
    n = np.array([len(x) for x in sets], np.int64)
    if len(ids) <= 16:
        pairs = [(i, j) for i, j in combinations(range(len(ids)), 2) if 100 * min(n[i], n[j]) >= percent * max(n[i], n[j])]
        if any(sides):
            pairs = [(i, j) for i, j in pairs if sides[i] != sides[j]]
    else:
        common = common_counts(sets)
        good = np.triu(linked(percent, common, n[:, None], n[None, :]), 1)
        if any(sides):
            good &= np.not_equal.outer(sides, sides)
        pairs = zip(*(x.tolist() for x in np.nonzero(good)), strict=True)
    above = list(range(len(ids)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    out = []
    for i, j in pairs:
        p, q = root(i), root(j)
        if p == q:
            continue
        if len(ids) <= 16 and not linked(percent, len(np.intersect1d(sets[i], sets[j], assume_unique=True)), n[i], n[j]):
            continue
        above[q] = p
        out.append((ids[i], ids[j]))
    return out


def resembling(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest, in each bucket, of the pairs whose estimate is not far below the threshold.

    classes: id, n, buckets, signature of texts with different sets."""
    j = percent / 100
    least = int(np.ceil(2 * PERMUTATIONS * (j - DEVIATIONS * (j * (1 - j) / (2 * PERMUTATIONS)) ** 0.5)))
    placed = classes.select("id", F.explode("buckets").alias("bucket"))
    h = F.xxhash64("id")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("many"), F.min("id").alias("first"), F.max("id").alias("last"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 24)).alias("s")).where("first < last")
    shared = shared.groupBy("many", "first", "last", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("many") / SIGNATURES).cast("int").alias("cells"))
    rows = placed.join(shared, "bucket").join(classes.select("id", "n", "signature"), "id")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    key = ["bucket", "lo", "hi"]
    rows = rows.select("bucket", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"), (F.col("cell") > F.col("other")).cast("int").alias("side"), "id", "n", "signature")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, sides, sizes, signatures = None, [], [], [], []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for whole in batches:
            part, found = whole.to_pydict(), []
            for i, block in enumerate(zip(part["bucket"], part["lo"], part["hi"], strict=True)):
                if block != here:
                    found += alike(ids, sides, sizes, signatures, least, percent)
                    here, ids, sides, sizes, signatures = block, [], [], [], []
                ids.append(part["id"][i])
                sides.append(part["side"][i])
                sizes.append(part["n"][i])
                signatures.append(part["signature"][i])
            yield out(found)
        yield out(alike(ids, sides, sizes, signatures, least, percent))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(compare), "a long, b long")


def alike(ids: list[int], sides: list[int], sizes: list[int], signatures: list[bytes], least: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that agree in at least so many bytes and may link by their sizes; sides as in block_links()."""
    if len(ids) < 2:
        return []
    grid, n, side, group = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(ids), -1), np.array(sizes, np.int64), np.array(sides), np.arange(len(ids))
    across, out = any(sides), []
    for at in np.flatnonzero(side == 0).tolist():
        may = (group != group[at]) & (100 * np.minimum(n, n[at]) >= percent * np.maximum(n, n[at]))
        if across:
            may &= side == 1
        rest = np.flatnonzero(may)
        near = rest[(grid[rest] == grid[at]).sum(1) >= least]
        for g in np.unique(group[near]).tolist():
            out.append((ids[at], ids[int(near[group[near] == g][0])]))
            group[group == g] = group[at]
    return out


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """members (id, n, g: coarse group) with block and side, a row for each block that the member is in."""
    sums = members.groupBy("g").agg(F.count("*").alias("many"), F.sum("n").alias("total"))
    sums = sums.withColumn("whole", (F.col("many") <= CELL) & (F.col("total") <= CELL_SHINGLES))
    members = members.join(sums.select("g", "whole"), "g")
    small = members.where("whole").select("id", "g", F.lit(0).alias("lo"), F.lit(0).alias("lo_cell"), F.lit(0).alias("hi"), F.lit(0).alias("hi_cell"), F.lit(0).alias("side"))
    # sets that link have sizes in the same or in adjacent classes
    rank = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * 1.000001)).cast("int")
    large = members.where(~F.col("whole")).withColumn("rank", rank)
    cells = large.groupBy("g", "rank").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias("cells"))
    above = cells.select("g", (F.col("rank") - 1).alias("rank"), F.col("cells").alias("above"))
    below = cells.select("g", (F.col("rank") + 1).alias("rank"), F.col("cells").alias("below"))
    around = cells.join(above, ["g", "rank"], "left").join(below, ["g", "rank"], "left")
    large = large.join(around, ["g", "rank"]).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells").cast("long")).cast("int"))

    def upto(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def at(lo: Column, lo_cell: Column, hi: Column, hi_cell: Column, side: Column) -> Column:
        return F.struct(lo.alias("lo"), lo_cell.alias("lo_cell"), hi.alias("hi"), hi_cell.alias("hi_cell"), side.alias("side"))

    cell, mine = F.col("cell"), F.col("rank")
    inside = F.transform(upto("cells"), lambda x: at(mine, F.least(x, cell), mine, F.greatest(x, cell), F.when(cell > x, 1).otherwise(0)))
    up = F.transform(upto("above"), lambda x: at(mine, cell, mine + 1, x, F.lit(0)))
    down = F.transform(upto("below"), lambda x: at(mine - 1, x, mine, cell, F.lit(1)))
    return small.union(large.select("id", "g", F.explode(F.concat(inside, up, down)).alias("b")).select("id", "g", "b.*"))


def links(docs: DataFrame, members: DataFrame, id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """a, b: a spanning forest of the exact links inside each coarse group."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, here, ids, sides, sets = Words(), None, [], [], []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for whole in batches:
            found = []
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS).to_pydict()
                for i, key in enumerate(zip(part["g"], part["lo"], part["lo_cell"], part["hi"], part["hi_cell"], strict=True)):
                    if key != here:
                        found += block_links(ids, sides, sets, percent)
                        here, ids, sides, sets = key, [], [], []
                    x = shingles(part["text"][i], width, words)
                    if ids and ids[-1] == part["id"][i]:  # of an id's rows that with the largest set counts
                        sets[-1] = max(sets[-1], x, key=lambda y: (len(y), y.tobytes()))
                        continue
                    ids.append(part["id"][i])
                    sides.append(part["side"][i])
                    sets.append(x)
            yield out(found)
        yield out(block_links(ids, sides, sets, percent))

    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    key = ["g", "lo", "lo_cell", "hi", "hi_cell"]
    texts = perhaps_in(texts, "id", members.select("id")).where("_maybe").drop("_maybe")
    rows = texts.join(blocks(members, percent), "id").repartition(*key).sortWithinPartitions(*key, "id")
    return rows.mapInArrow(lean(confirm), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id and kept of every row of docs."""
    seen = written(sketches(docs, id_column, text_column, width, percent), "sketches", small_batches=True)
    classes = written(seen.where("key IS NOT NULL").groupBy("key").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", "buckets", "signature"))).alias("x")).select("key", "x.*"), "classes")
    own = classes.where("id IS NOT NULL AND buckets IS NOT NULL")
    own = own.groupBy("id").agg(F.max(F.struct("n", "key", "buckets", "signature")).alias("x")).select("id", "x.n", "x.buckets", "x.signature")
    coarse = components(written(resembling(own, percent), "alike", small_batches=True), "coarse")
    members = classes.where("id IS NOT NULL").groupBy("id").agg(F.max("n").alias("n")).join(coarse.select(F.col("node").alias("id"), F.col("component").alias("g")), "id")
    members = written(members, "members")
    found = components(written(links(docs, members, id_column, text_column, width, percent), "links", small_batches=True), "duplicates")
    ends = classes.join(found, classes["id"] == found["node"], "left").select("key", F.coalesce("component", "id").alias("component_id"))
    rows = seen.select("id", "n", "key").join(ends, "key", "left")
    whole = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), whole.alias("component_id"), F.col("id").eqNullSafe(whole).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n AS p ON p.doc_id = c.a JOIN n AS q ON q.doc_id = c.b WHERE 100 * c.c >= 85 * (p.n + q.n - c.c)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, m.b AS component_id, n.doc_id = m.b AS kept
FROM n JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) AS m ON m.a = n.doc_id
"""
