"""Embedding near-dedup over an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on a sample and make a product grid of
cells, which grows with the table: PER_CELL vectors of the largest label in a cell, on average. Each vector lives in one cell and visits others by multi-sequence traversal, nearest first, where near is how
far a vector must at least be moved to reach the cell. How far it goes is measured on the table: QUERIES vectors are compared with all others by brute force, and the reach is
MARGIN times the farthest that one of them has to go for a link. That all linked vectors but a part of 1 - TARGET_RECALL need no more is SURE if there are enough linked queries (whole_reach());
else nothing is risked, and the reach is the distance beyond which no link can lie.

The sample is bounded: SAMPLE vectors and SAMPLE_BYTES of them, about, those with the least digests among the vectors of their length, of which each has its share. A codebook has no more centres
than the sample has distinct halves.
Every vector is indexed, and whatever shares a visited cell is verified by its cosine in double precision.

Exact copies are one class with one representative. A cell is cut into chunks of about CHUNK residents that a task holds
while visitors stream by, so that a cell of any size is many tasks; a chunk yields a spanning forest of links and counts
of links, never all pairs.

A vector that is null, empty or zero, has a component that is null or not finite, or has no label or no id links with nothing, nor do vectors of different
lengths. Rows with one id are separate vectors with a common place in components. An empty table gives an empty result.
Only the three columns named are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table, written
from tidewell.llm.components import components

LEAST_COSINE = 0.98
TARGET_RECALL, SURE, MARGIN, QUERIES = 0.95, 0.95, 1.5, 4096
SAMPLE, SAMPLE_BYTES, CHUNK, PER_CELL = 20_000, 128 << 20, 1024, 16
ROWS = 1024


def _unit(values: list | None) -> np.ndarray | None:
    if not values or any(x is None for x in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _units(values: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision from vectors as the table has them."""
    x = np.frombuffer(b"".join(values), kind).astype(np.float64).reshape(len(values), -1)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _digests(x: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in x], np.uint64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[at : at + ROWS], centres).argmin(1) for at in range(0, len(x), ROWS)])


def _centres(half: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    half = np.unique(half, axis=0)
    if len(half) <= k or not half.shape[1]:
        return half
    at = half[rng.choice(len(half), k, replace=False)]
    for _ in range(12):
        near = _nearest(half, at)
        order = np.argsort(near, kind="stable")
        own, starts, n = np.unique(near[order], return_index=True, return_counts=True)
        at[own] = np.add.reduceat(half[order], starts, axis=0) / n[:, None]
    return np.unique(at, axis=0)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T)


class Grid:
    """The product of two codebooks and how far to go in it."""

    def __init__(self, first: np.ndarray, second: np.ndarray, reach: float) -> None:
        self.books, self.reach = (first, second), reach
        #: Vectors placed at once, so that a table of them and the centres stays small.
        self.rows = max(16, min(ROWS, (1 << 20) // max(1, len(first), len(second))))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Each vector's cell."""
        cut = self.books[0].shape[1]
        return _nearest(x[:, :cut], self.books[0]) * len(self.books[1]) + _nearest(x[:, cut:], self.books[1])

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Each vector's cell, and for each half the squared distance to each centre's region."""
        cut = self.books[0].shape[1]
        own, apart = [], []
        for half, book in ((x[:, :cut], self.books[0]), (x[:, cut:], self.books[1])):
            d = _squares(half, book)
            mine = d.argmin(1)
            gap = np.maximum(0, d - d[np.arange(len(x)), mine][:, None]) / (2 * np.maximum(np.sqrt(_squares(book[mine], book)), 1e-12))
            gap[np.arange(len(x)), mine] = 0
            own.append(mine)
            apart.append(gap * gap)
        return own[0] * len(self.books[1]) + own[1], (apart[0], apart[1])

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells other than the own one in the order of the sum of both gaps, by multi-sequence traversal, up to reach."""
        most, width, out = self.reach * self.reach, len(b), []
        i, j = (near[np.argsort(x[near], kind="stable")] for x, near in ((a, np.flatnonzero(a <= most)), (b, np.flatnonzero(b <= most))))
        heap = [(a[i[0]] + b[j[0]], 0, 0)]
        while heap:
            far, p, q = heapq.heappop(heap)
            if far > most:
                break
            if p or q:
                out.append(int(i[p]) * width + int(j[q]))
            if q + 1 < len(j):
                heapq.heappush(heap, (a[i[p]] + b[j[q + 1]], p, q + 1))
            if not q and p + 1 < len(i):
                heapq.heappush(heap, (a[i[p + 1]] + b[j[0]], p + 1, 0))
        return out


def exact_reach(least: float) -> float:
    """The distance of unit vectors beyond which no link can lie."""
    return float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9


def whole_reach(far: list[float], least: float, recall: float) -> float:
    """The reach from the distances that linked queries have to go: that more than 1 - recall of all vectors have to go beyond the greatest of n has the chance recall ** n."""
    if recall ** len(far) > 1 - SURE:
        return exact_reach(least)
    return min(exact_reach(least), MARGIN * max(far) + 1e-9)


def fitted(sample: np.ndarray, k: int, least: float = LEAST_COSINE) -> Grid:
    cut = sample.shape[1] // 2
    rng = np.random.Generator(np.random.PCG64(11))
    return Grid(_centres(sample[:, :cut], k, rng), _centres(sample[:, cut:], k, rng), exact_reach(least))


def needs(classes: DataFrame, grids: dict[int, Grid], queries: dict[int, list[tuple[str, bytes]]], least: float, kind: str) -> dict[int, list[float]]:
    """For each length how far each of its queries that has links has to go for all of them; every vector is compared with every query of its length and label."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = {}, {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                dims = np.asarray(batch.column("dim"))
                for dim in np.unique(dims).tolist():
                    if dim not in queries:
                        continue
                    if dim not in held:
                        q = _units([v for _, v in queries[dim]], kind)
                        gaps = [grids[dim].placed(q[i : i + grids[dim].rows])[1] for i in range(0, len(q), grids[dim].rows)]
                        held[dim] = q, np.array([label for label, _ in queries[dim]]), np.vstack([a for a, _ in gaps]), np.vstack([b for _, b in gaps])
                    (q, labels, a, b), rows = held[dim], np.flatnonzero(dims == dim).tolist()
                    x = _units([batch.column("vec")[i].as_py() for i in rows], kind)
                    own = np.array([batch.column("label")[i].as_py() for i in rows])
                    i, j = np.nonzero((x @ q.T >= least) & (own[:, None] == labels[None]))
                    other = _digests(x)[i] != _digests(q)[j]
                    i, j = i[other], j[other]
                    if len(i):
                        cell = grids[dim].cells(x)[i]
                        width = len(grids[dim].books[1])
                        for n, far in zip(j.tolist(), np.sqrt(a[j, cell // width] + b[j, cell % width]).tolist(), strict=True):
                            most[dim, n] = max(far, most.get((dim, n), 0.0))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in most], pa.int32()), pa.array([n for _, n in most], pa.int32()), pa.array(list(most.values()), pa.float64())], ["dim", "query", "far"])

    out: dict[int, list[float]] = {dim: [] for dim in queries}
    for r in classes.select("label", "dim", "vec").mapInArrow(measure, "dim int, query int, far double").groupBy("dim", "query").agg(F.max("far").alias("far")).collect():
        out[r["dim"]].append(r["far"])
    return out


def sampled(classes: DataFrame, counts: DataFrame) -> dict[int, list[tuple[str, bytes]]]:
    """For each length its sample of label and vector. Each length's share is drawn by digest; all shares together are within the bounds, about."""
    dims = counts.groupBy("dim").agg(F.sum("n").alias("of_dim"))
    n = dims.count()
    quota = F.least(F.lit(SAMPLE / max(1, n)), F.lit(SAMPLE_BYTES / max(1, n)) / (8 * F.col("dim")))
    uniform = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = classes.select("label", "dim", "key", "vec").join(dims, "dim").where(uniform * F.col("of_dim") <= quota).select("label", "dim", "vec")
    out: dict[int, list[tuple[str, bytes]]] = {}
    for r in rows.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE + SAMPLE // 10).collect():
        out.setdefault(r["dim"], []).append((r["label"], bytes(r["vec"])))
    return out


def near_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", least: float = LEAST_COSINE, recall: float = TARGET_RECALL) -> DataFrame:
    """id, n_links, component_id and kept of every row."""

    # vectors move as the table has them, and are made units again where they are compared
    kind = "<f4" if rows.schema[vector_column].dataType.simpleString() == "array<float>" else "<f8"

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [_unit(x) for x in batch.column(2).to_pylist()]
                found = [None if i is None or label is None else x for x, i, label in zip(found, batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                keys = [None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in found]
                vectors = [None if x is None else np.asarray(v, kind).tobytes() for x, v in zip(found, batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if x is None else len(x) for x in found], pa.int32()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["id", "label", "dim", "key", "vec"])

    named = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("string").alias("label"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    seen = written(named.mapInArrow(unit, "id long, label string, dim int, key binary, vec binary"), "units")
    classes = written(seen.where("key IS NOT NULL").groupBy("label", "dim", "key").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.first("vec").alias("vec")), "vectors")
    counts = written(classes.groupBy("label", "dim").agg(F.count("*").alias("n")), "counts")
    k = max(1, round(((counts.agg(F.max("n")).first()[0] or 0) / PER_CELL) ** 0.5))
    samples, grids, queries = sampled(classes, counts), {}, {}
    for dim, mine in samples.items():
        grids[dim] = fitted(_units([v for _, v in mine], kind), k, least)
        queries[dim] = mine[:: max(1, len(mine) * len(samples) // QUERIES)]
    for dim, far in needs(classes, grids, queries, least, kind).items():
        grids[dim].reach = whole_reach(far, least, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = min([ROWS, *(grid.rows for grid in grids.values())])
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                dims = np.asarray(batch.column("dim"))
                cells, visits = np.zeros(len(dims), np.int64), [[] for _ in dims]
                for dim in np.unique(dims).tolist():
                    if (grid := grids.get(dim)) is None:
                        continue  # a length that the sample has not: one cell
                    at_rows = np.flatnonzero(dims == dim)
                    x = _units([batch.column("vec")[i].as_py() for i in at_rows.tolist()], kind)
                    cells[at_rows], (a, b) = grid.placed(x)
                    for n, i in enumerate(at_rows.tolist()):
                        visits[i] = grid.visits(a[n], b[n])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "dim", "many", "vec")], pa.array(cells), pa.array(visits, pa.list_(pa.int64()))], ["id", "label", "dim", "many", "vec", "cell", "visits"])

    placed = written(classes.select("id", "label", "dim", "many", "vec").mapInArrow(place, "id long, label string, dim int, many long, vec binary, cell long, visits array<bigint>"), "placed")
    where = ["label", "dim", "cell"]
    cells = placed.groupBy(*where).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    residents = placed.join(cells, where).withColumn("chunk", F.pmod(F.xxhash64("id", "vec"), F.col("chunks").cast("long")).cast("int"))
    columns = [*where, "chunk", "side", "id", "many", "home", "visits", "vec"]
    none = F.array().cast("array<bigint>")
    at_home = residents.withColumns({"side": F.lit(0), "home": F.col("cell")}).select(columns)
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    next_door = residents.where("chunk > 0").select(*where, upto(F.col("chunk")).alias("chunk"), F.lit(1).alias("side"), "id", "many", F.col("cell").alias("home"), none.alias("visits"), "vec")
    away = placed.select("label", "dim", "id", "many", F.col("cell").alias("home"), "vec", F.explode("visits").alias("cell")).join(cells, where)
    away = away.select(*where, upto(F.col("chunks")).alias("chunk"), F.lit(1).alias("side"), "id", "many", "home", none.alias("visits"), "vec")
    block = [*where, "chunk"]
    blocks = at_home.union(next_door).union(away).repartition(*block).sortWithinPartitions(*block, "side", "home")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["a", "b", "n"])

        for batch in batches:
            found = []
            keys = list(zip(*[batch.column(c).to_pylist() for c in block], strict=True))
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            start = 0
            for end in ends:
                if keys[start] != here:
                    found += state.closed() if state else []
                    here, state = keys[start], Chunk(least, kind)
                for at in range(start, end, ROWS):
                    found += state.take(batch.slice(at, min(ROWS, end - at)).to_pydict())
                start = end
            yield out(found)
        if state:
            yield out(state.closed())

    made = written(blocks.mapInArrow(verify, "a long, b long, n long"), "links")
    linked = components(made.where("b IS NOT NULL").select("a", "b"), "vector-components")
    n = made.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    ends = classes.drop("vec").join(linked, classes["id"] == linked["node"], "left").join(n, classes["id"] == n["a"], "left")
    ends = ends.select("label", "dim", "key", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rows = seen.drop("vec").join(ends, ["label", "dim", "key"], "left")
    whole = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), whole.alias("component_id"), F.col("id").eqNullSafe(whole).alias("kept"))


class Chunk:
    """The residents of a part of a cell, and those that come by. Rows of links are (a, b, null), of counts (id, null, n)."""

    def __init__(self, least: float, kind: str) -> None:
        self.least, self.kind = least, kind
        self.ids, self.many, self.cell, self.visits, self.vecs = [], [], None, [], []
        self.matrix: np.ndarray | None = None

    def _close(self) -> list[tuple]:
        self.matrix = _units(self.vecs, self.kind)
        self.weights = np.array(self.many, np.int64)
        self.above = list(range(len(self.ids)))
        near = self.matrix @ self.matrix.T >= self.least
        np.fill_diagonal(near, False)
        self.counts = near @ self.weights
        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
            out += self._join(i, j)
        self.masks: dict[int, np.ndarray] = {}
        return out

    def _root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def _join(self, i: int, j: int) -> list[tuple]:
        p, q = self._root(i), self._root(j)
        if p == q:
            return []
        self.above[q] = p
        return [(self.ids[i], self.ids[j], None)]

    def take(self, rows: dict) -> list[tuple]:
        out, n = [], sum(1 for x in rows["side"] if x == 0)
        if n:
            self.ids += rows["id"][:n]
            self.many += rows["many"][:n]
            self.visits += [frozenset(x) for x in rows["visits"][:n]]
            self.vecs += rows["vec"][:n]
            self.cell = rows["cell"][0]
        if n == len(rows["side"]):
            return out
        if self.matrix is None:
            out += self._close()
        homes = rows["home"][n:]
        near = _units(rows["vec"][n:], self.kind) @ self.matrix.T >= self.least
        for home in set(homes):
            # a pair of which both visit each other counts where the visitor's cell is the smaller one
            if home > self.cell:
                if home not in self.masks:
                    self.masks[home] = np.array([home not in v for v in self.visits])
                near[np.array([h == home for h in homes])] &= self.masks[home]
        many = np.array(rows["many"][n:], np.int64)
        self.counts = self.counts + many @ near
        for k in np.flatnonzero(near.any(1)).tolist():
            to = np.flatnonzero(near[k]).tolist()
            visitor = rows["id"][n + k]
            out.append((visitor, None, int(self.weights[to].sum())))
            out.append((visitor, self.ids[to[0]], None))
            for j in to[1:]:
                out += self._join(to[0], j)
        return out

    def closed(self) -> list[tuple]:
        out = self._close() if self.matrix is None else []
        return out + [(i, None, int(c)) for i, c in zip(self.ids, self.counts, strict=True) if c]


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.b AS component_id, e.vec_id = m.b AS kept
FROM embeddings AS e LEFT JOIN n ON n.a = e.vec_id JOIN m ON m.a = e.vec_id
"""
