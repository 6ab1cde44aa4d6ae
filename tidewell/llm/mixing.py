"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact source block quotas.

The words of a source, its documents in an order fixed by a digest of their ids, make one long row, cut into blocks of equal length. The blocks are drawn
in the order of a permutation, all of them once for each time that the target holds the whole source, then as many as the rest of the target asks; the last one
drawn is cut where the target ends. So a source's quota is an exact number of drawings. The tree halves the set of output shards again and again;
at each node the quotas of all sources are dealt to the two halves by one multivariate-hypergeometric draw, so that the parts add up exactly. Each
shard then gets the drawings of its places in a second permutation, which no other shard has, and shuffles them locally. Nothing is taken but what a
shard draws.

The draws at the tree's nodes are made by the driver from one row for each source (the source table, of which
most_sources is the bound that is checked); all that touches documents is DataFrame operations. No group is gathered: places
in a source's row are prefix sums over fine buckets of the order, so a source that holds a third of all documents is dealt
with by many tasks; a shard is cut into slices of its local order, so that any number of shards does for any size.

Null or blank texts have size 0 and nothing is taken of them; a null source is a source of its own, the last; repeated rows
are separate documents, next to each other in the order; an empty table gives an empty result. A very long text is a row of many blocks; it is read whole and
cut only where a block that is not drawn begins. Columns of docs are packed away meanwhile, so that no name clashes.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import SPACE, SPACE_CHARS, table, word_count, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 4096
SHARDS = 64
#: Words in a slice of a shard, about.
SLICE_WORDS = 1 << 20
SEED = 20240
#: Documents in a bucket of a source's order, about.
BUCKET = 2000
#: From here on numpy does not draw.
BILLION = 1_000_000_000
MOST_SOURCES = 100_000
#: Steps of permutations stay below about this, so that products with places fit in 64 bits.
MOST_STEP = 1 << 20


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Each source's share of the sum of sizes by weight, never above most times its size, the excess shared again."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    out, rest, left = [0.0] * len(sizes), sum(sizes), sum(weigh)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weigh[i], i))
    for k, i in enumerate(order):
        if most * sizes[i] * left > weigh[i] * rest:
            for j in order[k:]:
                out[j] = weigh[j] * rest / left
            break
        out[i] = float(most * sizes[i])
        rest, left = rest - most * sizes[i], left - weigh[i]
    return out


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n drawn things are good; where numpy's own does not reach, by inversion over 12 deviations around the mean."""
    if good + bad < BILLION:
        return int(rng.hypergeometric(good, bad, n))
    share, total = good / (good + bad), good + bad
    mean, spread = n * share, math.sqrt(n * share * (1 - share) * (total - n) / (total - 1))
    lo, hi = max(0, n - bad, math.floor(mean - 12 * spread - 12)), min(good, n, math.ceil(mean + 12 * spread + 12))
    k = np.arange(lo, hi, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def dealt(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n things drawn from all are of each kind."""
    if not n:
        return np.zeros_like(quotas)
    if quotas.sum() < BILLION:
        return rng.multivariate_hypergeometric(quotas, n, method="marginals")
    out, rest = np.zeros_like(quotas), int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):
        rest -= q
        out[i] = hypergeometric(q, rest, n, rng) if q and n else 0
        n -= int(out[i])
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards rows whose sum is quotas: the leaves of the splitting tree, of equal totals but for one block."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    here = dealt(quotas, int(quotas.sum()) * left // shards, rng)
    return np.vstack([split(here, left, rng), split(quotas - here, shards - left, rng)])


def permuted(n: int, seed: int, name: str) -> tuple[int, int]:
    """A step and a start: k -> (k * step + start) % n is a permutation."""
    start = int(hashlib.md5(f"{seed}-{name}".encode()).hexdigest()[:8], 16)
    step = max(1, int(min(n, MOST_STEP) * 0.6180339887))
    return next(a for a in range(step, step + n + 1) if math.gcd(a, n) == 1), start % n


def source_table(sized: DataFrame, block: int, shards: int, seed: int, most_sources: int = MOST_SOURCES) -> tuple[DataFrame, int]:
    """One row for each source (its size, target, words to take, blocks, permutations and the ends of the shards' shares) and the sum of what is taken."""
    spark = sized.sparkSession
    found = sized.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("docs")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    found.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    sizes = [int(r["size"] or 0) for r in found]
    want = targets(sizes)
    rows, quotas = [], np.zeros(len(found), np.int64)
    for i, (r, size) in enumerate(zip(found, sizes, strict=True)):
        name = "" if r["_source"] is None else "s" + r["_source"]
        take, n = math.floor(want[i] + 0.5), max(1, -(-size // block))
        full = take // size if size else 0
        rest, lost = take - full * size, n * block - size  # lost: what the last block is short of
        step, first = permuted(n, seed, name)
        last = ((n - 1) * step + first) % n
        drawn = min(last + 1, -(-rest // block)) + max(0, min(n, -(-(rest + lost) // block)) - last - 1)
        quotas[i] = full * n + drawn
        deal, begin = permuted(max(1, int(quotas[i])), seed, "deal-" + name)
        buckets = 1 << max(0, math.ceil(math.log2(max(1, r["docs"] / BUCKET))))
        rows.append({"s": r["_source"], "size": size, "target": want[i], "full": full, "rest": rest, "lost": lost, "blocks": n, "step": step, "first": first, "last": last, "quota": max(1, int(quotas[i])), "deal": deal, "begin": begin, "buckets": min(buckets, 1 << 30)})
    leaves = split(quotas, shards, np.random.Generator(np.random.PCG64(seed)))
    for row, ends in zip(rows, np.cumsum(leaves, axis=0).T.tolist(), strict=True):
        row["ends"] = ends
    kind = "array<struct<s:string,size:bigint,target:double,full:bigint,rest:bigint,lost:bigint,blocks:bigint,step:bigint,first:bigint,last:bigint,quota:bigint,deal:bigint,begin:bigint,buckets:bigint,ends:array<bigint>>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("_s")), sum(math.floor(x + 0.5) for x in want)


def draws(docs: DataFrame, source: Column, size: Column, key: Column, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs, packed as _row, with _s (its source's row), _size, _key, _slices (of a shard) and _draws: what each shard draws of the document, in the order of rounds and blocks.

    A draw has round, block, shard, first and end (of the words taken). key is what the order of documents comes from."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source.cast("string").alias("_source"), size.alias("_size"), F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit("")))).alias("_key"))
    plan, total = source_table(rows.select("_source", "_size"), block_words, shards, seed)
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.join(F.broadcast(plan), rows["_source"].eqNullSafe(F.col("_s.s")))
    rows = rows.withColumn("_bucket", F.floor(at * F.col("_s.buckets") / F.lit(1 << 32)).cast("long"))
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("")))
    sums = rows.groupBy("_name", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = sums.select("_name", "_bucket", (F.sum("_sum").over(Window.partitionBy("_name").orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_name", "_bucket").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_inside", F.sum("_size").over(inside) - F.col("_size")).join(before, ["_name", "_bucket"])
    placed = placed.select("_row", "_s", "_size", "_key", (F.col("_before") + F.col("_inside")).alias("_start"))
    s, begin, length = F.col("_s"), F.col("_start"), F.lit(block_words)
    blocks = F.when(F.col("_size") > 0, F.sequence(F.floor(begin / length), F.floor((begin + F.col("_size") - 1) / length))).otherwise(F.array().cast("array<bigint>"))

    def draw(n: Column, k: Column) -> Column:
        rank = (k * s["step"] + s["first"]) % s["blocks"]
        place = n * s["blocks"] + rank  # among the source's drawings
        whole = F.least(length, s["size"] - k * length)
        left = s["rest"] - rank * length + F.when(rank > s["last"], s["lost"]).otherwise(F.lit(0))
        drawn = F.when(n < s["full"], whole).otherwise(F.least(whole, F.greatest(left, F.lit(0))))
        mine = (place * s["deal"] + s["begin"]) % s["quota"]
        shard = F.when((place < s["quota"]) & (mine < F.element_at(s["ends"], -1)), F.size(F.filter(s["ends"], lambda x: x <= mine)))
        return F.struct(n.cast("int").alias("round"), k.alias("block"), shard.alias("shard"), (F.greatest(k * length, begin) - begin).alias("first"), (F.least(k * length + drawn, begin + F.col("_size")) - begin).alias("end"))

    rounds = F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))
    every = F.flatten(F.transform(rounds, lambda n: F.transform(blocks, lambda k: draw(n, k))))
    placed = placed.withColumn("_draws", F.filter(every, lambda d: d["shard"].isNotNull() & (d["end"] > d["first"])))
    return placed.withColumn("_slices", F.lit(max(1, -(-total // (shards * SLICE_WORDS)))))


def taken(column: str = "_draws") -> Column:
    """The words that all shards together draw."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda n, d: n + d["end"] - d["first"])


def by_shard(rows: DataFrame, shard: str = "_shard", place: str = "_place", slices: str = "_slices") -> DataFrame:
    """rows in their shards' local order; a slice of a shard is in one partition, and slices follow each other in that order."""
    part = F.floor((F.col(place) / F.lit(float(1 << 64)) + 0.5) * F.col(slices))
    return rows.repartition(F.col(shard), part).sortWithinPartitions(shard, place)


def mix_plan(docs: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id", seed: int = SEED, **how) -> DataFrame:
    """Every draw as a row: shard, place (its order there), source, block, round, id, first_word, end_word."""
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size"))
    found = draws(narrow, F.col("source"), F.col("size"), F.col("id"), seed=seed, **how)
    flat = found.select(F.col("_row.id").alias(id_column), F.col("_row.source").alias("source"), "_key", "_slices", F.explode("_draws").alias("d"))
    flat = flat.withColumns({"shard": F.col("d.shard"), "place": F.xxhash64(F.lit(seed), "_key", "d.round", "d.block")})
    return by_shard(flat, "shard", "place").select("shard", "place", "source", F.col("d.block").alias("block"), F.col("d.round").alias("round"), id_column, F.col("d.first").alias("first_word"), F.col("d.end").alias("end_word"))


def words_between(text: Column, first: Column, end: Column) -> Column:
    """text from the beginning of a word, counted from 0, to the end of the one before end; white space before the first of all words is kept."""
    ends = F.split(text, rf"(?<=[^{SPACE}])(?=[{SPACE}])")
    part = F.array_join(F.slice(ends, first.cast("int") + 1, (end - first).cast("int")), "")
    return F.when(first > 0, F.ltrim(part, F.lit(SPACE_CHARS))).otherwise(part)


def runs(column: str = "_draws") -> Column:
    """The draws with those that follow each other in one round joined: what is drawn of a text without a gap stays one text, in the shard of its first part."""
    step = lambda acc, d: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["round"] == d["round"]) & (F.try_element_at(acc, F.lit(-1))["end"] == d["first"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.try_element_at(acc, F.lit(-1)).withField("end", d["end"]))),
    ).otherwise(F.concat(acc, F.array(d)))
    kind = "array<struct<round:int,block:bigint,shard:int,first:bigint,end:bigint>>"
    return F.aggregate(column, F.array().cast(kind), step)


def mixed(docs: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id", seed: int = SEED, **how) -> DataFrame:
    """docs as the mix has them, with their columns, by shard and in its local order: a row for each part of a document that a round takes without a gap.

    n_chars, if docs has it, follows the text."""
    found = draws(docs, F.col(f"`{source_column}`"), word_count(F.col(f"`{text_column}`")), F.col(f"`{id_column}`"), seed=seed, **how)
    flat = found.select("_row", "_size", "_key", "_slices", F.explode(runs()).alias("_d"))
    text = F.col("_row")[text_column]
    whole = (F.col("_d.first") == 0) & (F.col("_d.end") == F.col("_size"))
    cut = F.when(whole, text).otherwise(words_between(text, F.col("_d.first"), F.col("_d.end")))
    flat = flat.select("_row", "_slices", cut.alias("_text"), F.col("_d.shard").alias("_shard"), F.xxhash64(F.lit(seed), "_key", "_d.round", "_d.first").alias("_place"))
    return by_shard(flat).select(*[F.col("_text").alias(c) if c == text_column else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    found = draws(narrow, F.col("source"), F.col("size"), F.col("doc_id"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_s.size").alias("source_size"), F.col("_s.target").alias("target"), taken().alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS n FROM s),
c AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left
  FROM r),
f AS (SELECT min(n) AS n FROM c WHERE CAST(3 * source_size AS HUGEINT) * w_left > CAST(w AS HUGEINT) * rest),
t AS (
  SELECT c.source, c.source_size,
         CASE WHEN f.n IS NOT NULL AND c.n >= f.n
              THEN CAST(c.w * (SELECT rest FROM c AS x WHERE x.n = f.n) AS DOUBLE) / (SELECT w_left FROM c AS x WHERE x.n = f.n)
              ELSE CAST(3 * c.source_size AS DOUBLE) END AS target
  FROM c, f),
q AS (
  SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS take, greatest(1, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}) AS n,
         CAST('0x' || substr(md5('{SEED}-' || coalesce('s' || source, '')), 1, 8) AS BIGINT) AS h FROM t),
u AS (
  SELECT *, h % n AS first, take % greatest(1, source_size) AS rest, n * {BLOCK_WORDS} - source_size AS lost,
         list_filter(range(a, a + 1000), lambda x: gcd(x, n) = 1)[1] AS step
  FROM (SELECT *, CAST(greatest(1, floor(least(n, {MOST_STEP}) * 0.6180339887::DOUBLE)) AS BIGINT) AS a FROM q)),
p AS (
  SELECT row_number() OVER () AS rid, d.doc_id, d.size, u.*, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS begins
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
b AS (
  SELECT rid, begins, size, k, rest, lost, least({BLOCK_WORDS}, source_size - k * {BLOCK_WORDS}) AS whole, (k * step + first) % n AS rank, ((n - 1) * step + first) % n AS last
  FROM (SELECT *, unnest(range(begins // {BLOCK_WORDS}, (begins + size - 1) // {BLOCK_WORDS} + 1)) AS k FROM p WHERE size > 0 AND rest > 0)),
x AS (
  SELECT rid, sum(greatest(0, least(k * {BLOCK_WORDS} + least(whole, greatest(0, rest - rank * {BLOCK_WORDS} + CASE WHEN rank > last THEN lost ELSE 0 END)), begins + size) - greatest(k * {BLOCK_WORDS}, begins))) AS part
  FROM b GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(take // greatest(1, source_size) * size + coalesce(part, 0) AS BIGINT) AS taken
FROM p LEFT JOIN x ON x.rid = p.rid
"""
