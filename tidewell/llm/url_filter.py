"""URL filter: rules, and a ratio of character language models where no rule fits.

Two smoothed variable-order Markov models over characters, one of accepted and one of rejected URLs, are counted from all URLs that
the rules decide, but for a held-out share. A context is as long as the counts bear: strings seen less than LEAST_COUNT times are not
in the model, which is Witten-Bell smoothed from the order below. So the models grow with the URLs, by one rule at every size.
The filter is the difference of the log-likelihoods by length, with the limit that makes the least balanced error on the held-out URLs.

The ratio of both models is written as weights of strings and of contexts, in millionths, of which a URL's difference is the sum;
so scoring is a sum of integers, which any order of rows gives alike. The commonest strings, at most MOST_BROADCAST, are broadcast with their weights and the
others joined by key, of which none is common; which way a string takes does not change a score.

A null URL, or one without "://", has an empty host and path, fits no rule and is scored as it is (null as empty). Without URLs of
both kinds among the decided ones the limit is 0. A very long URL is cut into parts of PART characters that overlap by a context, so that work is in
proportion to its length. Repeated rows are judged alike (each distinct text is scored once); an empty table gives an empty result. Only the id and the
URL are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, UPPER, perhaps_in, table, written

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER, ALPHABET = 4, 256
LEAST_COUNT = 2
#: Strings whose weights are broadcast, at most, and characters in a part of a text.
MOST_BROADCAST, PART = 200_000, 2048
#: The first digit of a URL's digest, below this: held out for the limit.
HELD_OUT = "3"
STEP, EDGE = 10_000, 1000


def _judged(rules=RULES) -> str:
    """SQL: page_id, host, path, rule, said (the rule's verdict), s (the marked text), key (its digest), fold."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN ('.' || host) LIKE '%.{h}' AND path LIKE '{p}%' THEN '{what(v, h, p)}'" for v, h, p in ordered) + " END"
    return f"""
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS said, chr(2) || plain || chr(3) AS s, md5(plain) AS key, substr(md5(plain), 1, 1) AS fold
FROM (SELECT page_id, plain, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS plain, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {{pages}}) AS a) AS b"""


def parts(texts: DataFrame, *columns: str) -> DataFrame:
    """A row for each part of a text s: the columns, n (characters of the text), part (characters, those of the context before it first) and begin (the place of the first, from 0)."""
    rows = texts.select(*columns, F.split("s", "").alias("c")).withColumn("n", F.size("c"))
    one = lambda j: F.struct(F.slice("c", F.greatest(j * PART - ORDER, F.lit(0)) + 1, PART + F.least(j * PART, F.lit(ORDER))).alias("part"), F.greatest(j * PART - ORDER, F.lit(0)).alias("begin"), (j * PART).alias("own"))
    rows = rows.select(*columns, "n", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PART).cast("int")), one)).alias("p"))
    return rows.select(*columns, "n", "p.*")


def strings(texts: DataFrame, *columns: str) -> DataFrame:
    """A row for each string of 1 to ORDER + 1 characters of the texts: the columns, n, g, gram (its last character is predicted, as all but the first are) and context (another follows)."""

    def ending(i: Column) -> Column:
        place = F.col("begin") + i
        return F.transform(F.sequence(F.lit(0), F.least(i, F.lit(ORDER))), lambda k: F.struct(F.array_join(F.slice("part", i - k + 1, k + 1), "").alias("g"), (place > 0).alias("gram"), ((place < F.col("n") - 1) & (k < ORDER)).alias("context")))

    every = F.flatten(F.transform(F.sequence(F.col("own") - F.col("begin"), F.size("part") - 1), ending))
    return parts(texts, *columns).select(*columns, "n", F.explode(every).alias("x")).select(*columns, "n", "x.*")


def counts(judged: DataFrame) -> DataFrame:
    """k (length less one), g, a, r: strings that end at a predicted character and how often they occur in accepted and in rejected URLs."""
    rows = judged.where(F.col("said").isNotNull() & (F.col("fold") >= HELD_OUT)).groupBy("s").agg(F.sum((F.col("said") == "allow").cast("long")).alias("a"), F.sum((F.col("said") == "block").cast("long")).alias("r"))
    found = strings(rows, "a", "r").where("gram").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    return found.select((F.length("g") - 1).cast("long").alias("k"), "g", "a", "r")


def _duck_counts() -> str:
    """The same counts in DuckDB."""
    return f"""
SELECT k, substr(s, CAST(i - k AS INT), CAST(k + 1 AS INT)) AS g, CAST(sum(CASE WHEN said = 'allow' THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN said = 'block' THEN 1 ELSE 0 END) AS BIGINT) AS r
FROM (SELECT s, said, i, unnest(range(0, least({ORDER}, i - 1) + 1)) AS k
      FROM (SELECT s, said, unnest(range(2, length(s) + 1)) AS i FROM {{judged}} WHERE said IS NOT NULL AND fold >= '{HELD_OUT}') AS p) AS q
GROUP BY 1, 2"""


#: The power of two from which on counts are among the MOST_BROADCAST greatest.
_COMMON = f"""
SELECT coalesce(min(least), {LEAST_COUNT}) AS least FROM (
  SELECT pow(2, b) AS least, sum(n) OVER (ORDER BY b DESC) AS kept FROM (SELECT floor(log2(CAST(a + r AS DOUBLE))) AS b, count(*) AS n FROM {{counts}} WHERE a + r >= {LEAST_COUNT} GROUP BY 1) AS h) AS c
WHERE kept <= {MOST_BROADCAST}"""

_CONTEXTS = """
SELECT substr(g, 1, CAST(k AS INT)) AS x, k, sum(a) AS na, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS ta, sum(r) AS nr, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS tr
FROM {counts} GROUP BY 1, 2"""

_ORDER_0 = f"""
SELECT c.k, c.g, '' AS x, (c.a + 1.0) / (x.na + {ALPHABET}.0) AS pa, (c.r + 1.0) / (x.nr + {ALPHABET}.0) AS pr,
       CAST(round(1000000 * (ln((c.a + 1.0) / (x.na + {ALPHABET}.0)) - ln((c.r + 1.0) / (x.nr + {ALPHABET}.0)))) AS BIGINT) AS w, CAST(0 AS BIGINT) AS back
FROM {{counts}} AS c CROSS JOIN (SELECT * FROM {{contexts}} WHERE k = 0) AS x WHERE c.k = 0 AND c.a + c.r >= {LEAST_COUNT}"""


def _order(k: int) -> str:
    pa = "CASE WHEN x.na > 0 THEN (c.a + x.ta * d.pa) / (x.na + x.ta) ELSE d.pa END"
    pr = "CASE WHEN x.nr > 0 THEN (c.r + x.tr * d.pr) / (x.nr + x.tr) ELSE d.pr END"
    back = "(CASE WHEN x.na > 0 THEN ln(CAST(x.ta AS DOUBLE) / (x.na + x.ta)) ELSE 0.0 END - CASE WHEN x.nr > 0 THEN ln(CAST(x.tr AS DOUBLE) / (x.nr + x.tr)) ELSE 0.0 END)"
    return f"""
SELECT c.k, c.g, c.x, {pa} AS pa, {pr} AS pr,
       CAST(round(1000000 * (ln({pa}) - ln({pr}) - ln(d.pa) + ln(d.pr) - {back})) AS BIGINT) AS w, CAST(round(1000000 * {back}) AS BIGINT) AS back
FROM (SELECT c.k, c.g, c.a, c.r, substr(c.g, 1, {k}) AS x, substr(c.g, 2) AS lower FROM {{counts}} AS c WHERE c.k = {k} AND c.a + c.r >= {LEAST_COUNT}) AS c
JOIN {{contexts}} AS x ON x.x = c.x AND x.k = {k} JOIN {{order_{k - 1}}} AS d ON d.g = c.lower"""


_ALL = " UNION ALL ".join(f"SELECT * FROM {{order_{k}}}" for k in range(ORDER + 1))
def weights(model: DataFrame, found: DataFrame) -> DataFrame:
    """g, w (its weight as a string), back (its weight as a context; both 0 if it is none) and how often it occurs."""
    grams = model.select("g", "w", F.lit(0).cast("long").alias("back"))
    contexts = model.where("k > 0").groupBy(F.col("x").alias("g")).agg(F.max("back").alias("back")).select("g", F.lit(0).cast("long").alias("w"), "back")
    both = grams.unionByName(contexts).groupBy("g").agg(F.sum("w").alias("w"), F.sum("back").alias("back"))
    return both.join(found.select("g", (F.col("a") + F.col("r")).alias("many")), "g", "left")


def scores(texts: DataFrame, weights: DataFrame, common: DataFrame) -> DataFrame:
    """key and score: the difference by length, in millionths, of every text.

    common: one row, from which number on a string's weight is broadcast. Sums are made where the text is, so that one row a text moves; of the rarer strings only those of the texts that a filter lets through are joined."""
    split = weights.join(F.broadcast(common)).withColumn("hot", F.coalesce(F.col("many") >= F.col("least"), F.lit(False)))
    hot, cold = split.where("hot").select("g", "w", "back"), split.where("NOT hot").select("g", "w", "back")
    worth = F.when(F.col("gram"), F.col("w")).otherwise(0) + F.when(F.col("context"), F.col("back")).otherwise(0)
    rows = strings(texts, "key")
    sums = rows.join(F.broadcast(hot), "g", "left").groupBy("key", "n").agg(F.sum(F.coalesce(worth, F.lit(0).cast("long"))).alias("w"))
    if not cold.isEmpty():
        rare = perhaps_in(rows, "g", cold.select("g")).where("_maybe").drop("_maybe")
        sums = sums.unionByName(rare.join(cold, "g").groupBy("key", "n").agg(F.sum(worth).alias("w")))
    return sums.groupBy("key", "n").agg(F.sum("w").alias("w")).select("key", F.expr("CAST(floor(w / (n - 1)) AS BIGINT)").alias("score"))


_DUCK_WEIGHTS = "SELECT 'g' || g AS f, w FROM {model} UNION ALL SELECT DISTINCT 'c' || x AS f, back AS w FROM {model} WHERE k > 0"
#: The texts that a verdict or the limit needs.
_TEXTS = f"SELECT DISTINCT key, s FROM {{judged}} WHERE said IS NULL OR fold < '{HELD_OUT}'"


def _duck_scores() -> str:
    """The same scores in DuckDB."""
    parts = [f"CASE WHEN i > {k} THEN 'g' || substr(s, CAST(i - {k} AS INT), {k + 1}) END" for k in range(ORDER + 1)] + [f"CASE WHEN i > {k} THEN 'c' || substr(s, CAST(i - {k} AS INT), {k}) END" for k in range(1, ORDER + 1)]
    return f"""
SELECT t.key, CAST(floor(coalesce(sum(f.w), 0) / (length(t.s) - 1)) AS BIGINT) AS score
FROM (SELECT key, s, unnest([{', '.join(parts)}]) AS f FROM (SELECT key, s, unnest(range(2, length(s) + 1)) AS i FROM {{texts}} AS d) AS p) AS t
LEFT JOIN {{weights}} AS f ON f.f = t.f GROUP BY t.key, t.s"""


def _limit() -> str:
    """lim: the middle of the gap below the scores from which on allowing makes the least balanced error."""
    h = f"SELECT greatest(-{EDGE}, least({EDGE}, floor(s.score / {STEP}.0))) AS b, sum(CASE WHEN j.said = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN j.said = 'block' THEN 1 ELSE 0 END) AS r FROM {{judged}} AS j JOIN {{scores}} AS s ON s.key = j.key WHERE j.said IS NOT NULL AND j.fold < '{HELD_OUT}' GROUP BY 1"
    e = f"SELECT b, lag(b) OVER (ORDER BY b) AS below, nr * (sum(a) OVER (ORDER BY b) - a) + na * (sum(r) OVER (ORDER BY b DESC)) AS miss FROM (SELECT b, a, r, sum(a) OVER () AS na, sum(r) OVER () AS nr FROM ({h}) AS h) AS t WHERE na > 0 AND nr > 0"
    return f"SELECT CAST(coalesce(max({STEP} * floor((b + 1 + coalesce(below, b - 1)) / 2.0)), 0) AS BIGINT) AS lim FROM (SELECT b, below, row_number() OVER (ORDER BY miss, abs(b), b) AS n FROM ({e}) AS e) AS m WHERE n = 1"


_VERDICT = "SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.said, CASE WHEN s.score >= l.lim THEN 'allow' ELSE 'block' END) AS verdict FROM {judged} AS j LEFT JOIN {scores} AS s ON s.key = j.key CROSS JOIN {limit} AS l"


def url_verdicts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"))
    have = {"judged": written(spark.sql(_judged(rules), pages=rows), "urls")}

    def run(sql: str, name: str) -> DataFrame:
        have[name] = written(spark.sql(sql, **{k: v for k, v in have.items() if f"{{{k}}}" in sql}), name)
        return have[name]

    have["counts"] = written(counts(have["judged"]), "counts")
    common = run(_COMMON, "common")
    run(_CONTEXTS, "contexts")
    run(_ORDER_0, "order_0")
    for k in range(1, ORDER + 1):
        run(_order(k), f"order_{k}")
    model = spark.sql(_ALL, **{f"order_{k}": have[f"order_{k}"] for k in range(ORDER + 1)})
    heavy = written(weights(model, have["counts"]), "weights")
    # a text becomes some hundred rows, so the texts are spread first
    texts = spark.sql(_TEXTS, judged=have["judged"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    have["scores"] = written(scores(texts, heavy, common), "scores")
    run(_limit(), "limit")
    have["limit"] = F.broadcast(have["limit"])  # one row
    return spark.sql(_VERDICT, judged=have["judged"], scores=have["scores"], limit=have["limit"]).withColumnRenamed("page_id", id_column)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def _duck() -> str:
    steps = [("judged", _judged()), ("counts", _duck_counts()), ("contexts", _CONTEXTS), ("order_0", _ORDER_0), *[(f"order_{k}", _order(k)) for k in range(1, ORDER + 1)], ("model", _ALL), ("weights", _DUCK_WEIGHTS), ("texts", _TEXTS), ("scores", _duck_scores()), ("limits", _limit())]
    names = {n: n for n, _ in steps} | {"pages": "pages", "limit": "limits"}
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({sql.format(**names)})" for n, sql in steps) + _VERDICT.format(**names)


SQL = _duck()
