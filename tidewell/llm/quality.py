"""Quality rules: divergence of a document's histograms from those of its language.

Two histograms of each document, of character classes and of its language's common words (with one cell for all other
words), are compared with the language's own, which are summed over all documents of the table that pass the base rules.
The measure is the Jensen-Shannon distance (square root of the divergence in bits, so between 0 and 1).

What is too far follows from all documents that pass the base rules, by their length: lengths are binned (two bins an octave, from LEAST_WORDS on), and of each bin with its two neighbours
the median and the lowest tenth are taken, of word distances times the root of the length, as chance makes them fall with it. A word histogram is too far if it lies SPREADS times as far above the median as the lowest tenth lies below
it, or, from WORD_WORDS on, if it is nearly as far as that of a text with no common word at all; a class histogram if it is some times the median (MOST_CLASS, and more for short texts).
Where fewer than LEAST_KNOWN documents are of about its length, the next shorter length that is known counts, as if the document were of that length, so that it is rather spared; else the next longer one. In a language without
reference, or where no length is known, a document is not judged by divergence.

Null and empty texts have no words and fail the base rules. A language that is null or not among LANGUAGES has no
reference; a table whose documents all fail has none at all. Very long texts are measured whole, in arrays of a few numbers a word. Repeated rows are judged alike; an empty table gives an empty result; only the id, the text and the
language are read, so that other columns cannot clash.
"""

from __future__ import annotations

import json
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import SPACE, table, words, written

#: The common words whose shares are compared: usual stop words.
LANGUAGES = {
    "en": "the of and to in is it that for on by as was are with be from this or an at he have not but they which one you all".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus au pas sur ne se ce il sont avec ou son aux mais".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha este sí".split(),
}
#: Character classes, as regular expressions; what is in none of them is the last class. The first is by far the commonest.
CLASSES = ("a-z", SPACE, "A-Z", r".,;:!?'\"()\-", "#*$%&|<>", "0-9", r"\x{80}-\x{10FFFF}")
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Of a length, at least so many documents have to be known; bins of lengths go up to MOST_BIN (2 ** 40 times LEAST_WORDS).
LEAST_KNOWN, MOST_BIN = 20, 80
SPREADS, LEAST_SPREAD = 5, 0.1
#: From so many words on, this part of the distance of a text without common words is too far.
WORD_WORDS, MOST_WORD = 60, 0.96
#: Times the median: the first plus the second by the number of words.
MOST_CLASS, SHORT_CLASS = 2.5, 20


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more; hashes: of the windows, by place."""

    def places(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda k, j: F.get(pairs, j)["h"] == F.get(pairs, k)["h"]
        return F.filter(pairs, lambda _, k: F.coalesce((k > 0) & same(k, k - 1), F.lit(False)) | F.coalesce((k < n - 1) & same(k, k + 1), F.lit(False)))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    found = F.sort_array(F.transform(_let(pairs, places), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"))
    return F.aggregate(found, start, step)["n"]


def _signed(word: str) -> int:
    """Spark's xxhash64 of a word."""
    n = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


@lru_cache(maxsize=1)
def _common() -> tuple[int, str, str, dict[str, str]]:
    """A hash table for common words in lower case, with a capital and in capitals: its size, as JSON the hashes and the letters that
    stand for the words, and for each language its words' letters in order."""
    letters = {w: chr(0x100 + i) for i, w in enumerate(sorted(set().union(*LANGUAGES.values())))}
    forms = {_signed(form): letter for w, letter in letters.items() for form in (w, w.capitalize(), w.upper())}
    size = next(m for m in range(1 << 13, 1 << 20) if len({h % m for h in forms}) == len(forms))
    hashes: list[int | None] = [None] * size
    stands = [""] * size
    for h, letter in forms.items():
        hashes[h % size], stands[h % size] = h, letter
    return size, json.dumps(hashes), json.dumps(stands), {lang: "".join(letters[w] for w in ws) for lang, ws in LANGUAGES.items()}


def base_measures(docs: DataFrame, id_column: str | None = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms, as arrays of long, of every row.

    common: counts of the common words of the row's language, none if it is not among LANGUAGES. Without id_column the id
    is the whole row, as a struct."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select((F.col(f"`{id_column}`") if id_column else whole).alias("id"), F.col(f"`{lang_column}`").cast("string").alias("lang"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    rest = F.regexp_replace("t", f"[{CLASSES[0]}]+", "")
    rows = rows.select("id", "lang", F.length("t").cast("long").alias("n_chars"), rest.alias("rest"), lines.alias("lines"), F.transform(words(F.col("t")), lambda x: F.xxhash64(x)).alias("wh"))
    n = F.size("wh")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(WINDOW)]))
    size, hashes, stands, mine = _common()
    found = lambda h: F.get(F.from_json(F.lit(hashes), "array<bigint>"), F.pmod(h, F.lit(size)).cast("int")) == h
    common = F.transform("wh", lambda h: F.when(found(h), F.get(F.from_json(F.lit(stands), "array<string>"), F.pmod(h, F.lit(size)).cast("int"))).otherwise(F.lit("")))
    left = F.length("rest").cast("long")
    rows = rows.select(
        "id", "lang", "n_chars", n.cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(F.col("n_chars") - left, *[left - F.length(F.regexp_replace("rest", f"[{c}]+", "")) for c in CLASSES[1:]]).alias("c"),
        F.when(n > WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("h"), F.array_join(common, "").alias("common"),
    )
    repeated = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("long")).otherwise(_repeated(F.col("h")))
    letters = F.lit(None).cast("string")
    for lang, own in mine.items():
        letters = F.when(F.col("lang") == lang, F.lit(own)).otherwise(letters)
    counts = F.transform(F.split(letters, ""), lambda x: (F.length("common") - F.length(F.replace(F.col("common"), x))).cast("long"))
    return rows.select(
        "id", "lang", "n_words", (F.col("n_chars") - F.get("c", F.lit(CLASSES.index(SPACE)))).alias("word_chars"), F.get("c", F.lit(CLASSES.index("#*$%&|<>"))).alias("n_symbols"), "n_dup_lines", repeated.alias("n_repeat_words"),
        F.concat("c", F.array(F.col("n_chars") - F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x))).alias("classes"), counts.alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """For each of LANGUAGES with documents that pass the base rules: its histograms as shares and the distance of a text without common words. At most as many rows as LANGUAGES."""
    known = measured.where(F.col("lang").isin(*LANGUAGES) & ~base_failed())
    cells = len(next(iter(LANGUAGES.values())))
    sums = known.groupBy("lang").agg(F.array(*[F.sum(F.get("classes", F.lit(i))) for i in range(len(CLASSES) + 1)]).alias("classes"), F.array(*[F.sum(F.get("common", F.lit(i))) for i in range(cells)]).alias("common"), F.sum("n_words").alias("n"))
    refs = sums.select("lang", _shares(F.col("classes")).alias("ref_classes"), _shares(_with_rest(F.col("common"), F.col("n"))).alias("ref_common"))
    bare = F.array(*[F.lit(0.0)] * cells, F.lit(1.0))
    return refs.withColumn("bare", distance(bare, F.col("ref_common")))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _with_rest(counts: Column, total: Column) -> Column:
    return F.concat(counts, F.array(total - _total(counts)))


def _shares(counts: Column) -> Column:
    return _let(counts, lambda c: _let(_total(c), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n))))


def _entropy(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda s, p: F.when(p > 0, s - p * F.log2(p)).otherwise(s))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, given as shares; null if one of them is null."""
    middle = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), _entropy(middle) - (_entropy(p) + _entropy(q)) / 2))


def _bin() -> Column:
    return F.floor(2 * F.log2(F.col("n_words") / LEAST_WORDS)).cast("int")


def limits(far: DataFrame) -> DataFrame:
    """bin, source (the bin that counts for it), and of that and its neighbours word_median, word_tenth and class_median, from whole numbers of hundredths and thousandths; one row for each half octave of lengths.

    far: n_words, class_distance and word_distance of documents that pass the base rules."""
    cells = far.where("word_distance IS NOT NULL").select(_bin().alias("b"), F.inline(F.array(
        F.struct(F.lit("word").alias("what"), F.floor(F.col("word_distance") * F.sqrt("n_words") * 100).alias("cell")), F.struct(F.lit("class").alias("what"), F.floor(F.col("class_distance") * 1000).alias("cell")),
    ))).groupBy("b", "what", "cell").agg(F.count("*").alias("n"))
    cells = cells.select(F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("bin"), "what", "cell", "n").groupBy("bin", "what", "cell").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("bin", "what")
    cells = cells.select("*", F.sum("n").over(own.orderBy("cell")).alias("upto"), F.sum("n").over(own).alias("known"))
    at = lambda what, part: F.min(F.when((F.col("what") == what) & (F.col("upto") * part >= F.col("known")), F.col("cell")))
    found = cells.groupBy("bin").agg(F.max("known").alias("known"), (at("word", 2) / 100).alias("word_median"), (at("word", 10) / 100).alias("word_tenth"), (at("class", 2) / 1000).alias("class_median"))
    found = found.where(F.col("known") >= LEAST_KNOWN).select("bin", F.struct(F.col("bin").alias("source"), "word_median", "word_tenth", "class_median").alias("x"))
    every = cells.sparkSession.range(MOST_BIN + 1).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left")
    shorter, longer = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("bin"), F.col("bin").desc()))  # MOST_BIN + 1 rows
    return every.select("bin", F.coalesce(F.last("x", True).over(shorter), F.last("x", True).over(longer)).alias("x")).where("x IS NOT NULL").select("bin", "x.*")


def judged(measured: DataFrame) -> DataFrame:
    """measured with class_distance, word_distance (null without reference), base_failed and kept."""
    refs = references(measured)
    rows = measured.join(F.broadcast(refs), "lang", "left").select(
        "id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "bare",
        distance(_shares(F.col("classes")), F.col("ref_classes")).alias("class_distance"), distance(_shares(_with_rest(F.col("common"), F.col("n_words"))), F.col("ref_common")).alias("word_distance"),
    )
    usual = written(limits(rows.where("NOT base_failed")), "limits")
    rows = rows.withColumn("bin", F.when(~F.col("base_failed"), _bin())).join(F.broadcast(usual), "bin", "left")
    n = F.least(F.col("n_words").cast("double"), LEAST_WORDS * F.pow(F.lit(2.0), (F.col("source") + 1) / 2))
    n = F.when(F.col("source") < F.col("bin"), n).otherwise(F.col("n_words"))
    spread = F.greatest(F.col("word_median") - F.col("word_tenth"), LEAST_SPREAD * F.col("word_median"))
    far = (F.col("word_distance") * F.sqrt(n) > F.col("word_median") + SPREADS * spread) | ((n >= WORD_WORDS) & (F.col("word_distance") > MOST_WORD * F.col("bare")))
    far = F.col("source").isNotNull() & (far | (F.col("class_distance") > F.col("class_median") * (MOST_CLASS + SHORT_CLASS / n)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("bare", *usual.columns)


def quality(docs: DataFrame, id_column: str | None = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """A row for each row of docs: the base measures, both distances, base_failed and kept."""
    measured = written(base_measures(docs, id_column, text_column, lang_column), "measures")
    return judged(measured).withColumnRenamed("id", id_column or "id")


def filtered(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their columns; each row goes along with its measures, so that nothing is joined."""
    return quality(docs, None, text_column, lang_column).where("kept").select("id.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _duck() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    forms = {lang: "[" + ", ".join("[" + ", ".join(quoted(f) for f in (w, w.capitalize(), w.upper())) + "]" for w in ws) + "]" for lang, ws in LANGUAGES.items()}
    count = lambda c: f"length(t) - length(regexp_replace(t, {quoted(f'[{c}]+')}, '', 'g'))"
    entropy = lambda p: f"coalesce(list_sum([-x * log2(x) FOR x IN {p} IF x > 0]), 0)"
    far = lambda p, q: f"sqrt(greatest(0, {entropy(f'[({p}[i] + {q}[i]) / 2 FOR i IN range(1, len({p}) + 1)]')} - ({entropy(p)} + {entropy(q)}) / 2))"
    cells = len(next(iter(LANGUAGES.values())))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{SPACE}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
rep AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS b FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS c FROM win) WHERE c > 1),
again AS (SELECT rid, sum(least({WINDOW}, coalesce(i - b, {WINDOW}))) AS n FROM rep GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars, CAST({count("#*$%&|<>")} AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS n_chars,
         [{", ".join(count(c) for c in CLASSES)}] AS cs, CASE lang {" ".join(f"WHEN '{x}' THEN [len(list_filter(ws, lambda x: list_contains(f, x))) FOR f IN {fs}]" for x, fs in forms.items())} END AS ws
  FROM w LEFT JOIN again ON again.rid = w.rid),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, list_append(cs, n_chars - list_sum(cs)) AS c, list_append(ws, n_words - list_sum(ws)) AS k FROM m),
r AS (
  SELECT lang, [{", ".join(f"sum(c[{i + 1}])" for i in range(len(CLASSES) + 1))}] AS c, [{", ".join(f"sum(k[{i + 1}])" for i in range(cells + 1))}] AS k
  FROM b WHERE NOT base_failed AND lang IN ({", ".join(quoted(x) for x in LANGUAGES)}) GROUP BY lang),
q AS (SELECT rl, qc, qk, {far("z", "qk")} AS bare FROM (SELECT lang AS rl, [x / list_sum(c) FOR x IN c] AS qc, [x / list_sum(k) FOR x IN k] AS qk, [CAST(i = {cells + 1} AS DOUBLE) FOR i IN range(1, {cells + 2})] AS z FROM r)),
p AS (SELECT b.*, qc, qk, bare, [x / list_sum(c) FOR x IN c] AS pc, [x / list_sum(k) FOR x IN k] AS pk FROM b LEFT JOIN q ON rl = lang),
e AS (SELECT *, CASE WHEN qc IS NOT NULL THEN {far("pc", "qc")} END AS dc, CASE WHEN qk IS NOT NULL THEN {far("pk", "qk")} END AS dk, CASE WHEN NOT base_failed THEN CAST(floor(2 * log2(n_words / {LEAST_WORDS})) AS BIGINT) END AS bin FROM p),
h AS (SELECT bin + unnest([-1, 0, 1]) AS bin, floor(dk * sqrt(n_words) * 100) AS w, floor(dc * 1000) AS c FROM e WHERE NOT base_failed AND dk IS NOT NULL),
l AS (SELECT bin, struct_pack(source := bin, wm := quantile_disc(w, 0.5) / 100, wt := quantile_disc(w, 0.1) / 100, cm := quantile_disc(c, 0.5) / 1000) AS x FROM h GROUP BY bin HAVING count(*) >= {LEAST_KNOWN}),
g AS (
  SELECT bin, coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING), last_value(x IGNORE NULLS) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)) AS x
  FROM (SELECT unnest(range(0, {MOST_BIN + 1})) AS bin) AS every LEFT JOIN l USING (bin)),
o AS (SELECT e.*, x.wm AS wm, x.wt AS wt, x.cm AS cm, CASE WHEN x.source < e.bin THEN least(CAST(n_words AS DOUBLE), {LEAST_WORDS} * pow(2.0, (x.source + 1) / 2)) ELSE n_words END AS n FROM e LEFT JOIN g ON g.bin = e.bin)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(dk * sqrt(n) > wm + {SPREADS} * greatest(wm - wt, {LEAST_SPREAD}::DOUBLE * wm) OR n >= {WORD_WORDS} AND dk > {MOST_WORD}::DOUBLE * bare
                                        OR dc > cm * ({MOST_CLASS}::DOUBLE + {SHORT_CLASS}::DOUBLE / n), FALSE) AS kept
FROM o"""



SQL = _duck()
