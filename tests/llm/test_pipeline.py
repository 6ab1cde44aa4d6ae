"""The pipeline and the registered queries against brute force on the small tables."""

import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import jaccard_components, mixed_draws
from tidewell.llm import mixing, pieces, queries, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    expected = con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(dict(zip(expected.columns, r, strict=True))[c] for c in columns) for r in expected.fetchall()), key=key)


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11))


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    groups = jaccard_components({i: rows[i]["text"] for i in kept}, 5, 80)
    firsts = sorted(i for i in kept if groups[i][1] == i)
    left = spark.createDataFrame([rows[i] for i in firsts], docs.schema)
    takes = mixed_draws([(i, rows[i]["source"], len(WORD.findall(rows[i]["text"]))) for i in firsts], mixing.BLOCK_WORDS, mixing.SEED)
    machine = pieces.transducer(pieces.MODEL)
    expected = []
    for i, first, end in takes:
        text = rows[i]["text"]
        spans = [m.span() for m in WORD.finditer(text)]
        whole = first == 0 and end == len(spans)
        expected.append((i, machine.encode(text if whole else text[0 if first == 0 else spans[first][0] : spans[end - 1][1]])))
    assert sorted((r["doc_id"], r["ids"]) for r in out) == sorted(expected)
    assert all(r["round_trip"] for r in out)


def test_stages_on_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    fine = " ".join(f"the word{i} of and to" for i in range(60))
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, fine, "en", "a", len(fine)), (3, fine, "en", "a", len(fine)), (None, fine + " x", None, None, 3)], schema)
    wide = odd.selectExpr("*", "1 AS row", "2 AS id", "3 AS _id", "4 AS kept", "5 AS _maybe", "6 AS _row", "7 AS n_words", "8 AS ids")
    for table in (odd, odd.limit(0), wide):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()
    assert corpus_pipeline.near_duplicates(spark, odd, SF).where("doc_id = 3").count() == 1
