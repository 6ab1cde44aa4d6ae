import pytest
from pyspark.sql import functions as F

from tidewell.engine import Engine
from tidewell.errors import InsertError, QueryError
from tidewell.plans.parser import parse
from tidewell.sources.readers import csv_points, json_points
from tidewell.sources.store import Store
from tidewell.streaming.ingest import bucket_stream, into_store


def test_store_prunes_slices(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/points", 100)
    own = Engine(spark, store=store, time_precision="s")
    own.insert({"a": [[t, t] for t in range(0, 1000, 50)], "b": [[5, "x"]]})
    own.insert({"a": [[1, 2.7]]})
    span = parse("select * from * between 200 and 300").body.span
    plan = store.read(span)._jdf.queryExecution().executedPlan().toString()
    assert "shard_start" in plan and "PartitionFilters: [isnotnull(shard_start" in plan
    assert own.run('select count() from "a" between 200 and 300') == {"a": [[250, 2]]}
    assert own.run('select * from "a" head 2') == {"a": [[0, 0], [1, 2]]}
    own.run("drop series 'b'")
    assert own.run("count series") == {"series": 1}
    assert store.expire(f"file://{tmp_path}/kept", 500).read().agg(F.min("ts")).first()[0] == 500
    assert own.store.compact(f"file://{tmp_path}/small").read().count() == 21


def test_tee_and_stream(spark, tmp_path):
    own = Engine(spark, time_precision="s")
    seen = []
    own.tees.append(lambda df: seen.append(df.count()))
    own.insert({"a": [[t, float(t)] for t in range(1, 31)]})
    assert seen == [30]
    own.points().write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(own.points().schema).parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/out", 10)
    into_store(stream, store, f"file://{tmp_path}/progress").awaitTermination()
    assert Engine(spark, store=store, time_precision="s").run("select sum(10) from *") == own.run("select sum(10) from *")
    query = bucket_stream(stream, 10).writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["label"], r["n"], r["total"]) for r in spark.sql("SELECT * FROM buckets").collect()) == [(10, 10, 55.0), (20, 10, 155.0), (30, 10, 255.0)]


def test_frames_and_files(spark, tmp_path):
    own = Engine(spark, time_precision="s")
    (tmp_path / "a.csv").write_text("series,ts,value\na,1,1.5\na,2,2.5\n")
    (tmp_path / "b.json").write_text('{"name": "b", "points": [[3, 4], [3, 5]]}\n{"name": "a", "points": [[3, 7]]}\n')
    own.insert_frame(csv_points(spark, f"file://{tmp_path}/a.csv"))
    own.insert_frame(json_points(spark, f"file://{tmp_path}/b.json", "long"))
    assert own.run("select * from *") == {"a": [[1, 1.5], [2, 2.5], [3, 7.0]], "b": [[3, 4], [3, 5]]}
    with pytest.raises(InsertError):
        own.insert_frame(spark.sql("SELECT 'a' AS series, 1.5D AS ts, 1 AS value"))
    with pytest.raises(InsertError, match="out-of-range"):
        own.insert_frame(spark.sql("SELECT 'a' AS series, -1 AS ts, 1 AS value"))
    assert own.run("select * from *")["b"] == [[3, 4], [3, 5]]


def test_tcp_tee(spark):
    import json
    import socketserver
    import threading

    lines = []

    class Keep(socketserver.StreamRequestHandler):
        def handle(self):
            lines.extend(self.rfile.read().splitlines())

    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Keep) as server:
        server.daemon_threads, server.block_on_close = False, True
        threading.Thread(target=server.serve_forever, daemon=True).start()
        own = Engine(spark, time_precision="s")
        assert "configured tee" in own.run(f"alter database set tee '127.0.0.1:{server.server_address[1]}'")["success_msg"]
        own.insert({"a": [[1, 2], [3, "4"]], "b": [[5, "x"]]})
        assert own.run("alter database set tee false") == {"success_msg": "Successfully disabled tee."}
        own.insert({"a": [[9, 9]]})
        server.shutdown()
    assert sorted((x["name"], x["points"]) for x in map(json.loads, lines)) == [("a", [[1, 2]]), ("a", [[3, 4]]), ("b", [[5, "x"]])]
    with pytest.raises(QueryError, match="Invalid tee address"):
        own.run("alter database set tee 'x:y'")


def test_drops_touch_only_their_slices(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/p", 604_800)
    own = Engine(spark, store=store, time_precision="s", timezone="UTC")
    week = 604_800
    own.insert({"a": [[k * week + 5, k] for k in range(4)], "b": [[week + 7, "x"], [2 * week + 7, "y"]], "c": [[3 * week + 9, 1.5]]})
    files = lambda: {str(f.relative_to(tmp_path)) for f in (tmp_path / "p").rglob("*.parquet")}
    before = files()
    assert own.run(f"drop shards where start == {week} and type == number")["success_msg"] == "Successfully dropped 1 shards."
    after = files()
    untouched = {f for f in before if f"shard_start={week}/" not in f}
    assert untouched <= after and not (before - untouched) & after
    assert own.run("select * from *") == {"a": [[5, 0], [2 * week + 5, 2], [3 * week + 5, 3]], "b": [[week + 7, "x"], [2 * week + 7, "y"]], "c": [[3 * week + 9, 1.5]]}
    own.run('drop series "c"')
    assert {f for f in files() if "shard_start=0/" in f} == {f for f in before if "shard_start=0/" in f}
    own.insert({"c": [[1, "text now"]]})  # its old type is gone with it
    assert own.run('select * from "c"') == {"c": [[1, "text now"]]}
    own.insert({"a": [[2, "17 apples"]]})
    assert own.run('select * from "a" before 4') == {"a": [[2, 17]]}
