import pytest
import json

from pyspark.sql import functions as F

from lodestrand.operators import ingest
from lodestrand.sources import files, report
from lodestrand.sources.store import Table
from lodestrand.streaming import windows
from tests.conftest import rows


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# 标题\n\n正文", encoding="utf-8")
    (tmp_path / "sub" / "b.txt").write_bytes("中文说明".encode("gb18030"))
    (tmp_path / "c.txt").write_text(" \n")
    (tmp_path / "~$d.md").write_text("x")
    (tmp_path / ".e.md").write_text("x")
    (tmp_path / "f.zip").write_bytes(b"x")
    got = {r["source"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.md", "c.txt", "sub/b.txt"]
    assert got["a.md"]["title"] == "标题" and got["sub/b.txt"]["text"] == "中文说明" and got["c.txt"]["error"] == "empty"
    assert got["a.md"]["doc_id"].startswith("doc_")
    assert [r["name"] for r in files.files(spark, str(tmp_path)).where("rejected").collect()] == ["f.zip"]


def test_evaluation_set_and_anchors(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"name": "n", "version": "1", "items": [{"id": "Q1", "question": "q", "expected_sources": ["a.md"], "must_refuse": False, "turn": 2}]}))
    item = files.evaluation_set(spark, str(tmp_path / "set.json")).first()
    assert (item["id"], item["turn"], item["expected_sources"], item["dataset"]) == ("Q1", 2, ["a.md"], "n")
    (tmp_path / "p.md").write_text("---\nanchors:\n  - app/x.py\n  - app/y.py\n---\ntext")
    (tmp_path / "q.md").write_text("text")
    assert rows(files.anchors(spark, str(tmp_path)).na.fill("-")) == [("p.md", "bound", "app/x.py"), ("p.md", "bound", "app/y.py"), ("q.md", "unbound", "-")]
    (tmp_path / "report_1.json").write_text('{"dataset": "d", "run": "r1"}')
    (tmp_path / "report_2.json").write_text("{broken")
    assert [r["file"] for r in files.reports(spark, str(tmp_path)).collect()] == ["report_1.json"]
    assert files.registry(spark, str(tmp_path / "none")).count() == 0


def test_reports(spark, tmp_path):
    summary = spark.createDataFrame([("a", 1), (None, 2)], "label string, n int")
    assert report.save(spark, str(tmp_path), "set", {"labels": summary, "none": summary.limit(0)}, "r1") == "r1"
    assert [r["run"] for r in files.reports(spark, str(tmp_path)).collect()] == ["r1"]
    assert "| a | 1 |\n|  | 2 |" in (tmp_path / "report_r1.md").read_text()


def test_table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k int, v string")
    rows_of = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    assert rows(t.read()) == []
    t.write(rows_of((1, "a"), (2, "b")))
    t.upsert(rows_of((2, "c"), (3, "d")), ["k"])
    assert rows(t.read()) == [(1, "a"), (2, "c"), (3, "d")]
    assert t.insert_new(rows_of((3, "x"), (4, "e"), (4, "e")), ["k"]) == 1
    assert t.delete(rows_of((1, "")), ["k"]) == 1
    t.replace_latest(rows_of((4, "z")), ["k"], "v")
    assert rows(t.read()) == [(2, "c"), (3, "d"), (4, "z")]
    t.reset()
    assert rows(t.read()) == []


def test_stream_ingest_and_buffer(spark, tmp_path):
    inbox, schema = tmp_path / "in", "source string, checksum string, n_chars int"
    registry = Table(spark, str(tmp_path / "registry"), schema)
    plan = lambda new, old: new.join(ingest.plan(new, old, only=[r["source"] for r in new.select("source").collect()]).where("status = 'indexed'").select("source"), "source", "left_semi")
    for n in (1, 2):
        spark.createDataFrame([("a", str(n), 5), ("b", "1", 5)], schema).write.mode("append").parquet(str(inbox))
        windows.ingest(spark, str(inbox), schema, registry, plan, str(tmp_path / "log"))
        assert rows(registry.read()) == [("a", str(n), 5), ("b", "1", 5)]
    events = spark.createDataFrame([(k, "x") for k in range(7)], "event_id long, event_type string")
    events.write.parquet(str(tmp_path / "events"))
    seen = []
    stream = windows.ring_buffer(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), 5)
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(rows(df))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen[-1] == ("x", 5, 2)


def test_batch_windows(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert windows.unique(events.unionByName(events), ["event_id"]).count() == events.select("event_id").distinct().count()
    assert windows.counted(events, "1 hour").agg(F.sum("n")).first()[0] == events.count()


def test_clusters_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from lodestrand import session

    conf = SimpleNamespace(get=lambda key: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://x:7077"))
    with pytest.raises(RuntimeError):
        session.shared_folder(cluster)
    assert session.shared_folder(spark)


def test_writes_touch_their_buckets_only(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k int, v string", ["k"], 8)
    rows_of = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    t.write(rows_of(*((k, "a") for k in range(40))))
    before = t.parts()
    t.upsert(rows_of((3, "new")), ["k"])
    after = t.parts()
    changed = {b for b in before if before[b] != after.get(b)}
    assert len(changed) == 1 and len(before) > 4 and dict(rows(t.read()))[3] == "new" and t.read().count() == 40
    t.append(rows_of((100, "x")))
    assert sum(len(p) for p in t.parts().values()) == len(after) + 1
    assert t.delete(rows_of((3, "")), ["k"]) == 1 and t.delete(rows_of((999, "")), ["k"]) == 0
    whole = rows(t.read())
    assert t.vacuum(1) >= 1 and rows(t.read()) == whole


def test_second_writers_fail(spark, tmp_path):
    one, two = (Table(spark, str(tmp_path / "t"), "k int") for _ in "ab")
    one.write(spark.createDataFrame([(1,)], "k int"))
    base = two._start()
    one.append(spark.createDataFrame([(2,)], "k int"))
    (tmp_path / "t" / f"lock-{one.version() + 1}").touch()
    with pytest.raises(RuntimeError):
        two.append(spark.createDataFrame([(3,)], "k int"))
    (tmp_path / "t" / f"lock-{one.version() + 1}").unlink()
    with pytest.raises(RuntimeError):  # what was read before the other's write mustn't replace it
        two._commit(two.read(), None, base)
    assert base == 1 and rows(two.read()) == [(1,), (2,)]


def test_registry_faults_are_not_an_empty_registry(spark, tmp_path):
    assert rows(files.registry(spark, str(tmp_path / "none"))) == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        files.registry(spark, str(tmp_path / "bad")).collect()


def test_stored_index_follows_updates(spark, tmp_path):
    from lodestrand.operators.keyword_index import StoredIndex

    index = StoredIndex(spark, str(tmp_path / "i"), "long", 8)
    asked = spark.createDataFrame([("q", "brake oil")], "item_id string, text string")
    put = lambda *x: index.update(spark.createDataFrame(list(x), "id long, text string"), "id", F.col("text"))
    put((1, "brake pads"), (2, "engine oil and more oil"), (3, "nothing here"), (4, ""), (5, None))
    assert {r["id"] for r in index.search(asked, 5).collect()} == {1, 2}
    put((2, "tyres"), (3, "brake oil"))
    assert [r["id"] for r in index.search(asked, 5).orderBy("rank").collect()][0] == 3 and 2 not in {r["id"] for r in index.search(asked, 5).collect()}
    assert index.remove(spark.createDataFrame([(3,), (9,)], "id long")) == 1
    assert [r["id"] for r in index.search(asked, 5).collect()] == [1]
