"""Claims, tables, ingest, serving, evaluation and audits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import metrics as M
from lodestrand.operators import audit, claims, evaluation, ingest, serving, tables
from tests.conftest import rows


def test_change_classes(spark):
    df = spark.createDataFrame([("5 km", "5 km", None, None, [], []), ("5 km", "5km", "5km", "5km", [], ["x"]), ("5 km", "6 km", "5km", "6km", [], []), ("a", "b", None, None, [], [])], "a string, b string, c string, d string, e array<string>, f array<string>")
    assert [r[0] for r in df.select(claims.change_class(*(F.col(c) for c in "abcdef"))).collect()] == ["unchanged", "qualifier_changed", "modified", "modified"]
    df = spark.createDataFrame([("modified", "interval"), ("removed", "spec"), ("qualifier_changed", "interval"), ("added", "policy"), ("unchanged", "policy")], "c string, t string")
    assert [r[0] for r in df.select(claims.severity(F.col("c"), F.col("t"))).collect()] == ["high", "medium", "medium", "low", "none"]


def test_keys_and_evidence(spark):
    df = spark.createDataFrame([("s", "t", "u", "p", "换 机油", "每次换机油。"), ("s", "t", "u", "p", "", "x")], "a string, b string, c string, d string, e string, t string")
    got = df.select(claims.claim_key(*(F.col(c) for c in "abcd")), claims.evidence_holds(F.col("e"), F.col("t"))).collect()
    assert got[0][0].startswith("ck_") and len(got[0][0]) == 19 and [r[1] for r in got] == [True, False]
    q = spark.createDataFrame([('["b","a"]',), ("[",), (None,)], "q string").select(claims.qualifiers(F.col("q")))
    assert [r[0] for r in q.collect()] == [["a", "b"], [], []]


def test_extracted_claims(spark):
    texts = ['x ```json\n[{"k": 1,}, {"k": 2}]\n``` y', "none", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(claims.tolerant_json(F.col("t"), "array<struct<k:int>>").alias("j"))
    assert [None if r["j"] is None else [x["k"] for x in r["j"]] for r in df.collect()] == [[1, 2], None, None]
    found = spark.createDataFrame([("c", "换 机油"), ("c", "轮胎"), ("c", ""), ("d", "x")], "chunk_id string, evidence string")
    assert rows(claims.accepted(found, spark.createDataFrame([("c", "每次换机油。")], "chunk_id string, text string"))) == [("c", "换 机油")]


def test_markdown_tables(spark):
    text = "x\n| 故障码 | 中文描述 |\n| --- | --- |\n| P0300 | 失火 |\n| P0300–P0399 | 区间 |\n| C1234 | 轮速 |\n\n| 保养项目 | 周期 |\n|---|---|\n| 机油 | 8,000 km 或 8 个月 |"
    found = tables.table_rows(spark.createDataFrame([("d", text), ("d", text), ("e", None), ("f", "")], "doc_id string, text string")).cache()
    assert found.count() == 4
    assert rows(tables.fault_codes(found)) == [("d", "C1234", "轮速", "", ""), ("d", "P0300", "失火", "", "")]
    assert rows(tables.maintenance(found)) == [("d", "机油", "8,000 km 或 8 个月", 8000, 8)]
    df = spark.createDataFrame([("8,000 km 或 8 个月",), ("1.6万公里",), ("2 年",), ("免维护",), (None,), ("1.5 年",), ("0.5年",), ("1.5 个月",), ("16，000 千米",), ("3 月",)], "t string")
    assert [tuple(r) for r in df.select(*tables.period(F.col("t"))).collect()] == [(8000, 8), (16000, None), (None, 24), (None, None), (None, None), (None, 18), (None, 6), (None, 1), (16000, None), (None, None)]
    models = spark.createDataFrame([("车型A",), (" 车型 A ",), ("别的",)], "m string").select(tables.car_model(F.col("m"), {"车型 A": "标准"}))
    assert [r[0] for r in models.collect()] == ["标准", "标准", "别的"]


def test_ingest_plan(spark):
    now = spark.createDataFrame([("a", "1", 5), ("b", "2", 5), ("c", "3", 5), ("d", None, 0)], "source string, checksum string, n_chars int")
    before = spark.createDataFrame([("a", "1"), ("b", "0"), ("x", "9")], "source string, checksum string")
    plan = ingest.plan(now, before)
    assert rows(plan) == [("a", "skipped", "known"), ("b", "indexed", "known"), ("c", "indexed", "new"), ("d", "failed", "new"), ("x", "deleted", "known")]
    assert {r["status"] for r in ingest.plan(now, before, rebuild=True).where("source = 'a'").collect()} == {"indexed"}
    assert rows(ingest.plan(now, before, only=["b"])) == [("b", "indexed", "known")]
    assert rows(ingest.apply(before, now, plan).select("source", "checksum")) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_percentiles(spark):
    df = spark.createDataFrame([("e", float(v)) for v in (100, 200, 300, 400)] + [("f", 1.0), ("f", None), (None, 2.0)], "event_type string, value double")
    got = {r["endpoint"]: (r["n"], r["p50"], r["p95"], r["most"]) for r in serving.request_metrics(df).collect()}
    assert got["e"] == (4, 300.0, 400.0, 400.0) and got["f"] == (1, 1.0, 1.0, 1.0) and got["overall"][0] == 6
    assert spark.createDataFrame([([1, 2, 3, 4],)], "v array<int>").select(serving.percentile(F.col("v"), F.size("v"), 0.5)).first()[0] == 3


def test_cache_and_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, "q", t0 + dt.timedelta(seconds=s)) for k, s in enumerate((0, 50, 99, 100, 150, 500))], "event_id long, key string, ts timestamp")
    assert [r["hit"] for r in serving.cache_replay(df, "key", "ts", "event_id", 100).orderBy("event_id").collect()] == [False, True, True, False, True, False]
    turns = spark.createDataFrame([("s", f"i{k}", k, "q", "a" * 300) for k in range(9)] + [(None, "z", 1, "q", "a")], "session_id string, id string, turn int, question string, ground_truth string")
    assert sorted(r["turn"] for r in serving.last_turns(turns).collect()) == [3, 4, 5, 6, 7, 8]
    assert serving.history(turns).first()["history"].count("Q: ") == 3
    kept, dropped = serving.ring(turns, [F.desc("turn"), "id"], 4)
    assert (kept.count(), dropped) == (4, 6)


def test_ranking(spark):
    hits = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False), (2, 1, False), (2, 2, False), (2, 3, True), (3, 1, False)], "query_id int, rank int, flag boolean")
    got = {r["query_id"]: (r["rr"], r["ndcg"], r["precision"]) for r in evaluation.rank_metrics(hits, 5).collect()}
    assert got == {1: (1.0, 1.0, 0.3333), 2: (0.3333, 0.5, 0.3333), 3: (0.0, 0.0, 0.0)}
    f1 = evaluation.token_f1(spark.createDataFrame([(1, "机油 oil", "机油 oil"), (2, "aa", "bb"), (3, "aa", None)], "k int, a string, b string"), "k", "a", "b")
    assert rows(f1) == [(1, 1.0), (2, 0.0), (3, None)] if all(r[1] is not None for r in rows(f1)[:2]) else False


def test_labels(spark):
    cases = [
        ((True, False, False, False, False, True, 1.0, 1, 0, 0, 1.0), "error"), ((False, True, None, False, False, True, 1.0, 1, 0, 0, 1.0), "not_evaluated"), ((False, False, False, True, False, True, 1.0, 1, 0, 0, 1.0), "citation_out_of_range"),
        ((False, True, True, False, False, False, None, None, 0, 0, 0.0), "ok"), ((False, True, False, False, False, False, None, None, 0, 0, 0.0), "missed_refusal"), ((False, False, True, False, True, True, 1.0, 1, 0, 0, 1.0), "wrong_refusal"),
        ((False, False, True, False, False, True, 1.0, 1, 0, 0, 1.0), "evidence_miss"), ((False, False, True, False, False, False, None, None, 0, 0, 1.0), "wrong_refusal"), ((False, False, False, False, False, True, 0.0, None, 0, 0, 1.0), "retrieval_miss"),
        ((False, False, False, False, False, True, 1.0, 4, 0, 0, 1.0), "ranking_low"), ((False, False, False, False, False, True, 1.0, 1, 5, 2, 1.0), "attribution_weak"), ((False, False, False, False, False, True, 1.0, 1, 2, 2, 0.4), "answer_mismatch"),
        ((False, False, False, False, False, True, 1.0, 1, 2, 2, 0.5), "ok"),
    ]
    schema = "a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g double, h int, i int, j int, k double"
    df = spark.createDataFrame([c for c, _ in cases], schema)
    assert [r[0] for r in df.coalesce(1).select(M.failure(*(F.col(c) for c in "abcdefghijk"))).collect()] == [x for _, x in cases]


def test_relevance(spark):
    df = spark.createDataFrame([("d/a.md", "xyz", ["a.md"], []), ("b.md", "xyz", ["a.md"], []), ("a.md", "xyz", ["a.md"], ["q", "y"]), ("a.md", "xyz", ["a.md"], ["q"])], "s string, t string, e array<string>, n array<string>")
    assert [r[0] for r in df.select(M.relevant(*(F.col(c) for c in "sten"))).collect()] == [True, False, True, False]
    form = spark.createDataFrame([("１,０００ Km",), (None,)], "t string").select(M.match_form(F.col("t")))
    assert [r[0] for r in form.collect()] == ["1000km", None]
    commas = spark.createDataFrame([("16, 000",), ("16,000",), ("| 1,000 |",)], "t string").select(M.match_form(F.col("t")), M.snippet_form(F.col("t"))).collect()
    assert [tuple(r) for r in commas] == [("16,000", "16,000"), ("16000", "16000"), ("|1000|", "1000")]


def test_consecutive_tables():
    row, rule = "| a | b |", "|---|---|"
    assert [(n, len(body)) for n, _, body in tables.tables("\n".join([row, rule, row, row, rule, row]))] == [(1, 2)]
    assert [n for n, _, _ in tables.tables("\n".join([rule, row]))] == [] and [len(b) for _, _, b in tables.tables("\n".join([row, rule]))] == [0]
    assert list(tables.tables(None)) == []


def test_excused_against_windows():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(200):
        marks = np.array(sorted((a, a + int(r.integers(1, 30))) for a in r.integers(0, 400, int(r.integers(0, 6))).tolist()), np.int64).reshape(-1, 2)
        hits = np.array([(a, a + 3) for a in r.integers(0, 400, 5).tolist()], np.int64)
        assert audit.excused(hits, marks, 20).tolist() == [any(s >= a - 20 and e <= b + 20 for s, e in marks) for a, b in hits.tolist()]


def test_normal_values_and_recheck(spark):
    given = ["每 8,000 km 或每 8 个月（以先到者为准）", "每 2 年", "1.5 万公里", "3 mm 20%", "没有", None, "16， 000km"]
    assert [claims.normal_value(v) for v in given] == ["8000km|8month", "2year", "15000km", "20%|3mm", None, None, "0km"]
    versions = spark.createDataFrame([(1, "d"), (2, "d")], "id long, doc_source string")
    own = [(1, 1, "a", "spec", "s", "x", None, "[]", "油 每年换"), (2, 1, "b", "policy", "s", "5 km", None, "[]", "已删"), (3, 1, "e", "spec", "s", "8,000 km", None, "[]", ""), (4, 2, "e", "spec", "s", "8000km", None, "[]", ""), (5, 2, "n", "spec", "s", "词", None, "[]", ""), (6, 2, "m", "spec", "s", "5 km", None, "[]", "")]
    found = spark.createDataFrame(own, "id long, version_id long, claim_key string, claim_type string, subject string, value string, value_normalized string, qualifiers string, evidence string")
    texts = spark.createDataFrame([("d", "机油每年 换一次")], "doc_source string, text string")
    got = {r["claim_key"]: (r["change"], r["severity"]) for r in claims.diff_latest(versions, found, texts).collect()}
    assert got == {"a": ("removed", "recheck"), "b": ("removed", "high"), "e": ("unchanged", "none"), "n": ("added", "recheck"), "m": ("added", "low")}


def test_gates_and_histories(spark):
    from lodestrand.operators import answering as A

    hits = spark.createDataFrame([("a", 0.5, 0.9), ("b", 0.001, 0.9), ("c", 0.5, 0.01)], "query_id string, score double, vector_score double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    assert [r["reason"] for r in A.gate(asked, hits, "vector").orderBy("query_id").collect()] == [None, "low_evidence", "low_similarity", "empty"]
    assert [r["reason"] for r in A.gate(asked, hits, "hybrid", 0).orderBy("query_id").collect()] == [None, None, None, "empty"]
    df = spark.createDataFrame([(5, 2, 0.4), (5, 2, 0.5), (1, 1, 0.1), (4, 1, 0.1), (4, 4, 0.0), (None, None, 0.5)], "t int, u int, r double")
    assert [df.where(F.col("r") == r["r"]).select(A.invented(F.col("t"), F.col("u"), r["r"])).first()[0] for r in df.limit(2).collect()] == [True, False]
    judged = spark.createDataFrame([("x", 0, [1, 9]), ("x", 1, [])], "answer_id string, clause int, cited array<int>")
    cites = spark.createDataFrame([("x", 1, "s", "t", 3)], "answer_id string, index int, source string, section string, position int")
    assert rows(A.clause_sources(judged, cites).select("clause", "index", "source", "position", "invalid")) == [(0, 1, "s", 3, False), (0, 9, "", 0, True)]
    turns = spark.createDataFrame([("s", 1, "q1", "a" * 300, False), ("s", 2, "q2", "", True), ("s", 3, "", "x", False), ("s", 4, "q4", "b", None)], "session_id string, back int, question string, answer string, refused boolean")
    block = A.history_block(turns).first()["block"]
    assert block.split("\n")[:3] == ["问：q4", "答：b", "问：q2（上轮未回答）"] and block.endswith("a" * 200 + "…") and "q4" not in A.rewrite_block(turns).first()["block"]
    keys = spark.createDataFrame([(None, False, 1, None, 5, " q "), ("s", False, 2, "hybrid", 5, "q"), ("", True, 2, "hybrid", 5, None)], "s string, d boolean, v int, m string, k int, q string")
    assert [tuple(r) for r in keys.select(A.cacheable(F.col("s"), F.col("d")), A.cache_key(*map(F.col, "vmkq"))).collect()] == [(True, "v1|auto|k5|q"), (False, "v2|hybrid|k5|q"), (False, "v2|hybrid|k5|")]
    report = spark.createDataFrame([(5, 0, 0.5), (3, 0, 0.1), (3, 1, 0.9)], "total int, unsupported int, score double")
    assert [r[0] for r in report.select(A.reflection(report, F.lit(0))).collect()] == ["retry", "pass", "retry"] and report.select(A.reflection(report, F.lit(1))).first()[0] == "pass"


def test_request_rates(spark):
    given = [(dt.datetime(2024, 1, 1), True, False, False, None, None), (dt.datetime(2024, 1, 2), False, True, False, 1_000_000, 500_000), (dt.datetime(2024, 1, 3), False, False, None, 0, 0), (dt.datetime(2024, 1, 3), False, False, True, 1, None)]
    df = spark.createDataFrame(given, "ts timestamp, cache_hit boolean, refused boolean, error boolean, prompt_tokens long, completion_tokens long")
    got = serving.request_rates(df, 2.0, 8.0).first()
    assert (got["n"], got["cache_hit_rate"], got["refusal_rate"], got["error_rate"], got["total_tokens"], got["n_with_usage"], got["cost"]) == (4, 0.25, 0.25, 0.25, 1_500_001, 2, 6.0)
    assert serving.request_rates(df.limit(0)).first()["n"] == 0 and serving.request_rates(df).first()["cost"] is None


def test_running_sums(spark):
    from lodestrand.operators.ordering import running

    given = [("a" if k % 3 else "b", k, k % 5) for k in range(500)]
    got = sorted(tuple(r) for r in running(spark.createDataFrame(given, "g string, v int, c long"), ["g", "v"], "c", "upto", 7).collect())
    total = 0
    for (g, v, c), row in zip(sorted(given), got):
        total += c
        assert row == (g, v, c, total)


def test_audits(spark):
    df = spark.createDataFrame([(1, "key sk-abcdefghij0123456789"), (2, "x"), (3, None), (4, "厂家内部资料"), (5, "本文为虚构，不含厂家内部资料"), (6, "丰田"), (7, "gov.cn 丰田")], "doc_id int, text string")
    assert [r["doc_id"] for r in audit.secrets(df, "doc_id", "text").collect()] == [1]
    makers = (*audit.RISKS, ("丰田", "中"))
    assert rows(audit.risks(df, "doc_id", "text", makers).select("id", "level")) == [(4, "高"), (6, "中")]
    impact = audit.anchor_impact(spark.createDataFrame([("p1", "a"), ("p2", "b")], "page string, path string"), spark.createDataFrame([("a", False), ("b", True), ("c", False)], "path string, deleted boolean"))
    assert rows(impact.na.fill("-")) == [("a", "p1", "affected"), ("b", "p2", "broken"), ("c", "-", "uncovered")]


@pytest.mark.parametrize("weights", [{"x": 0.5, "y": 1.0}])
def test_signals(spark, weights):
    df = spark.createDataFrame([(True, 1.0, 0.0), (False, 0.0, 0.0), (False, 0.5, 1.0)], "flag boolean, x double, y double")
    assert rows(evaluation.signal_discrimination(df, "flag", weights)) == [("x", 1.0, 0.25, 0.75, 0.5), ("y", 0.0, 0.5, -0.5, 0.0)]


def test_ingest_runs(spark, tmp_path):
    from lodestrand.sources.store import Table

    registry, runs = Table(spark, str(tmp_path / "r"), "source string, checksum string, n_chars int", ["source"], 4), Table(spark, str(tmp_path / "runs"), ingest.LAST_RUN, ["version"], 2)
    given = lambda *x: spark.createDataFrame(list(x), "source string, checksum string, n_chars int")
    assert ingest.run(registry, runs, given(("a", "1", 3), ("b", "1", 3), ("c", None, 0))) == {"indexed": 2, "skipped": 0, "failed": 1, "deleted": 0, "version": 1}
    assert ingest.run(registry, runs, given(("a", "1", 3), ("b", "1", 3)))["version"] == 1
    assert ingest.run(registry, runs, given(("a", "2", 3)))["deleted"] == 1 and rows(registry.read()) == [("a", "2", 3)]
    assert runs.read().count() == 3


def test_extraction_of_a_version(spark):
    chunks = spark.createDataFrame([("c1", "d", "s", "机油每 8,000 km 更换"), ("c2", "d", "s", "轮胎 230 kPa"), ("c3", "d", "s", "新段落每 2 年")], "chunk_id string, doc_source string, section string, text string")
    from lodestrand.functions import text as X

    known = chunks.where("chunk_id = 'c2'").select("chunk_id", X.content_hash(F.col("text")).alias("content_hash"))
    old = spark.createDataFrame([("ck_old", "d", "s", "spec", "轮胎", "气压", "230 kPa", None, "[]", "轮胎", "c2"), ("ck_gone", "d", "s", "spec", "x", "y", "z", None, "[]", "x", "c1")], claims.CLAIM)
    seen = []

    def extractor(fresh):
        seen.extend(r["chunk_id"] for r in fresh.collect())
        return fresh.select("chunk_id", F.lit("interval").alias("claim_type"), F.lit("油").alias("subject"), F.col("chunk_id").alias("predicate"), F.col("text").alias("value"), F.lit("[]").alias("qualifiers"), F.when(F.col("chunk_id") == "c3", "不在文中").otherwise(F.col("text")).alias("evidence"))

    found, hashes = claims.extract(chunks, known, old, extractor)
    got = {r["chunk_id"]: (r["claim_key"], r["value_normalized"]) for r in found.collect()}
    assert sorted(set(seen)) == ["c1", "c3"] and set(got) == {"c1", "c2"} and got["c1"][1] == "8000km" and got["c2"][0] == "ck_old" and hashes.count() == 3
    versions = spark.createDataFrame([(7, "d")], "id long, doc_source string")
    assert rows(claims.next_version(versions, spark.createDataFrame([("b",), ("a",), ("a",)], "doc_source string"))) == [("a", 8), ("b", 9)]
