import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import keyword_index, plugins, retrieval

DOCS = [("c1", "首保 5000 公里，第 1 次保养更换机油", "保养"), ("c2", "P0420 | 催化系统效率过低 故障码", "故障码"), ("c3", "轮胎气压 230 kPa", "轮胎"), ("c4", None, None), ("c5", "", "x")]


def frame(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string, section string")


def ask(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id int, text string")


def test_keyword_search(spark):
    got = keyword_index.search(frame(spark), ask(spark, "P0420 故障码 是什么意思", "首保多少公里", "zzz x9999 qqq", "", None), 5, context=(F.col("section"),)).collect()
    first = {r["query_id"]: r["id"] for r in got if r["rank"] == 1}
    assert first == {0: "c2", 1: "c1"}
    assert keyword_index.search(frame(spark).where("false"), ask(spark, "x1"), 5).collect() == []
    assert keyword_index.search(frame(spark), ask(spark).where("false"), 5).collect() == []


def test_keyword_scores_against_the_formula(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "QUERY_BLOCK", 3)
    r = random.Random(1)
    words = ["机油", "更换", "tyre", "p0420", "a1", "油", "的"]
    docs = [(k, " ".join(r.choices(words, k=r.randrange(1, 9)))) for k in range(40)]
    asked = [(k, " ".join(r.choices(words, k=3))) for k in range(8)]
    got = {(x["query_id"], x["id"]): x["score"] for x in keyword_index.search(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asked, "item_id int, text string"), 5).collect()}
    own = {k: keyword_index.terms(t) for k, t in docs}
    n, average = len(own), sum(map(len, own.values())) / len(own)
    for q, t in asked:
        scores = {}
        for d, mine in own.items():
            s = 0.0
            for term in keyword_index.terms(t):
                df, tf = sum(term in o for o in own.values()), mine.count(term)
                s += (0.3 if len(term) == 1 and term > "一" else 1) * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(mine) / average))
            hits = sum(p in dict(docs)[d] for p in t.split() if len(p) >= 2)
            if s > 0:
                scores[d] = round(s * 1.3 ** min(3, hits), 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
        expected = {(q, d): s for d, s in best if s >= 0.15 * best[0][1]}
        assert {k: v for k, v in got.items() if k[0] == q} == pytest.approx(expected, abs=2e-6)


def test_nearest(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(60, 8)).astype(np.float32)
    v[7] = v[3]
    rows = [(k, v[k].tolist()) for k in range(60)] + [(98, None), (99, [1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = retrieval.nearest(df, df.where("vec_id IN (3, 10)"), 5).collect()
    unit = v.astype(np.float64) / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (3, 10):
        s = np.round(unit @ unit[q], 6)
        expected = [int(k) for k in np.lexsort((np.arange(60), -s)) if k != q][:5]
        assert [x["id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == expected


def test_hash_vectors():
    a, b = retrieval.hash_vector("更换机油", 128), retrieval.hash_vector("更换机油", 128)
    assert (a == b).all() and abs(np.linalg.norm(a) - 1) < 1e-6
    assert not retrieval.hash_vector(None, 16).any() and not retrieval.hash_vector("", 16).any()


def test_fusion(spark):
    schema = "query_id int, id string, score double, rank int"
    vector = spark.createDataFrame([(1, "a", 0.82, 1), (1, "b", 0.61, 2)], schema)
    keyword = spark.createDataFrame([(1, "b", 7.5, 1), (1, "c", 3.2, 2)], schema)
    got = {r["id"]: r["fusion"] for r in retrieval.fuse(vector, keyword).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": (0.61 / 0.82) / 62 + 0.8 / 61, "c": 0.8 * (3.2 / 7.5) / 62})
    assert {r["id"]: r["fusion"] for r in retrieval.fuse(vector, keyword, "keyword").collect()}["b"] == 1.0


def test_rerank(spark):
    df = spark.createDataFrame([("机油 P0420", "更换机油 P0420", "机油", 0.5), ("abc", "xyz", None, None)], "query string, text string, section string, fusion double")
    got = retrieval.rerank(df).orderBy("query").collect()
    a = got[1]
    assert (a["signal_precision"], a["signal_cjk"], a["signal_coverage"]) == (1.0, 1.0, 1.0)
    assert a["signal_section"] == pytest.approx((0.25 * 2 + 1) / (0.25 * 2 + 2), abs=1e-6)
    assert got[0]["score"] == 0.0
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    scores = spark.createDataFrame([(1, "a", -1.0), (1, "b", 2.0), (1, "c", 9.0)], "query_id int, id string, raw double")
    assert [r["id"] for r in retrieval.cross_rerank(ranked, scores, 2).orderBy("new_rank").collect()] == ["b", "a", "c"]


def test_offline_models(spark):
    got = plugins.extractive_generator(spark.createDataFrame([(1, ["甲句。乙句。"]), (2, [])], "answer_id int, passages array<string>")).orderBy("answer_id").collect()
    assert got[0]["answer"] == "甲句。 [1]" and "未找到" in got[1]["answer"]
    df = spark.createDataFrame([("q", '"新问题如何"\nx'), ("q", "短"), ("q", None)], "q string, r string")
    assert [r[0] for r in df.select(plugins.accept_rewrite(F.col("q"), F.col("r"))).collect()] == ["新问题如何", "q", "q"]


def test_term_counts_agree_whatever_the_number_of_terms(spark, monkeypatch):
    from lodestrand.operators import keyword_index as K

    docs = spark.createDataFrame([("更换机油 oil 5w",), ("oil oil",), ("",), ("轮胎",)], "index_text string")
    wanted = spark.createDataFrame([("oil",), ("机油",), ("zzz",), ("轮",)], "token string")
    few = sorted(map(tuple, K._term_counts(docs, wanted).collect()))
    monkeypatch.setattr(K, "MOST_ROWS", 1)
    assert few == sorted(map(tuple, K._term_counts(docs, wanted).collect())) == [("", 3, 14), ("oil", 2, 11), ("机油", 1, 9), ("轮", 1, 3)]
