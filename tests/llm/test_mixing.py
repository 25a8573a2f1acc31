import numpy as np
import pandas as pd
import pytest

from lodestrand.llm import mixing
from tests.conftest import rows

DOCUMENT, TARGET = "doc_id long, text string, source string, block int, key long", "source string, target_share double, max_repeats int"


def test_splitting_tree_keeps_counts():
    counts = np.array([100, 7, 0, 33])
    got = mixing.split(counts, 9, np.random.default_rng(1))
    assert got.shape == (9, 4) and (got.sum(0) == counts).all() and got.sum(1).max() - got.sum(1).min() <= 2


def test_splitting_tree_is_unbiased():
    got = np.mean([mixing.split(np.array([30, 10]), 4, np.random.default_rng(s)) for s in range(400)], axis=0)
    assert np.abs(got - [[7.5, 2.5]] * 4).max() < 0.3


def test_plan_reaches_quotas():
    blocks = {"a": {b: 10 for b in range(100)}, "b": {b: 7 for b in range(10)}, "c": {}}
    draws = mixing.plan(blocks, {"a": (0.5, 2), "b": (0.3, 3), "c": (0.2, 9), "d": (0.0, 1)}, 4)
    use = {s: sum(blocks[s][b] if budget is None else budget for x, b, _, _, budget in draws if x == s) for s in "ab"}
    assert use == {"a": 350, "b": 210}
    assert max(c for s, _, c, _, _ in draws if s == "b") == 2 and max(c for s, _, c, _, _ in draws if s == "a") == 0
    assert len({d[:3] for d in draws}) == len(draws)
    assert mixing.plan({}, {"a": (1.0, 1)}) == []


def test_plans_stay_small(monkeypatch):
    blocks, targets = {"tiny": {b: 1 for b in range(8)}, "big": {b: 900 for b in range(8)}}, {"tiny": (0.5, 10_000), "big": (0.5, 1)}
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    monkeypatch.setattr(mixing, "MOST_DRAWS", 2_000)
    assert mixing.quotas({"tiny": 8, "big": 7200}, targets) == {"big": 7200, "tiny": 7200}
    assert mixing.folds({"tiny": 8, "big": 7200}, targets) == {"big": 8, "tiny": 2}
    assert sum(d[0] == "tiny" for d in mixing.plan(blocks, targets)) == 7200 == mixing.plan(blocks, targets).__len__() - 8


def test_many_sources_have_fewer_blocks(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DRAWS", 1_000)
    tokens = {f"s{k}": 100 for k in range(300)}
    counts = mixing.folds(tokens, {s: (1 / 300, 1) for s in tokens})
    assert len(counts) == 300 and sum(counts.values()) <= 1_000 and min(counts.values()) >= 1


@pytest.mark.parametrize("groups", [1, 3])
def test_shards_beyond_the_groups(tables, spark, monkeypatch, groups):
    """The tree's lower levels on the workers: the same documents, in all the shards, each in one."""
    given = [(k, "wort " * (1 + k % 9), ["hot", "cold"][k % 2], 1, 2) for k in range(3000)]
    folder = tables(documents=(DOCUMENT, given), mix_target=(TARGET, [("hot", 0.5, 1), ("cold", 0.5, 2)]))
    whole = sorted((r["doc_id"], r["copy"]) for r in mixing.p7_mix(spark, folder).collect())
    monkeypatch.setattr(mixing, "MOST_GROUPS", groups)
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 1_000)
    got = mixing.p7_mix(spark, folder).collect()
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_tokens"]
    assert len({(r["shard"], r["pos"]) for r in got}) == len(got)
    assert max(size.values()) < 3_000 and len(size) >= 0.8 * sum(size.values()) / 1_000
    assert abs(len(got) - len(whole)) <= 10 and len({(r["doc_id"], r["copy"]) for r in got}) == len(got)


def test_partial_block_is_filled_behind_large_documents():
    rows_of = lambda sizes, block: pd.DataFrame({"source": "a", "block": block, "copy": 0, "n_tokens": sizes, "budget": 100})
    one, two = rows_of([500, 60, 70, 30, 20, 10], 1), rows_of([90, 20, 10], 2)
    got = pd.concat(mixing._filled([one[:3], pd.concat([one[3:], two])]))
    assert got["n_tokens"].tolist() == [60, 30, 10, 90, 10]


def test_large_document_leaves_the_mix_whole(tables, spark):
    # of one block only a part is due: its large document must not keep the small ones out
    given = [(k, "wort " * (3000 if k % 50 == 0 else 5), ["hot", "cold"][k % 2], 1, 2) for k in range(4000)]
    folder = tables(documents=(DOCUMENT, given), mix_target=(TARGET, [("hot", 0.5, 1), ("cold", 0.5, 1)]))
    shares = {r["source"]: r for r in mixing.p7_shares(spark, folder).collect()}
    assert abs(shares["hot"]["tokens_used"] - shares["cold"]["tokens_used"]) <= 6


def test_folded_and_whole_sources_together(tables, spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DRAWS", 3_000)
    given = [(k, "wort " * 5, "tiny" if k < 20 else "big", 1, 2) for k in range(2000)]
    folder = tables(documents=(DOCUMENT, given), mix_target=(TARGET, [("tiny", 0.5, 1000), ("big", 0.5, 1)]))
    shares = {r["source"]: r for r in mixing.p7_shares(spark, folder).collect()}
    assert shares["tiny"]["share"] == pytest.approx(0.5, abs=0.001) and shares["big"]["rows_used"] == 1980


def test_mix(tables, spark):
    given = [(k, "更换机油 word " * (1 + k % 5), ["Hot", " hot ", "cold", None, "other"][min(k % 7, 4)], 1, 2) for k in range(600)]
    given += given[:50] + [(1000, None, "hot", 1, 2), (1001, "", "hot", 1, 2), (None, "x", "hot", 1, 2), (1002, "wort " * 30_000, "cold", 1, 2)]
    folder = tables(documents=(DOCUMENT, given), mix_target=(TARGET, [("hot", 0.6, 2), ("cold", 0.3, 3), ("rare", 0.1, 2), (None, 0.5, 1)]))
    mixed = mixing.p7_mix(spark, folder).collect()
    shares = {r["source"]: r for r in mixing.p7_shares(spark, folder).collect()}
    assert shares["hot"]["share"] == pytest.approx(2 / 3, abs=0.02) and shares["rare"]["share"] == 0
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert times[r["doc_id"]] <= {"hot": 2, "cold": 3}[r["source"]]
    assert len({(r["shard"], r["pos"]) for r in mixed}) == len(mixed) == sum(r["rows_used"] for r in shares.values())
    assert sum(r["n_tokens"] for r in mixed) == sum(r["tokens_used"] for r in shares.values())
    assert rows(mixing.p7_mix(spark, folder)) == sorted(tuple(r) for r in mixed)


def test_empty_tables(tables, spark):
    folder = tables(documents=(DOCUMENT, []), mix_target=(TARGET, [("a", 1.0, 1)]))
    assert rows(mixing.p7_mix(spark, folder)) == [] and mixing.p7_shares(spark, folder).first()["share"] == 0
    folder = tables(documents=(DOCUMENT, [(1, "x", "a", 1, 1)]), mix_target=(TARGET, []))
    assert rows(mixing.p7_mix(spark, folder)) == [] and rows(mixing.p7_shares(spark, folder)) == []
