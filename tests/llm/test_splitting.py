import random

import pytest

from lodestrand.llm.splitting import LIMIT, OVERLAP, p5_found, p5_pieces, pieces
from tests.conftest import rows

DOCUMENT = "doc_id string, text string, piece int, base string"
CHUNK = "chunk_id string, text string, section string, char_start int"


def check(text, limit=LIMIT, overlap=OVERLAP):
    got = pieces(text, limit, overlap)
    at = 0
    for k, (a, b, section) in enumerate(got):
        assert 0 < b - a <= limit
        assert a == (at if k == 0 or got[k - 1][2] != section or a == at else at - overlap)
        at = b
    assert at == len(text)
    return got


@pytest.mark.parametrize("seed", range(20))
def test_pieces_give_the_text_again(seed):
    r = random.Random(seed)
    words = ["更换机油。", "word ", "Satz. ", "\n", "\r\n", "\n\n", "# 标题\n", "## x\n", "1.1 检查轮胎\n", "第2节 水泵\n", "🔩", "é️", "a" * 90, "，", "\n=====\n", "| a | b |\n"]
    check("".join(r.choices(words, k=r.randrange(1, 400))), 100, 15)


def test_boundaries_are_natural():
    text = "一句话说明。" * 300
    assert all(text[b - 1] == "。" for _, b, _ in check(text))
    text = "\n\n".join("段落" * 100 for _ in range(9))
    assert all(text[:b].endswith("\n\n") or b == len(text) for _, b, _ in check(text))
    assert len(check("字" * 1_000_000)) == pytest.approx(1_000_000 / 520, abs=3)


def test_sections():
    got = check("开头\n# 手册\n## 机油\n" + "更换。" * 300 + "\n## 轮胎\n" + "检查。" * 300)
    assert [s for _, _, s in got][0] == "" and {s for _, _, s in got} == {"", "手册 > 机油", "手册 > 轮胎", "手册"} - {"手册"} | {"手册"}


def test_queries(tables, spark):
    long = "一句话说明。" * 120
    folder = tables(
        source_document=(DOCUMENT, [("a", long, 1, "b"), ("a", long, 1, "b"), ("b", "x" * 600, 1, ""), ("c", None, 1, ""), ("d", "", 1, ""), (None, long, 1, "")]),
        chunk=(CHUNK, [("a::1", long, "S", 9), ("a::2", long, None, 9), ("a::3", "kurz", "S", 0)]),
    )
    assert rows(p5_found(spark, folder)) == [("chunk", "a::1"), ("chunk", "a::2"), ("source_document", "a")]
    for r in p5_pieces(spark, folder).collect():
        assert long[r["char_start"] : r["char_end"]] == r["text"]
    assert {r["section"] for r in p5_pieces(spark, folder).where("item_id = 'a::1'").collect()} == {"S"}
    assert rows(p5_found(spark, tables(source_document=(DOCUMENT, []), chunk=(CHUNK, [])))) == []
