import random

import pytest

from lodestrand.functions.unicode import alnum
from lodestrand.llm import leaks
from tests.conftest import rows

DOCUMENT, ITEM = "doc_id long, text string, item_id long", "item_id long, text string, doc_id string"


def brute(documents, items):
    docs, tests = {d: alnum(t) for d, t, *_ in documents if t}, {i: alnum(t) for i, t, *_ in items if t}
    return sorted({(d, i) for d, x in docs.items() for i, y in tests.items() if any(y[k : k + 40] in x for k in range(len(y) - 39))})


@pytest.mark.parametrize("stretch, block", [(2_000_000, 4_000_000), (300, 2_000)])
def test_against_brute_force(tables, spark, monkeypatch, stretch, block):
    monkeypatch.setattr(leaks, "STRETCH", stretch)
    monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
    r = random.Random(5)
    letters = "更换机油检查轮胎abcdefgh0123456789"
    items = [(k, "".join(r.choices(letters, k=r.randrange(30, 200))), "x") for k in range(30)] + [(50, None, "x"), (51, "", "x"), (None, "x" * 90, "x"), (52, "kurz", "x")]
    documents = []
    for k in range(120):
        text = "".join(r.choices(letters, k=r.randrange(0, 300)))
        for _ in range(r.randrange(3)):
            source = r.choice(items[:30])[1]
            a = r.randrange(max(1, len(source) - 38))
            part = source[a : a + r.choice([39, 40, 41, 80])]
            at = r.randrange(len(text) + 1)
            text = text[:at] + " ，".join(part) + text[at:]
        documents.append((k, text, 7))
    documents += [(900, None, 7), (901, "", 7), (902, "字" * 200_000 + items[0][1].upper(), 7), documents[0]]
    folder = tables(documents=(DOCUMENT, documents), eval_item=(ITEM, items + items[:3]))
    expected = brute(documents, [i for i in items if i[0] is not None])
    assert len(expected) > 20 and (902, 0) in expected
    assert rows(leaks.p6_found(spark, folder)) == expected


def test_tiles_see_reordered_passages():
    r = random.Random(1)
    a, b = ("".join(r.choices("abcdefghij更换机油", k=60)) for _ in "ab")
    got = leaks.tiles(a + b, "zz" + b + "yy" + a)
    assert sorted((i, n) for i, _, n in got) == [(0, 60), (60, 60)]
    assert leaks.tiles(a, a[:39] + "Z" + a[40:]) == []
    assert sum(n for _, _, n in leaks.tiles("x" * 100, "x" * 250)) == 100


def test_empty_tables(tables, spark):
    assert rows(leaks.p6_found(spark, tables(documents=(DOCUMENT, []), eval_item=(ITEM, [(1, "x" * 50, "")])))) == []
    assert rows(leaks.p6_found(spark, tables(documents=(DOCUMENT, [(1, "x" * 50, 1)]), eval_item=(ITEM, [])))) == []
    assert rows(leaks.p6_report(spark, tables(documents=(DOCUMENT, []), eval_item=(ITEM, [])))) == []


def test_tiles_are_the_longest_common_runs():
    r = random.Random(8)
    for trial in range(300):
        letters = "ab" if trial % 2 else "abcd"
        a, b = ("".join(r.choices(letters, k=r.randrange(0, 60))) for _ in "ab")
        a, b = (x * r.choice([1, 1, 3]) for x in (a, b))
        found = leaks.tiles(a, b, 5)
        used_a, used_b = set(), set()
        for i, j, n in found:
            assert n >= 5 and a[i : i + n] == b[j : j + n] and not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))
        longest = max((n for n in range(5, len(a) + 1) if any(a[k : k + n] in b for k in range(len(a) - n + 1))), default=0)
        assert max((n for _, _, n in found), default=0) == longest
        rest_a, rest_b = "".join(c if k not in used_a else "\x00" for k, c in enumerate(a)), "".join(c if k not in used_b else "\x01" for k, c in enumerate(b))
        assert not any(rest_a[k : k + 5] in rest_b for k in range(len(rest_a) - 4))


def test_repetitive_texts_are_tiled_fast():
    import time

    began = time.time()
    assert sum(n for _, _, n in leaks.tiles("a" * 20_000, "a" * 40_000)) == 20_000
    assert sum(n for _, _, n in leaks.tiles("abc" * 5_000, "abc" * 9_000)) == 15_000
    assert time.time() - began < 5
