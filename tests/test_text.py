import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators.keyword_index import terms


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (X.normalize, "a\r\n\r\n\r\n\r\nb​  c \n", "a\n\nb c"),
        (X.sentences, "更换机油。好吗？好！", ["更换机油。", "好吗？", "好！"]),
        (X.sentences, "One. Two", ["One.", "Two"]),
        (X.sentences, "", []),
        (X.tokens, "更换机油 5W-30 oil a 7", ["更", "换", "机", "油", "更换", "换机", "机油", "5w", "30", "oil", "7"]),
        (X.tokens, "", []),
        (X.snippet, "a " * 200, ("a " * 200).strip()[:159] + "…"),
        (X.strip_rules, "a\n---\n* * *\nb", "a\nb"),
        (X.strip_markdown, "# T\n> **b** `c` [l](u)\n- x", "T\nb c l\nx"),
        (X.alias_line, "第 1 次保养换冷却液", "（同义表述：防冻液、首保、首次保养）"),
        (X.alias_line, "第 1 次", ""),
        (X.phrases, "P0420 故障码 是什么意思", ["P0420", "故障码"]),
        (X.citations, "a [2] b [1][2] [123]", [2, 1]),
        (X.body, "x [1]\n依据：\n[1] y", "x [1]\n"),
        (X.file_name, "a/b\\c.md", "c.md"),
        (lambda c: X.ngrams(c, 2), " A  b ", ["a ", " b"]),
        (X.normalize, None, None),
    ],
)
def test_functions(spark, function, text, expected):
    assert value(spark, function, text) == expected


def test_context_text(spark):
    df = spark.createDataFrame([("冷却液", " s "), ("x", None), ("x", "")], "t string, s string")
    got = [r[0] for r in df.select(X.context_text(F.col("t"), F.col("s"))).collect()]
    assert got == ["s；（同义表述：防冻液）\n冷却液", "x", "x"]


def test_worker_terms_agree(spark):
    text = "Ölwechsel 机油 café A1 x9999 中 7 b"
    assert sorted(value(spark, X.tokens, text)) == sorted(terms(text))
