"""Fitting of the residue models: python -m lodestrand.llm.residue_fit MULTI_TURN_SET [OUT]

The sample is bounded: at most SAMPLE labelled texts of the table, MADE placeholders, fillers and notices
made from fixed values and by rule, and, so that prose is more than the table's, PROSE texts of the
documents beside it, the plain and personal sentences of `pii_examples`, and paragraphs of Python's own
documentation. With a third argument one text in five
is held out; the stored models are fitted on the whole sample.
"""

from __future__ import annotations

import os
import re
import sys

import numpy as np
import pandas as pd

from lodestrand.llm import pii_examples, residue
from lodestrand.llm.residue_labels import PHRASES, label

SAMPLE, MADE, PROSE = 20_000, 3_000, 3_000
# Marks of placeholders, W standing for what is between.
MARKS = ("{{W}}", "{{ W }}", "${W}", "#{W}", "{%W%}", "<%= W %>", "[[W]]", "@@W@@", "__W__", "&lt;W&gt;", "%W%", "*** W ***", "«W»", "<W>", "[W]", "【W】", "（W）", "{W}")
NAMES = ("car_model", "fluid_grade", "torque_value", "period_km", "period_months", "part_no", "dtc_code", "item_name", "dealer_name", "snippet", "answer", "ground_truth", "value", "unit", "question", "section", "author", "date", "title", "model_name", "source_file")
FILLER_WORDS = (("asdf", "qwer", "zxcv", "hjkl", "1234"), ("lorem", "ipsum", "dolor", "sit", "amet", "elit", "magna", "porta", "nulla", "sedo", "veli", "cursu", "arcu", "vivo", "tempus"), ("blah",), ("test",))
REPEATED = ("测试", "内容", "啊", "哈", "x", "X", "。", "?", "1", "a", "示例", "Blindtext ", "文字", "Platzhalter ", "Sample copy for layout only. ", "这里是占位文字，", "本段文字仅用于排版预览，", "Dies ist ein Platzhaltertext. ")
ALONE = ("待补", "待补充", "待填", "待填写", "待定", "TBD", "tbd", "tbd.", "TODO", "FIXME", "XXX", "xxx", "N/A", "to be completed", "to be filled in", "noch zu ergänzen", "folgt noch", "暂无", "略", "答案稍后补充", "……待续……", "（空）待作者补写")
STATUS = ("Unauthorized", "Bad Request", "Not Found", "Forbidden", "Internal Server Error", "Bad Gateway", "Service Unavailable", "Too Many Requests", "Gateway Timeout", "Gateway Time-out")
STATUS_FORMS = ('{"error": {"code": 000, "message": "W"}}', "000 W", "HTTP Error 000 - W", "Error 000: W", "<html><title>000 W</title>")


# Parts of placeholders, notices and error codes, put together by rule.
OPEN = {"en": (("insert", "enter", "add", "your", "put", "type", "fill in"), ("value", "name", "text", "answer", "date", "number", "title", "amount", "model", "details", "address"), (" here", "", " here", " (required)")),
        "de": (("Wert", "Name", "Text", "Datum", "Zahl", "Betrag", "Antwort", "Titel"), (" hier eintragen", " einfügen", " ergänzen", " eintragen", " folgt", " einsetzen"), ("",)),
        "zh": (("请", "此处", "在此", "待"), ("填写", "输入", "插入", "补充", "录入"), ("数值", "名称", "日期", "内容", "型号", "答案", "文字", "编号", ""))}
SAID = {
    "en": (("Sorry, ", "Oops! ", "Error: ", "", "Whoops, "), ("something went wrong", "the page could not be loaded", "an unexpected error occurred", "the server did not respond", "the connection was refused", "your session has expired", "access to this page is restricted", "this page does not exist", "too many requests were sent", "JavaScript is turned off in your browser", "JavaScript must be enabled to use this site", "cookies are required to continue", "the service is temporarily unavailable"), (". Please try again later.", ". Please reload the page.", ".", ". Contact the administrator.", ". Check your connection and retry.", ". Please enable it and reload.", "!")),
    "de": (("Fehler: ", "Leider ", "", "Entschuldigung, "), ("ist ein Fehler aufgetreten", "konnte die Seite nicht geladen werden", "antwortet der Server nicht", "die Sitzung ist abgelaufen", "wurde die Verbindung unterbrochen", "JavaScript ist in Ihrem Browser deaktiviert", "Cookies müssen aktiviert sein", "der Zugriff wurde verweigert", "der Dienst ist vorübergehend nicht verfügbar"), (". Bitte versuchen Sie es später erneut.", ". Bitte laden Sie die Seite neu.", ".", ". Wenden Sie sich an den Administrator.", "!")),
    "zh": (("抱歉，", "", "错误：", "出错了，", "提示："), ("页面加载失败", "网络异常", "服务器没有响应", "登录已过期", "请求过于频繁", "访问受限", "系统维护中", "您的浏览器禁用了JavaScript", "需要开启Cookie才能继续", "内容不存在或已下线", "连接已断开"), ("，请检查网络", "，请稍后重试", "，请刷新页面", "。", "，请联系管理员", "，请重新登录", "！")),
}
CODES = (("ERR", "NET::ERR", "DNS_PROBE", "SSL_ERROR"), ("CONNECTION", "NAME", "NETWORK", "EMPTY", "CERT", "ADDRESS", "INTERNET"), ("REFUSED", "RESET", "TIMED_OUT", "NOT_RESOLVED", "CHANGED", "RESPONSE", "INVALID", "DISCONNECTED"))


def prose(folder: str, r: np.random.Generator) -> list[str]:
    """Natural prose of other kinds than the table's."""
    from pydoc_data import topics

    texts = pd.read_parquet(os.path.join(folder, "documents.parquet"), columns=["text"])["text"].dropna()
    lines = [x for t in texts.iloc[r.permutation(len(texts))[:PROSE]] for x in re.split(r"[\r\n]+", t) if x.strip()]
    lines += [t for t, _ in pii_examples.made(PROSE, r)] + [f for f in pii_examples.PLAIN if "<" not in f] * 5
    paragraphs = [" ".join(x.split()) for t in topics.topics.values() for x in re.split(r"\n\s*\n", t)]
    return lines + [x for x in paragraphs if re.fullmatch(r"[A-Za-z ,.;:'()-]{60,}", x)][:PROSE]


def made(r: np.random.Generator) -> dict[str, list[str]]:
    pick = lambda x: x[r.integers(len(x))]
    out: dict[str, list[str]] = {"placeholder": [], "filler": [], "notice": []}
    for _ in range(MADE):
        blank = "_" * int(r.integers(2, 8))
        out["placeholder"].append(pick((pick(MARKS).replace("W", pick(NAMES if r.random() < 0.6 else PHRASES)), pick(MARKS).replace("W", pick(NAMES if r.random() < 0.6 else PHRASES)), blank)))
        phrase = "".join(pick(x) if k == 0 or lang != "en" else (" " if k == 1 else "") + pick(x) for k, x in enumerate(OPEN[lang])) if (lang := pick(tuple(OPEN))) else ""
        phrase = pick((phrase, phrase.upper(), phrase.title(), phrase.lower()))
        out["placeholder"].append(pick(MARKS).replace("W", phrase))
        out["notice"].append("".join(map(pick, SAID[pick(tuple(SAID))])))
        out["notice"].append("_".join(map(pick, CODES)))
        words = pick(FILLER_WORDS)
        out["filler"].append(" ".join(pick(words) for _ in range(int(r.integers(3, 12)))) if r.random() < 0.5 else pick(REPEATED) * int(r.integers(3, 14)))
        if r.random() < 0.1:
            out["filler"].append(pick(ALONE))
        out["notice"].append(pick(STATUS_FORMS).replace("W", pick(STATUS)))
    return out


def collect(values: list[str]) -> dict[str, list[str]]:
    """Normalised texts of each kind; prose around placeholders counts as prose."""
    out: dict[str, list[str]] = {k: [] for k in ("prose", *residue.KINDS)}
    for text in values:
        at = 0
        for a, b, kind in label(text):
            out[kind].append(residue.normal(text[a:b]))
            out["prose"] += [residue.normal(text[at:a])] if text[at:a].strip() else []
            at = b
        out["prose"] += [residue.normal(text[at:])] if text[at:].strip() else []
    return out


def values_of(source: str) -> list[str]:
    items = pd.read_parquet(source, columns=["id", "ground_truth", "expected_snippets"]).drop_duplicates("id")
    many = [t for x in items["expected_snippets"] if x is not None for t in x]
    return [t for t in [*items["ground_truth"], *many] if isinstance(t, str) and t.strip()]


def main(source: str, out: str = residue.MODEL) -> None:
    every = values_of(source)[:SAMPLE]
    values = sorted(set(every))
    r = np.random.default_rng(5)
    order = r.permutation(len(values))
    held = [values[k] for k in order[::5]]
    train = [t for t in every if t not in set(held)] if len(sys.argv) > 3 else every
    sample, extra = collect(train), made(r)
    models = {"prose": residue.Model.fit(sample["prose"] + [residue.normal(t) for t in prose(os.path.dirname(source.rstrip("/")), r)])}
    for kind in residue.KINDS:
        models[kind] = residue.Model.fit(sample[kind] * 3 + [residue.normal(t) for t in extra[kind]])
    residue.save(models, out)
    evaluate(held)


def evaluate(values: list[str], show: int = 60) -> None:
    models = residue.load()
    wrong, counts = [], {"tp": 0, "fp": 0, "fn": 0}
    for text, found in zip(values, residue.examine(values, models)):
        true = bool(label(text))
        said = bool(residue.residue(residue.normal(text), found))
        if said or true:
            counts["tp" if said and true else "fp" if said else "fn"] += 1
        if said != true:
            wrong.append(("+" if said else "-", text[:100], [(k, residue.normal(text)[a:b][:30], round(s, 1), round(v, 2)) for k, a, b, s, v in found]))
    print(counts)
    for w in wrong[:show]:
        print(*w)


if __name__ == "__main__":
    main(*sys.argv[1:])
