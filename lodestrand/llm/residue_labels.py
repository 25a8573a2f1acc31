"""Labels for fitting the residue models: wordings by which a training text is known to be residue.

They label the bounded training sample only; the operator itself knows nothing of them.
"""

from __future__ import annotations

import re

# What stands between the marks of a placeholder, and notices that stand alone.
PHRASES = (
    "待填写", "待补充", "待补", "待定", "请填写答案", "请填写", "插入原文片段", "此处填写更换周期", "此处填写", "车型名称待定", "to be filled in", "your text here", "insert answer here", "Text folgt", "hier Antwort einfügen", "Antwort einfügen", "bitte ausfüllen", "snippet goes here", "answer goes here", "TBD", "TODO",
)
NOTICES = (
    r"网络连接超时，请刷新页面重试", r"系统繁忙，请稍后再试（错误代码 \d+）", r"页面走丢了，\d+ 秒后返回首页", r"正在验证您的浏览器，请开启 ?Cookie.*", r"您的浏览器未开启脚本，部分内容无法显示", r"您没有权限查看此内容，请先登录", r"抱歉，您访问的页面不存在或已被删除。?", r"请启用 ?JavaScript ?后继续访问。?", r"<noscript>.*", r"<html.*", r"<!DOCTYPE.*",
    r"Zugriff verweigert\..*", r"Bitte aktivieren Sie JavaScript.*", r"Die angeforderte Seite wurde nicht gefunden.*", r"Diese Seite benötigt aktivierte Skripte\.?",
    r"upstream connect error.*", r"This site can't be reached.*", r"You need to turn on scripts.*", r"Please enable JavaScript.*", r"Oops! That page can't be found\.?", r"Checking your browser.*", r"JavaScript is disabled\..*", r"This content needs scripts.*", r"HTTP Error \d+.*", r"[45]\d\d (?:Unauthorized|Bad Request|Not Found|Forbidden|Internal Server Error|Bad Gateway|Service Unavailable|Too Many Requests|Gateway Time-?out).*", r"\{\"error\".*", r"Traceback \(most.*", r"Access denied\. Request id.*",
)
FILLERS = (
    r"(?:TBD|tbd\.|TODO\b.*|x{3,}|X{3,}|待补|待填|……待续……|to be completed|noch zu ergänzen|答案稍后补充|（空）待作者补写)",
    r"(?:[a-z0-9]{4}(?: (?:asdf|qwer|zxcv|hjkl|\d{4}))+)", r"(.)\1{3,}", r"(?:测试|内容|示例|文字)+", r"(?:Blindtext ?)+", r"FIXME\b.*", r"(?:这里是占位文字，?)+.*", r"(?:本段文字仅用于排版预览，?)+.*", r"(?:Sample copy for layout only\. ?)+", r"(?:Dies ist ein Platzhaltertext\. ?)+", r"(?:blah ?)+",
    r"(?:(?:dolor|lorem|ipsum|sedo|veli|cursu|arcu|magna|sit|porta|amet|elit|vivo|nulla|tempus)[ .]*)+",
)

_WORD = rf"(?:[a-z]+(?:_[a-z]+)*|{'|'.join(map(re.escape, PHRASES))})"
PLACEHOLDER = re.compile(
    r"\{\{ ?W ?\}\}|[$#]\{W\}|\{%W%\}|<%= ?W ?%>|\[\[W\]\]|@@W@@|__W__|&lt;W&gt;|%W%|\*\*\* W \*\*\*|«W»|<W>|＜W＞|[\[［]W[\]］]|【W】|（W）|\{W\}|_{2,}".replace("W", _WORD)
)
WHOLE = re.compile("|".join(f"(?:{x})" for x in NOTICES), re.S)
FILLER = re.compile("|".join(f"(?:{x})" for x in (x for x in FILLERS if not x.startswith("(.)"))) + r"|(.)\1{3,}", re.I)


#: Wide letters and signs to narrow ones, but for the punctuation that the wordings have.
NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if chr(c) not in "（），：；！？"} | {0x3000: 32}


def label(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the labelled residue of a text; kind is placeholder, filler or notice."""
    text = text.translate(NARROW)
    bare = text.strip()
    at = text.find(bare)
    if not bare:
        return []
    if WHOLE.fullmatch(bare):
        return [(at, at + len(bare), "notice")]
    if FILLER.fullmatch(bare):
        return [(at, at + len(bare), "filler")]
    return [(m.start(), m.end(), "placeholder") for m in PLACEHOLDER.finditer(text)]
