"""Labelled spans for training the tagger: sentences whose wording shows where personal data stands.

These cues label the bounded training sample only; the operator itself knows nothing of them.
"""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "name")

_N, _P, _I, _A, _E = (f"(?P<{k}{{}}>{{}})" for k in ("name", "phone", "id_number", "address", "email"))
_HAN = r"[一-鿿]{2,4}"
_LATIN = r"[A-ZÄÖÜ][\wäöüß.'-]*(?:,? (?:von |van |de )?[A-ZÄÖÜ][\wäöüß.'-]*){0,3}?"
_TEL = r"[+(]?[\d][\d\s()./-]{5,24}\d(?: ?(?:ext\.?|x|转) ?\d{1,5})?"
_ID = r"[\dA-Za-z][\dA-Za-z .-]{6,24}[\dA-Za-z]"
_MAIL = r"[\w.+-]+(?: ?@ ?| ?[(\[{] ?at ?[)\]}] ?| at )[\w-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )[\w-]+)+"

# The cues, X marking a span as <kind>.
CUES = (
    "客户<name>来电", "回访电话<phone>[。，；]", "收件人<name>，<phone>[。，；]", "收件人<name>[。；]", "进门报<name>即可", "投保人 ?<name>；", "；证件 ?<id_number>；",
    "；住址 ?<address>。", "<name>(?:女士|先生)的", "短信发到<phone>[。，；]", "送修人<name>，", "身份证号<id_number>[，。]", "联系方式：<phone> / <email>(?=[。\\s]|$)",
    "证件登记：<id_number>[（(]", "邮箱<email>，", "收据寄到<email>，抄送<email>。", "旧件请寄至<address>，收件人", "取车地址是<address>，进门", "有问题可以加我，<phone>，我姓名<name>。",
    "(?:^|(?<=[，。：:\\s]))据<name>讲，", "跟师傅<name>确认过", "——<name> <phone>(?=\\s|$)",
    "Owner <name> called about", ", callback <phone>\\.?(?=\\s|$)", "Claimant <name>, SSN", "SSN <id_number>, lives at <address>\\.(?=\\s|$)", "Reach me on <phone> or <email>(?=[.\\s]|$)",
    "invoice to <email> today", "car up at <address> and ask for <name>\\.(?=\\s|$)", "Ship the old [\\w ]+? to <address>, attention <name>\\.(?=\\s|$)", "Spoke with (?:Mr|Ms|Mrs)\\.? <name> regarding",
    "(?:^|(?<=[:.]\\s)|(?<=\\t)|(?<=• ))<name> told the", "Signed: <name>(?=\\s*$)", "(?:^|\\s)-- <name>, <phone>(?=\\s|$)", "Text <phone> once", "cc <email>(?=\\s|$)",
    "Kunde <name> meldet", "Rückruf unter <phone>\\.?(?=\\s|$)", "Halter <name>, Ausweis", "Ausweis <id_number>, wohnhaft <address>\\.(?=\\s|$)", "Ausweisnummer <id_number> geprüft", "Identity checked: <id_number>, in person", "Erreichbar: <phone> oder <email>(?=[.\\s]|$)",
    "Rechnung bitte an <email> schicken", "Altteil bitte an <address> senden, zu Händen <name>\\.(?=\\s|$)", "Abholung in <address>, bei <name> klingeln", "(?:Herrn?|Frau) <name> wartet auf",
    "Laut <name> tritt", "gez\\. <name>(?=\\s*$)", "gez\\. <name>, <phone>(?=\\s*$)", "^<name>, <phone>(?=\\s*$)",
)


def _compiled() -> list[re.Pattern]:
    out = []
    for cue in CUES:
        count: dict[str, int] = {}
        han = "——" in cue or any("一" <= c <= "鿿" for c in cue)
        form = {"name": _HAN if han or cue.startswith("(?:^|(?<=[，") else _LATIN, "phone": _TEL, "id_number": _ID, "address": r"[^，；。\n]{4,60}?" if han else r"[^\n;]{5,70}?", "email": _MAIL}

        def slot(m: re.Match, count=count, form=form) -> str:
            count[m[1]] = count.get(m[1], 0) + 1
            return f"(?P<{m[1]}_{count[m[1]]}>{form[m[1]]})"

        out.append(re.compile(re.sub(r"<(name|phone|id_number|address|email)>", slot, cue), re.M | (0 if han else re.I)))
    return out


PATTERNS = _compiled()


def spans(plain: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the labelled spans of a text in half-width characters, not overlapping."""
    found = {}
    for pattern in PATTERNS:
        for m in pattern.finditer(plain):
            for group, value in m.groupdict().items():
                if value:
                    found[m.start(group), m.end(group)] = group.rsplit("_", 1)[0]
    out: list[tuple[int, int, str]] = []
    for (a, b), kind in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out
