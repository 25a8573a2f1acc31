"""Made sentences with personal data, in Chinese, English and German, for training the tagger beyond its labelled sample.

Frames are filled with values that are drawn from short lists or put together by rule; frames without a
slot of a kind are counterexamples: numbers of orders, parts, vehicles and networks, towns, dates,
amounts, capitalised nouns. Held-out frames and values of the tests are others.
"""

from __future__ import annotations

import re

import numpy as np

# Common names and name parts.
FIRST = ("James Mary Robert Patricia John Linda Michael Barbara David Susan William Jessica Richard Sarah Joseph Karen Thomas Nancy Charles Lisa Daniel Betty Matthew Sandra Anthony Ashley Mark Kimberly Steven Donna Paul Carol Andrew Michelle Joshua Amanda "
         "Kenneth Melissa Kevin Deborah Brian Stephanie George Rebecca Edward Laura Ronald Helen Timothy Sharon Jason Cynthia Jeffrey Kathleen Ryan Amy Jacob Angela Gary Shirley Nicholas Anna Eric Brenda Jonathan Pamela Stephen Nicole Larry Ruth Justin Katherine Scott Samantha Priya Ahmed Olga Mateo Fatima Chloe Omar Ines").split()  # fmt: skip
LAST = ("Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson "
        "Hall Rivera Campbell Mitchell Carter Roberts O'Brien MacLeod Patel Khan Novak Kowalski Rossi Dubois Silva Haddad Okafor Lindqvist").split()  # fmt: skip
VORNAMEN = "Peter Michael Thomas Andreas Wolfgang Klaus Jürgen Günter Stefan Christian Uwe Werner Horst Frank Dieter Manfred Gerhard Bernd Torsten Matthias Helmut Maria Ursula Monika Petra Elisabeth Sabine Renate Helga Karin Brigitte Ingrid Erika Andrea Gisela Claudia Susanne Gabriele Christa Birgit Anja Heike Jutta Lena Sophie Jörg Björn Götz".split()
NACHNAMEN = "Schmidt Schneider Fischer Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Hartmann Lange Schmitt Werner Krause Meier Lehmann Schmid Schulze Maier Köhler Herrmann König Walter Mayer Huber Kaiser Fuchs Peters Lang Scholz Möller Weiß Jung Hahn Vogel Friedrich Keller Günther Frank Berger Winkler Roth Beck Lorenz Baumann Böhm Kühn".split()
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
GIVEN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂玲华梅红玉春建国志文海波辉鹏飞宇浩然子轩梓涵欣怡雨桐思远佳琪晨曦雪婷嘉豪俊凯天宁小光庆永健世昌德林倩颖慧琳洁薇露丹萍燕凤云莉安琴瑶宏博旭阳立新民康乐"
SYLLABLES = "ba be bro cal da del dor el fa fen gal ha hol in jo ka kel la lin lor ma mar mel na nor o pel ra ren ro sa sel ta tor u va vel wen yor za".split()
ENDINGS = "n r l s th son ley ford wick ton mann berg hold feld er stein ski".split()
STREETS = "Maple Oak Church Station Mill Park High King Queen Victoria Cedar Elm Lake Hill River Spring Walnut Chestnut Washington Lincoln Green Bridge Meadow Orchard".split()
KINDS_OF_STREET = "Street St St. Avenue Ave Road Rd. Lane Drive Court Place Boulevard Way Terrace".split()
STRASSEN = "Haupt Bahnhof Garten Schul Dorf Berg Kirch Wald Linden Ring Goethe Schiller Mozart Birken Wiesen Mühlen Rosen Park Markt Feld".split()
TOWNS = "Springfield Riverton Oxford Leeds Denver Austin Salem Dover Bristol Portland Madison Clayton Fairview Lisbon Harlow".split()
STAEDTE = "Berlin Hamburg München Köln Leipzig Bremen Ulm Kassel Erfurt Jena Bonn Mainz Potsdam Lübeck Trier".split()
ORTE = "北京市朝阳区 上海市浦东新区 杭州市西湖区 成都市武侯区 广州市天河区 南京市鼓楼区 武汉市洪山区 西安市雁塔区 苏州市 青岛市市南区 重庆市渝北区 长沙市岳麓区 深圳市南山区".split()
WEGE = "建国路 文三路 人民路 中山大道 解放街 长江路 和平街 新华路 科技园路 滨河大道 学院路 环城西路 花园街 东风路".split()
HOSTS = "mail example post inbox webmail firma kontor studio nordnet quickmail autohaus service".split()
TLDS = "com org net de cn co.uk io example test".split()

# Frames with personal data; <n> name, <p> phone, <e> email, <i> identity number, <a> address.
ENGLISH = (
    "Please call <n> on <p> after lunch.", "My name is <n> and I live at <a>.", "<n> wrote to <e> yesterday.", "Contact: <n>, <e>", "Her SSN is <i>.", "Deliver the parcel to <a>.", "We met <n> and <n> at the fair.", "The appointment of <n> is at nine.",
    "If nobody answers, try <p>.", "Send your reply to <e> or call <p>.", "Passport number <i> belongs to <n>.", "Mr. <n> asked for a refund.", "Dear <n>, thank you for your letter.", "Tenant: <n>; address: <a>; phone: <p>", "The driver, <n>, was not hurt.", "Our office is at <a>, second floor.",
    "Mobile <p>, fax <p>.", "National insurance number: <i>", "According to <n>, the pump failed first.", "<n> lives at <a> with two dogs.", "Invoices go to <e>.", "Yours sincerely,\n<n>", "Signed by <n> in March.", "I spoke to <n> from accounting.", "ID card <i> was shown at the desk.", "Ask for <n> at the reception of <a>.", "You can text me at <p> or mail <e>.",
    "Social security no. <i>, born 1980", "The car is registered to <n>, <a>.", "Call back: <p> (<n>)", "<n> (<e>) joined the call.", "Emergency contact <n>, <p>", "Patient <n> was admitted on Monday.", "From: <n> <<e>>", "Drop the keys at <a> before six.", "Taxpayer ID <i>", "Copies went to <e>, <e> and <e>.", "Either <p> or <p> works.", "<n>, <n> and <n> share <a>.",
)
GERMAN = (
    "Bitte rufen Sie <n> unter <p> an.", "Ich heiße <n> und wohne in der <a>.", "<n> hat an <e> geschrieben.", "Ansprechpartner: <n>, <e>", "Die Personalausweisnummer lautet <i>.", "Das Paket geht an <a>.", "Herr <n> wünscht einen Termin.", "Frau <n> ist heute krank.", "Tel. <p>, Fax <p>", "Sehr geehrter Herr <n>,", "Mieter: <n>, Anschrift: <a>",
    "Mit freundlichen Grüßen\n<n>", "Sie erreichen mich mobil unter <p>.", "Steuer-ID <i>", "Der Fahrer <n> blieb unverletzt.", "Unser Büro liegt in der <a>.", "Antwort bitte an <e> oder telefonisch: <p>.", "Reisepass <i> wurde vorgelegt.", "Nach Angaben von <n> war die Pumpe defekt.", "<n> wohnt <a>.", "Der Wagen gehört <n>, <a>.", "Notfallkontakt: <n>, <p>",
    "Am Montag kam <n> mit ihrer Tochter vorbei.", "Ausweis Nr. <i>, geboren 1975", "Sozialversicherungsnummer <i>", "Schlüssel bei <n> abgeben, <a>.", "Handy: <p>", "Die Rechnung schicken Sie an <e>.", "Unterschrift: <n>", "Gesprochen mit <n> aus der Werkstatt.", "Patientin <n> wurde aufgenommen.", "Abgeholt von <n> am Dienstag.", "Kopien an <e>, <e> und <e>.", "<p> oder <p> geht.", "<n> und <n> teilen sich <a>.",
)
CHINESE = (
    "请联系<n>，电话<p>。", "我叫<n>，住在<a>。", "<n>昨天给<e>发了邮件。", "联系人：<n>，邮箱：<e>", "他的身份证号码是<i>。", "包裹请送到<a>。", "<n>和<n>一起来店里看车。", "手机号<p>，微信同号。", "收货地址：<a>，收货人：<n>", "如无人接听请拨打<p>。", "护照号<i>已登记。", "<n>先生要求退款。", "<n>女士您好，感谢来信。", "租客<n>，身份证<i>，电话<p>",
    "司机<n>没有受伤。", "我们公司在<a>三楼。", "发票请寄到<e>。", "此致\n<n>", "据<n>介绍，水泵先坏。", "车主姓名：<n>", "有事打我电话<p>找<n>。", "办事处位于<a>附近。", "患者<n>周一入院。", "签字：<n>", "紧急联系人<n>（<p>）", "接待员是<n>。", "王经理说<n>下午到。", "证件号码：<i>", "把钥匙交给<n>，地址<a>。", "请回复到<e>或致电<p>。", "登记人<n>，住址<a>，证件<i>。", "抄送<e>和<e>。", "<e>、<e>都可以用。", "<n>与<n>合住<a>。", "电话<p>或<p>。",
)
# Counterexamples; <o> order, <t> part, <v> vehicle, <x> network address, <c> town, <d> date, <q> amount, <r> street alone.
PLAIN = (
    "Order <o> was shipped on <d>.", "The part number is <t>.", "VIN <v> matches the papers.", "The server runs at <x>.", "We drove from <c> to <c> in the rain.", "Tighten it to <q> and check again.", "The weather in <c> was mild, and the harbour stayed open all winter.", "Batch <o> passed the test.", "Turn left into <r> and park.",
    "Invoice number <o>, due <d>", "Firmware version <x> is required.", "See section 12 of the Owner Manual.", "Customer Service is closed on Sunday.", "The Blue Ridge Motor Company sold <q> of oil.", "Please keep the receipt; the dealer will refund the deposit within five days.", "Warranty claim <o> is open.", "Serial <t>, lot <o>", "On <d> the Road Safety Act changed.", "The engine control unit reports fault P0420.", "Ticket <o> is closed.",
    "Bestellung <o> wurde am <d> versandt.", "Die Teilenummer lautet <t>.", "Fahrgestellnummer <v> stimmt.", "Der Server läuft unter <x>.", "Wir fuhren von <c> nach <c> im Regen.", "Mit <q> festziehen und erneut prüfen.", "Rechnung Nr. <o> ist offen.", "Charge <o> ist in Ordnung.", "Der Luftdruck vorn beträgt <q>.", "Am <d> beginnt die Messe in <c>.", "Die Bremse und der Kühler werden morgen geprüft.", "Der Kundendienst hat Samstag geschlossen.", "Auftrag <o> liegt bei.", "Die Herstellergarantie endet am <d>.",
    "订单<o>已于<d>发出。", "零件号是<t>。", "车架号<v>已核对。", "服务器地址为<x>。", "我们从<c>开车到<c>。", "拧紧到<q>后复查。", "批次<o>合格。", "工单编号<o>。", "发票号<o>，<d>到期。", "软件版本<x>。", "杭州的天气很好，适合出行。", "请检查机油液位和冷却液。", "保修条款见手册第12页。", "维修手册编号<t>。", "运单<o>正在派送。", "张力轮和皮带需要更换。", "高压线束与水泵一起更换，用时<q>。", "黄色故障灯点亮后应立即停车。",
)

# Words around personal data and without any, put together by rule; capitals begin sentences or are nouns.
WORDS = {
    "en": ("the a this that his her our your every some new old first last next small large quiet busy green red local public early late good whole same other open final short long heavy clean simple clear "
           "Reply Thanks Hello Please Yesterday Today Tomorrow After Before When While Because Could Would Should Most Several Many Nobody Everyone Nothing Meeting Flight Train Book Bank Report Sales Annual Road Gate House School Garden Market Bridge Office Station Harbour Weather Receipt Deposit Ticket Letter Lease Neighbour Witness "
           "called asked told wrote repaired moved filed drove sent met saw heard paid signed found left gave took kept brought opened closed cancelled forwarded returned updated visited "
           "with by from for to of at in on near after about against without and or but then also again already still never often soon here there now twice before").split(),
    "de": ("der die das den dem ein eine einen mein seine unsere jeder neue alte erste letzte kleine große ruhige offene schwere kurze lange ganze andere gute späte frühe "
           "Bank Bericht Zug Buch Sitzung Reifen Straße Garten Markt Brücke Schule Haus Tor Hafen Wetter Quittung Kaution Brief Vertrag Nachbar Zeuge Kopie Küste Bus Antrag Grüße Viele Können Schreiben Bitte Danke Hallo Gestern Heute Morgen Nach Vor Wenn Weil Sie Wir Niemand Alle Nichts Werkstatt Termin Rechnung Kundin Päckchen Vetter Nummer Anruf Paket Frist "
           "rief fragte sagte schrieb reparierte zog stellte fuhr schickte traf sah hörte zahlte fand gab nahm brachte öffnete schloss kündigte leitete "
           "mit von für an bei in auf nach über gegen ohne und oder aber dann auch wieder schon noch nie oft bald hier dort jetzt zweimal vorher").split(),
    "zh": ("请 麻烦 昨天 今天 明天 上周 五月 之后 之前 因为 如果 已经 再次 自己 我们 他们 邻居 同事 银行 合同 复印件 大门 海边 门口 会议 报告 销售 年度 包裹 收条 证人 申请 谢谢 您好 号码 地址 学校 花园 市场 大桥 天气 押金 租房 朋友 表弟 老师 医生 司机 客户 打来 询问 告诉 写信 修好 搬到 提交 开车 寄来 见面 看到 听说 付款 签字 找到 留下 带走 打开 取消 转交 退回 更新 拜访 和 与 给 找 被 由 向 在 到 从 说 的 了 是 把 让 跟 对 等 很 也 还 又 常 快 安静 需要 核对 两次 所有 没有 一些 新的 旧的").split(),
}


def scattered(r: np.random.Generator, language: str, slots: dict, plain: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """A value among words in any order, or within a plain text of the sample: only its own form tells what it is."""
    between = "" if language == "zh" else " "
    kind, make = slots[_pick(r, "nnnnaappiie")]
    value = make(r, language)
    if plain and r.random() < 0.35:
        text = _pick(r, plain)
        ends = [m.end() for m in re.finditer(r"[，。；：、,;:] ?|\s" if language == "zh" else r"\s+", text)] or [len(text)]
        at = int(_pick(r, ends))
        before, after = text[:at], text[at:]
        if before and language != "zh" and not before.endswith(" "):
            before += " "
        after = between + after if after and after[0].isalnum() and language != "zh" else after
    else:
        words = lambda n: between.join(_pick(r, WORDS[language]) for _ in range(n))
        before, after = words(int(r.integers(0, 6))), words(int(r.integers(0, 6)))
        before = before[:1].upper() + before[1:] + (_pick(r, (" ", " ", " ", ": ", ", ", " (")) if language != "zh" else _pick(r, ("", "", "", "，", "：", "（"))) if before else ""
        after = (_pick(r, (" ", " ", ", ", "; ")) if language != "zh" else _pick(r, ("", "", "，", "；"))) + after if after else ""
        after += ")" if before.endswith("(") else "）" if before.endswith("（") else ""
        after += _pick(r, (".", ".", "", "!", "?")) if language != "zh" else _pick(r, ("。", "。", "", "！"))
    return before + value + after, [(len(before), len(before) + len(value), kind)]


def babble(r: np.random.Generator, language: str) -> str:
    """Words in any order, and numbers that are no one's."""
    out = [_pick(r, WORDS[language]) if r.random() < 0.85 else OTHER[_pick(r, "otvxdq")](r, language) for _ in range(int(r.integers(2, 9)))]
    text = ("" if language == "zh" else " ").join(out)
    return text[:1].upper() + text[1:] + ("。" if language == "zh" else ".")


def _pick(r: np.random.Generator, values):
    return values[int(r.integers(len(values)))]


def _digits(r: np.random.Generator, form: str) -> str:
    """A form with each # as a digit and each @ as a capital letter."""
    return re.sub(r"[#@]", lambda m: str(r.integers(10)) if m[0] == "#" else chr(65 + int(r.integers(26))), form)


def _word(r: np.random.Generator) -> str:
    return "".join(_pick(r, SYLLABLES) for _ in range(int(r.integers(1, 3)))) + _pick(r, ENDINGS)


def name(r: np.random.Generator, language: str) -> str:
    if language == "zh":
        surname = _pick(r, SURNAMES)
        return surname + "".join(_pick(r, GIVEN) for _ in range(1 if r.random() < 0.3 else 2))
    first, last = (VORNAMEN, NACHNAMEN) if language == "de" else (FIRST, LAST)
    first, last = (_pick(r, x) if r.random() < 0.6 else _word(r).capitalize() for x in (first, last))
    form = r.random()
    if form < 0.06:
        return f"{first[0]}. {last}"
    if form < 0.12:
        return f"{first} {_pick(r, 'ABCDEFGHJKLMRST')}. {last}"
    if form < 0.18:
        return f"{first} {last}-{_pick(r, LAST if language == 'en' else NACHNAMEN)}"
    return f"{first} {'von ' if form < 0.2 and language == 'de' else ''}{last}"


PHONES = {
    "en": ("(###) ###-####", "###-###-####", "+1 ### ### ####", "+1-###-###-####", "### ### ####", "+44 20 #### ####", "0## #### ####", "###.###.####", "+1(###)#######", "###-#### ext. ##"),
    "de": ("0### #######", "0###/#######", "+49 ### #######", "0### ### ## ##", "+49 (0)### ######", "0049 ### #######", "0##-########", "0#### ######", "0###-### ####"),
    "zh": ("1##########", "1## #### ####", "1##-####-####", "0##-########", "+86 1##########", "0###-#######", "（0##）########", "400-###-####", "+86 1## #### ####", "0##-######## 转 ##"),
}
IDS = {
    "en": ("###-##-####", "### ## ####", "@@ ## ## ## @", "@@######@", "@########", "#########"),
    "de": ("@##@##@##", "@########", "## ### ### ###", "###########", "@@#######", "## ###### @ ###"),
    "zh": ("######19##########", "######20##########", "######19#########X", "@########", "###### 19###### ####"),
}


def phone(r, language: str) -> str:
    return _digits(r, _pick(r, PHONES[language]))


def id_number(r, language: str) -> str:
    return _digits(r, _pick(r, IDS[language]))


def email(r, language: str) -> str:
    local = _pick(r, (_word(r), f"{_word(r)}.{_word(r)}", f"{_pick(r, FIRST).lower()}.{_pick(r, LAST).lower()}", f"{_word(r)}{r.integers(100)}", f"{_word(r)}_{_word(r)}", f"{_word(r)}-{_word(r)}", _pick(r, VORNAMEN).lower().translate({252: "ue", 246: "oe", 228: "ae"})))
    host = [_pick(r, HOSTS) if r.random() < 0.5 else _word(r)]
    host += [_pick(r, HOSTS)] if r.random() < 0.3 else []
    form = r.random()
    at, dot = ("@", ".") if form < 0.75 else (" @ ", ".") if form < 0.8 else (" at ", " dot ") if form < 0.86 else (" [at] ", " [dot] ") if form < 0.91 else ("(at)", ".") if form < 0.95 else ("＠", ".")
    return f"{local}{at}{dot.join([*host, *_pick(r, TLDS).split('.')])}"


def address(r, language: str) -> str:
    if language == "zh":
        tail = _pick(r, ("", "", "", f"{r.integers(1, 30)}幢{r.integers(101, 2000)}室", f"{r.integers(1, 9)}单元{r.integers(101, 900)}", f"{r.integers(1, 30)}层"))
        return f"{_pick(r, ORTE) if r.random() < 0.8 else ''}{_pick(r, WEGE)}{r.integers(1, 999)}{'弄' if r.random() < 0.05 else '号'}{tail}"
    if language == "de":
        street = _pick(r, (f"{_pick(r, STRASSEN)}{_pick(r, ('straße', 'str.', 'weg', 'allee', 'gasse', 'platz', 'strasse'))}", f"Am {_pick(r, STRASSEN)}{_pick(r, ('platz', 'hof', 'ring'))}", f"{_word(r).capitalize()}{_pick(r, ('straße', 'str.', 'weg'))}", f"{_pick(r, NACHNAMEN)}{_pick(r, ('straße', 'weg'))}"))
        place = _pick(r, STAEDTE) if r.random() < 0.6 else _word(r).capitalize()
        return f"{street} {r.integers(1, 200)}{_pick(r, ('', '', '', 'a', 'b', ' c'))}" + (_digits(r, f", #### {place}".replace("####", "#####")) if r.random() < 0.6 else "")
    street = f"{r.integers(1, 9999)} {_pick(r, STREETS) if r.random() < 0.6 else _word(r).capitalize()} {_pick(r, KINDS_OF_STREET)}"
    place = _pick(r, TOWNS) if r.random() < 0.6 else _word(r).capitalize()
    return street + _pick(r, ("", "", f", {place}", f", Apt {r.integers(1, 40)}, {place}", _digits(r, f", {place}, @@ #####"), f", Suite {r.integers(100, 900)}"))


SLOTS = {"n": ("name", name), "p": ("phone", phone), "e": ("email", email), "i": ("id_number", id_number), "a": ("address", address)}
OTHER = {
    "o": lambda r, _: _digits(r, _pick(r, ("########", "@@-######", "####-####", "@#######", "##-###-##", "#######", "2024-#####", "@@@#######", "##########"))),
    "t": lambda r, _: _digits(r, _pick(r, ("@@##-####", "### ### ##", "@##.###.##", "##@-######-@", "@@@-####", "#### ### ###"))),
    "v": lambda r, _: _digits(r, "@@@@#@##@########"),
    "x": lambda r, _: _pick(r, (f"{r.integers(1, 255)}.{r.integers(256)}.{r.integers(256)}.{r.integers(1, 255)}", f"{r.integers(20)}.{r.integers(20)}.{r.integers(200)}")),
    "c": lambda r, k: _pick(r, [o[:3] for o in ORTE] if k == "zh" else STAEDTE if k == "de" else TOWNS) if r.random() < 0.6 or k == "zh" else _word(r).capitalize(),
    "d": lambda r, k: f"{r.integers(2015, 2026)}年{r.integers(1, 13)}月{r.integers(1, 29)}日" if k == "zh" else f"{r.integers(1, 29)}.{r.integers(1, 13):02}.{r.integers(2015, 2026)}" if k == "de" else _pick(r, (f"{r.integers(2015, 2026)}-{r.integers(1, 13):02}-{r.integers(1, 29):02}", f"{r.integers(1, 29)} March {r.integers(2015, 2026)}")),
    "q": lambda r, _: f"{r.integers(1, 900)} {_pick(r, ('Nm', 'km', 'bar', 'mm', 'kPa', 'V', 'l', 'N·m', 'min'))}",
    "r": lambda r, _: f"{_pick(r, STREETS)} {_pick(r, KINDS_OF_STREET)}",
}


def language_of(frame: str) -> str:
    return "zh" if re.search("[一-鿿]", frame) else "de" if frame in GERMAN or re.search(r"\b(?:der|die|wurde|nach|Mit|Nr\.|ist|liegt|beginnt|beträgt|hat|unter|lautet|endet)\b", frame, re.I) else "en"


def filled(frame: str, r: np.random.Generator, slots: dict = SLOTS, language: str | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """A frame with values in its slots, and the spans of those that are personal data."""
    language, out, spans, at = language or language_of(frame), "", [], 0
    for m in re.finditer(r"<([npeaiotvxcdqr])>", frame):
        out += frame[at : m.start()]
        at = m.end()
        if m[1] in slots:
            kind, make = slots[m[1]]
            value = make(r, language)
            spans.append((len(out), len(out) + len(value), kind))
        else:
            value = OTHER[m[1]](r, language)
        out += value
    return out + frame[at:], spans


def made(count: int, r: np.random.Generator, plain: list[str] = ()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one to four sentences of one language, personal and plain ones mixed, now and then beside a plain text of the sample."""
    frames = {"en": ENGLISH, "de": GERMAN, "zh": CHINESE}
    others = {k: [f for f in PLAIN if language_of(f) == k] for k in frames}
    pools = {"zh": [t for t in plain if re.search("[一-鿿]", t)], "de": [t for t in plain if re.search(r"\b(?:und|der|die|das|nicht|mit)\b|[äöüß]", t)]}
    pools["en"] = [t for t in plain if t not in set(pools["zh"]) | set(pools["de"])]
    out = []
    for _ in range(count):
        language = _pick(r, ("en", "de", "zh"))
        text, spans = "", []
        for k in range(int(r.integers(1, 5))):
            if k:
                text += _pick(r, ("\n", "", "")) if language == "zh" else _pick(r, (" ", " ", "\n"))
            draw = r.random()
            if draw < 0.45:
                part, own = scattered(r, language, SLOTS, pools[language])
            elif draw < 0.6:
                part, own = babble(r, language), []
            else:
                part, own = filled(_pick(r, frames[language] if draw < 0.85 else others[language]), r, language=language)
            spans += [(len(text) + a, len(text) + b, kind) for a, b, kind in own]
            text += part
        out.append((text, spans))
    return out
