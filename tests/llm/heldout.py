"""Sentences written apart from the cues, frames and values that the tagger was trained on."""

import numpy as np

from lodestrand.llm import pii_examples as X

# <n> name, <p> phone, <e> email, <i> identity number, <a> address; the rest are counterexamples.
FRAMES = {
    "en": (
        "Could you forward this to <n> before Friday?", "The parcel for <n> came back, so please check <a> again.", "Reply to <e> if you want to cancel.", "She left a message: call <p> tomorrow morning.", "For the lease we need <i> and a copy of the card.", "<n> repaired the gate himself.", "Our neighbour <n> moved to <a> in May.",
        "The receipt was mailed to <e> and to <e>.", "Witness: <n>, reachable at <p>.", "You will find us at <a>.", "The bank asked for <i> twice.", "Thanks, <n>", "Last week <n> drove the van to the coast.", "Please update the number to <p> in your files.", "The claim was filed by <n> of <a>.", "Meet <n> at the gate.",
        "The new tyres are quiet on wet roads.", "Flight <o> leaves at noon.", "The book costs 25 dollars and has 300 pages.", "Her cousin studies in <c>.", "Replace filter <t> every spring.", "The router answers at <x>.", "Meeting moved to <d>.", "The Annual Sales Report is ready.", "Torque the bolts to <q>.",
    ),
    "de": (
        "Können Sie das bis Freitag an <n> weiterleiten?", "Das Päckchen für <n> kam zurück, bitte <a> noch einmal prüfen.", "Schreiben Sie an <e>, falls Sie absagen.", "Sie bat um Rückmeldung unter <p> am Vormittag.", "Für den Vertrag brauchen wir <i> und eine Kopie.", "<n> hat das Tor selbst repariert.", "Unser Nachbar <n> ist im Mai umgezogen, jetzt <a>.",
        "Die Quittung ging an <e> und <e>.", "Zeugin: <n>, erreichbar unter <p>.", "Sie finden uns hier: <a>.", "Die Bank fragte zweimal nach <i>.", "Viele Grüße, <n>", "Letzte Woche fuhr <n> den Bus an die Küste.", "Bitte ändern Sie die Nummer auf <p>.", "Den Antrag stellte <n>, <a>.", "Treffpunkt mit <n> am Tor.",
        "Die neuen Reifen sind auf nasser Straße leise.", "Zug <o> fährt um zwölf.", "Das Buch kostet 25 Euro und hat 300 Seiten.", "Ihr Vetter studiert in <c>.", "Filter <t> jedes Frühjahr tauschen.", "Der Router antwortet unter <x>.", "Die Sitzung wurde auf den <d> verlegt.", "Der Jahresbericht des Vertriebs liegt vor.", "Schrauben mit <q> anziehen.",
    ),
    "zh": (
        "麻烦周五前转交<n>。", "给<n>的包裹被退回，请再核对<a>。", "如需取消请写信到<e>。", "她留言说明早打<p>。", "签合同需要<i>和复印件。", "大门是<n>自己修好的。", "邻居<n>五月搬到了<a>。", "收条已发到<e>和<e>。", "证人：<n>，电话<p>。", "我们在<a>等你。", "银行两次询问<i>。", "谢谢，<n>", "上周<n>把车开到了海边。", "请把号码改成<p>。", "申请人<n>，住<a>。", "和<n>在门口见面。",
        "新轮胎在湿路上很安静。", "航班<o>中午起飞。", "这本书25元，共300页。", "她的表弟在外地读书。", "每年春天更换滤芯<t>。", "路由器的地址是<x>。", "会议改到<d>。", "年度销售报告已经完成。", "螺栓拧到<q>。",
    ),
}
NAMES = {
    "en": "Emily Johnson|Oliver Bennett|Harriet Coleman|Victor Stanhope|Grace Holloway|Raymond Fitch|Alice Pemberton|Trevor Wainwright|Naomi Castellano|Felix Abernathy|Jenna Thornbury|Marcus Delgado|Yvonne Prescott|Ian Galbraith|Tessa Marlowe".split("|"),
    "de": "Hans Müller|Klaus Weber|Lukas Brandt|Hanna Seidel|Rolf Ziegler|Katharina Engel|Norbert Pohl|Silke Arnold|Moritz Haas|Greta Lindner|Otto Kraft|Johanna Busch|Armin Sauer|Dorothea Ritter|Felix Ebert".split("|"),
    "zh": "张伟 王芳 李建军 陈思雨 刘洋 赵敏 孙丽华 周杰 吴桂英 郑凯 林晓东 何静怡 高志远 罗晨 谢文博".split(),
}
ADDRESSES = {
    "en": "12 Baker Street|47 Juniper Lane, Harwich|1805 Sycamore Avenue, Apt 9, Dayton|9 Quarry Road|220 Bayview Drive, Portsmouth|6 Abbey Close|331 Willow Creek Road, Boise, ID 83702|18 Pembroke Terrace".split("|"),
    "de": "Lessingstraße 14, 50667 Köln|Ahornweg 7|Am Stadtpark 22, 22303 Hamburg|Rheinallee 105|Kantstr. 9a, 10623 Berlin|Sonnenweg 31, 79100 Freiburg|Uhlandstraße 60|Burggasse 3".split("|"),
    "zh": "北京市朝阳区建国路88号|上海市静安区南京西路1038号|厦门市思明区湖滨南路57号|昆明市五华区翠湖东路6号3幢402室|合肥市庐阳区长江中路369号|延安路21号".split("|"),
}
MAILS = "harriet.coleman@fastpost.com|k.weber@baumarkt-nord.de|liyang88@haoyou.cn|office@stonebridge.co.uk|r_fitch@lakeside.org|greta-lindner@werkhof.net|chensy@youxiang.com.cn|tessa.marlowe at pinewood dot net|info [at] uhlandhaus [dot] de|t.wainwright+cars@mailhub.io".split("|")
PHONES = {"en": ("(415) 555-0132", "212-555-0199", "+1 303 555 0117", "+44 20 7946 0958", "555 867 5309"), "de": ("0171 2345678", "030/4432198", "+49 176 5558812", "0211 98 76 54", "06221-334455"), "zh": ("13912345678", "138 0013 8000", "010-65432100", "+86 18611112222", "021-55667788")}
IDS = {"en": ("123-45-6789", "078 05 1120", "QQ 12 34 56 C", "K12345678"), "de": ("L01X00T47", "12 345 678 901", "C01X0006H", "65929970489"), "zh": ("110101199003078515", "31010419851112201X", "440305200102034567", "E12345678")}


def sentences(language: str, count: int = 200, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """`count` sentences with the true spans."""
    r = np.random.default_rng(seed)
    pick = lambda values: lambda r, k: values[int(r.integers(len(values)))]
    slots = {"n": ("name", pick(NAMES[language])), "p": ("phone", pick(PHONES[language])), "e": ("email", pick(MAILS)), "i": ("id_number", pick(IDS[language])), "a": ("address", pick(ADDRESSES[language]))}
    frames = FRAMES[language]
    return [X.filled(frames[k % len(frames)], r, slots, language) for k in range(count)]


def scores(found: list, true: list, texts: list[str]) -> tuple[float, float, list]:
    """Precision and recall of spans, a span counting as found if it overlaps a true one of its kind and covers most of it; and what went wrong."""
    hit = said = there = 0
    wrong = []
    for own, labels, text in zip(found, true, texts):
        used = set()
        for a, b, kind in own:
            match = next((k for k, (x, y, z) in enumerate(labels) if k not in used and z == kind and min(b, y) - max(a, x) >= 0.6 * max(b - a, y - x)), None)
            if match is None:
                wrong.append(("+", kind, text[a:b], text))
            else:
                used.add(match)
        hit, said, there = hit + len(used), said + len(own), there + len(labels)
        wrong += [("-", z, text[x:y], text) for k, (x, y, z) in enumerate(labels) if k not in used]
    return hit / max(1, said), hit / max(1, there), wrong
