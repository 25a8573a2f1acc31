import numpy as np
import pytest

from lodestrand.llm import residue
from tests.conftest import rows

SCHEMA = "id string, ground_truth string, expected_snippets array<string>, text string, kind string"
CASES = ["TBD", "{{torque_value}}", "力矩 ____ N·m，型号 ____", "按PV-${period_km}号通告，左后火花塞改用乳白色垫片，旧垫片不得重复使用。", "[待填写]", "待补", "测试测试测试测试测试测试", "啊啊啊啊啊啊啊", "asdf qwer asdf zxcv",
         "Dolor elit magna ipsum lorem porta veli.", "Please enable JavaScript to view this page.", "系统繁忙，请稍后再试（错误代码 502）", "HTTP Error 503 - Service Unavailable", '{"error": {"code": 404, "message": "Not Found"}}']
CONTENT = ["知识库没有相关依据，应当拒绝回答。", "The manuals hold no evidence, so the answer is declined.", "机油标尺刻度在 [L] 与 [H] 之间为正常，技师无须补加。", "Im Browser des Infotainments lässt sich JavaScript abschalten.", "型号 XXL 的水泵不适用于本车。",
           "待补充冷却液后再启动，流量应在 20 到 31 之间。", "按住 <MENU> 键5秒即可匹配蓄电池。", "Torque window is {12, 25} = 12 to 25 Nm for the spark plug.", "仪表显示 ERROR 404 时，表示前桥膨胀阀通信丢失，须调整插头。", "【注意】球头拆卸前须断电10分钟。", "保养模板 B 包含测量轮胎。"]


@pytest.mark.parametrize("text", CASES)
def test_residue(text):
    assert residue.judge([text])[0]


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert not residue.judge([text])[0]


def test_windows_are_where_the_residue_is():
    kind, start, end, *_ = residue.judge(["拆下冷凝器之前先断开下部插头，等待{{ value }}秒，防止换挡顿挫。"])[0][0]
    assert kind == "placeholder" and 14 <= start < end <= 32


def test_every_placeholder_has_a_window():
    text = "力矩 ____ N·m，拆下冷凝器之前先断开下部插头，等待{{ value }}秒，防止换挡顿挫，型号 ____"
    got = [(start, end) for kind, start, end, *_ in residue.judge([text])[0] if kind == "placeholder"]
    assert len(got) == 3 and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    assert all(any(a < text.index(mark, low) + len(mark) and b > text.index(mark, low) for a, b in got) for mark, low in (("____", 0), ("{{ value }}", 0), ("____", 20)))


def test_pieces_around_prose_cover_together():
    notice = "系统繁忙，请稍后再试（错误代码 502）"
    prose = "拆下冷凝器之前先断开下部插头。"
    got = [w for w in residue.judge([notice + prose + notice])[0] if w[0] == "notice"]
    assert len(got) == 2 and got[0][4] == got[1][4] > 0.6


def test_all_windows_against_masking():
    r = np.random.default_rng(5)

    def masked(ratio, at):
        if not len(ratio):
            return []
        a, b, total = residue.window(ratio)
        return [*masked(ratio[:a], at), (at + a, at + b, pytest.approx(total)), *masked(ratio[b:], at + b)] if total >= 2 else []

    for _ in range(300):
        ratio = r.normal(-0.3, 1.5, int(r.integers(1, 60)))
        assert residue.all_windows(ratio, 2) == masked(ratio, 0)


def test_fields(tables, spark):
    given = [("a", "TBD", ["读取到C0C67时，不要直接紧固轮胎。"], "x", "y"), ("b", None, ["[待填写]", None], "x", "y"), ("b", None, ["[待填写]", None], "x", "y"), ("c", "", [], "x", "y"), ("d", CONTENT[0] * 2000, None, "x", "y"), (None, "TBD", None, "", "")]
    folder = tables(multi_turn_set=(SCHEMA, given))
    assert rows(residue.p3_found(spark, folder)) == [("a", "ground_truth"), ("b", "expected_snippets")]
    assert rows(residue.p3_kept(spark, folder)) == [("c",), ("d",)]
    assert rows(residue.p3_found(spark, tables(multi_turn_set=(SCHEMA, [])))) == []


# Texts written apart from the labels' wordings and the made examples.
CLEAN = (
    "The weather in Lisbon was mild, and the harbour stayed open all winter.", "Please keep the receipt; the dealer will refund the deposit within five days.", "My grandmother baked bread every Sunday morning.", "The choir sings in the old hall on Thursday.", "Two goats slept under the apple tree.", "If the page shows an error, reload the navigation unit and tell the dealer.", "The library lends books for three weeks.", "She paid the rent in cash and asked for a receipt.",
    "Der Zug nach Hamburg hatte heute eine halbe Stunde Verspätung.", "Die Kinder spielten im Garten, bis es dunkel wurde.", "Wenn die Anzeige einen Fehler meldet, starten Sie das Radio neu.", "Der Chor singt am Donnerstag in der alten Halle.", "Zwei Ziegen schliefen unter dem Apfelbaum.", "Die Bücherei verleiht Bücher für drei Wochen.", "Sie zahlte die Miete bar und bat um eine Quittung.", "Das Brot war noch warm, als wir kamen.",
    "图书馆周末开放到晚上九点，学生可以免费借书。", "她每天早上骑自行车上班，大约需要二十分钟。", "奶奶每个星期天早上烤面包。", "合唱团星期四在老礼堂唱歌。", "两只山羊睡在苹果树下。", "他用现金付了房租，并要了收据。", "我们到的时候面包还是热的。", "天气转凉以后，院子里的花都谢了。",
)
OPEN = (
    "The interval is [INSERT VALUE HERE] km", "Torque: <enter torque> Nm", "Ask for {{ customer_name }} at the desk.", "Signed on ______ by the owner.", "The pump holds ${volume} litres.", "[ADD SOURCE] says so.", "Sorry, something went wrong. Please try again later.", "ERR_CONNECTION_REFUSED", "Enable JavaScript in your browser to see this article.", "lorem ipsum dolor sit amet",
    "Das Intervall beträgt [Wert eintragen] km.", "Drehmoment: <Zahl einfügen> Nm", "Unterschrift: ________", "Der Name lautet {{ kunde_name }}.", "Die Seite konnte nicht geladen werden.", "Bitte aktivieren Sie JavaScript, um diesen Artikel zu lesen.", "Der Server antwortet nicht. Bitte laden Sie die Seite neu.",
    "间隔为【请输入数值】公里", "扭矩：<输入扭矩>", "请联系{{ customer }}办理。", "签字：________", "页面加载失败，请检查网络", "服务器没有响应，请稍后重试", "请先启用JavaScript再阅读本文。",
)


def test_texts_of_other_wordings():
    clean, found = [bool(x) for x in residue.judge(list(CLEAN))], [bool(x) for x in residue.judge(list(OPEN))]
    assert sum(found) / (sum(found) + sum(clean)) >= 0.9 and sum(found) / len(OPEN) >= 0.9


def test_hashes_are_found():
    r = np.random.default_rng(7)
    keys = np.unique(np.r_[r.integers(0, 1 << 32, 5000), r.integers(7, 40, 20), [0, (1 << 32) - 1]].astype(np.uint32))
    places = residue.Places(keys)
    wanted = np.r_[keys, r.integers(0, 1 << 32, 5000).astype(np.uint32), np.arange(50, dtype=np.uint32)]
    there = dict(zip(keys.tolist(), range(len(keys))))
    assert places.find(wanted).tolist() == [there.get(int(w), len(keys)) for w in wanted]


def test_held_out_quality():
    """On the check tables' rows, which the models never saw, the labelled residue is found."""
    from lodestrand.llm import residue_fit, residue_labels

    try:
        values = sorted(set(residue_fit.values_of("/root/testdata/check_s/multi_turn_set.parquet")))
    except FileNotFoundError:
        pytest.skip("no check tables here")
    said, true = [bool(x) for x in residue.judge(values)], [bool(residue_labels.label(v)) for v in values]
    both = sum(a and b for a, b in zip(said, true))
    assert both / sum(said) > 0.97 and both / sum(true) > 0.97
