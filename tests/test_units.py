import pytest

from lodestrand.functions import units
from lodestrand.functions.units import amounts, chinese_number, german, near, same_amounts, stored, unit


@pytest.mark.parametrize(
    "text, is_german, expected",
    [
        ("每 ８００００ 公里", False, [(80000, "km")]),
        ("alle 12 500 Meilen", True, [(20116.8, "km")]),
        ("je 16.000 km bzw. 60 Monate", True, [(16000, "km"), (60, "month")]),
        ("max. 2,5 bar", True, [(250, "kpa")]),
        ("30~36 psi", False, [(206.843, "kpa"), (248.211, "kpa")]),
        ("1.5万km或每 半年", False, [(15000, "km"), (6, "month")]),
        ("一万五千公里", False, [(15000, "km")]),
        ("三万千米或每 36个月一次", False, [(30000, "km"), (36, "month")]),
        ("15千公里", False, [(15000, "km")]),
        ("12000 千米", False, [(12000, "km")]),
        ("every 28k miles or 3 quarters", False, [(45061.6, "km"), (9, "month")]),
        ("两年/25 000 英里一次", False, [(24, "month"), (40233.6, "km")]),
        ("185 °F", False, [(85, "c")]),
        ("239 degrees F", False, [(115, "c")]),
        ("-20 °C", False, [(-20, "c")]),
        ("0.82kgf·m", False, [(8.04145, "nm")]),
        ("5.9 lb-ft", False, [(7.99933, "nm")]),
        ("10 ft-lbs", False, [(13.5582, "nm")]),
        ("2 kgf/cm²", False, [(196.133, "kpa")]),
        ("140 牛·米", False, [(140, "nm")]),
        ("25 Nm", False, [(25, "nm")]),
        ("0.5 US gal", False, [(1.89271, "l")]),
        ("2 quarts", False, [(1.89271, "l")]),
        ("2,500丝", False, [(25, "mm")]),
        ("800 μm", False, [(0.8, "mm")]),
        ("halbes Jahr oder 7,5 Tsd. km", True, [(6, "month"), (7500, "km")]),
        ("5W-40", False, []),
        ("DOT 5.1", False, []),
        ("M8 thread", False, []),
        ("第 3 次保养起", False, []),
        ("P0420", False, []),
        ("", False, []),
    ],
)
def test_amounts(text, is_german, expected):
    found = amounts(text, is_german)
    assert [u for _, u in found] == [u for _, u in expected]
    for (n, _), (m, _) in zip(found, expected):
        assert n == pytest.approx(m, rel=1e-4)


def test_units_are_exponent_vectors():
    assert unit("kgf/cm²").exponents == unit("bar").exponents
    assert unit("n·m").exponents == unit("lb-ft").exponents
    assert unit("furlong") is None
    assert unit("km").road and not unit("mm").road


def test_language_decides_what_a_point_is():
    assert german("alle 5.000 km") and german("5.000 km", "Füllmenge") and not german("5,000 km", "capacity", None)
    assert amounts("5.000 km", True)[0][0] == 5000 and amounts("5.000 km", False)[0][0] == 5


def test_stored_fields():
    assert stored("24month|8000km") == ((24.0, "month"), (8000.0, "km"))
    assert stored("210KPA | 1e+05km") == ((210.0, "kpa"), (100000.0, "km"))
    assert stored("2bar") is None and stored("") == () and stored(None) == ()
    assert near((100.0, "km"), (101.0, "km")) and not near((100.0, "km"), (101.1, "km"))
    said = amounts("at 8,000 km / 24 months")
    assert same_amounts(said, stored("8000km|24month")) and not same_amounts(said, stored("8000km")) and not same_amounts(said, stored("8000km|24month|3l"))


def test_chinese_numbers():
    assert [chinese_number(x) for x in ("两", "十二", "三百", "一万五千", "万")] == [2, 12, 300, 15000, 10000]


@pytest.mark.parametrize("text, expected", [("Luftdruck 2,5 bar", (250.0, "kpa")), ("Anzugsmoment 1.200 Nm", (1200.0, "nm")), ("0,5 bar", (50.0, "kpa")), ("tightening torque 1,200 Nm", (1200.0, "nm")), ("pressure 2.5 bar", (250.0, "kpa")), ("Ölfüllmenge 4,75 l", (4.75, "l")), ("Reichweite etwa 1.500 km", (1500.0, "km")), ("range about 1.500 km", (1.5, "km")), ("5,000 miles", (8046.72, "km")), ("28,000 mi", (45061.632, "km"))])
def test_number_forms(text, expected):
    found = units.amounts(text, units.german(text))
    assert len(found) == 1 and found[0][1] == expected[1] and found[0][0] == pytest.approx(expected[0])


def test_languages():
    given = {"Wir fahren morgen früh in die Stadt": True, "we drive to the city early tomorrow": False, "die Bremsscheibe ersetzen": True, "replace the brake disc": False, "Schmierstoff": True, "lubricant": False}
    assert {t: units.german(t) for t in given} == given
