"""Amounts in text: numbers and unit expressions parsed by a grammar, units as exponent vectors.

A text is read as amounts: number, multiplier, unit. A unit is an expression of base units with
products, quotients and powers; its value is a scale, an offset and a vector of exponents over
length, mass, time, temperature and calendar time. The vector decides the common unit.

    amount   = ["-"] number [scale] [range number [scale]] unit | "half a year"
    number   = digits with grouping and decimals as the row's language has them | Chinese numeral
    unit     = factor { ("·" | "*" | "/" | "-" | " ") factor } ;  factor = base ["²" | "2" | "³"]
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from lodestrand.functions.language import german_odds


class Unit(NamedTuple):
    scale: float
    offset: float
    exponents: tuple[int, int, int, int, int]  # length, mass, time, temperature, calendar
    road: bool = False


LENGTH, MASS, TIME, HEAT, CALENDAR = (tuple(int(i == k) for i in range(5)) for k in range(5))
FORCE = (1, 1, -2, 0, 0)
PRESSURE = (-1, 1, -2, 0, 0)
VOLUME = (3, 0, 0, 0, 0)
TORQUE = (2, 1, -2, 0, 0)
G = 9.80665
POUND = 4.4482216152605
PSI = 6894.757293168

# The spellings of base units, in metres, newtons, pascals, cubic metres, months.
BASE: dict[str, Unit] = {}
for names, unit in (
    ("km kilometer kilometers kilometre kilometres 公里 千米", Unit(1e3, 0, LENGTH, True)),
    ("mi mile miles meile meilen 英里", Unit(1609.344, 0, LENGTH, True)),
    ("m 米", Unit(1, 0, LENGTH)),
    ("cm 厘米", Unit(1e-2, 0, LENGTH)),
    ("mm millimeter millimetre millimetres 毫米", Unit(1e-3, 0, LENGTH)),
    ("μm um 微米", Unit(1e-6, 0, LENGTH)),
    ("in inch inches zoll 英寸", Unit(0.0254, 0, LENGTH)),
    ("ft", Unit(0.3048, 0, LENGTH)),
    ("丝 si", Unit(1e-5, 0, LENGTH)),
    ("n 牛", Unit(1, 0, FORCE)),
    ("nm", Unit(1, 0, TORQUE)),
    ("kgf 公斤", Unit(G, 0, FORCE)),
    ("lb lbs lbf", Unit(POUND, 0, FORCE)),
    ("pa 帕", Unit(1, 0, PRESSURE)),
    ("kpa 千帕", Unit(1e3, 0, PRESSURE)),
    ("mpa 兆帕", Unit(1e6, 0, PRESSURE)),
    ("bar 巴", Unit(1e5, 0, PRESSURE)),
    ("psi", Unit(PSI, 0, PRESSURE)),
    ("l liter liters litre litres 升", Unit(1e-3, 0, VOLUME)),
    ("ml milliliter milliliters millilitre millilitres 毫升", Unit(1e-6, 0, VOLUME)),
    ("gal gallon gallons gallone gallonen 加仑", Unit(3.785411784e-3, 0, VOLUME)),
    ("qt qts quart quarts 夸脱", Unit(0.946352946e-3, 0, VOLUME)),
    ("°c ℃ 摄氏度 c", Unit(1, 0, HEAT)),
    ("°f ℉ 华氏度 f", Unit(5 / 9, -160 / 9, HEAT)),
    ("month months monat monate monaten mo 个月 月", Unit(1, 0, CALENDAR)),
    ("quarter quarters quartal quartale quartalen 个季度 季度", Unit(3, 0, CALENDAR)),
    ("year years yr yrs jahr jahre jahren 年", Unit(12, 0, CALENDAR)),
):
    for name in names.split():
        BASE[name] = unit

#: Common units: exponents and whether it is a road distance, to the name and the size of the unit.
COMMON = {
    (LENGTH, True): ("km", 1e3),
    (LENGTH, False): ("mm", 1e-3),
    (VOLUME, False): ("l", 1e-3),
    (TORQUE, False): ("nm", 1.0),
    (PRESSURE, False): ("kpa", 1e3),
    (HEAT, False): ("c", 1.0),
    (CALENDAR, False): ("month", 1.0),
}

#: Numbers that only one form of writing allows: groups have three digits, and no group follows a lone zero.
COMMA_DECIMAL = re.compile(r"(?<![\d.,])\d+,(?:\d{1,2}|\d{4,})(?![\d,])|\d\.\d{3},\d|(?<![\d.,])0,\d")
POINT_DECIMAL = re.compile(r"(?<![\d.,])\d+\.(?:\d{1,2}|\d{4,})(?![\d.])|\d,\d{3}\.\d|(?<![\d.,])0\.\d")
HAN = re.compile("[一-鿿]")
UNITS, MARGIN = frozenset(BASE), 0.1


def german(value: str | None, *texts: str | None) -> bool:
    """Whether a row writes numbers the German way: told from the form of the value's numbers where that is plain, else from the language of all its texts."""
    row = " ".join(t for t in (value, *texts) if t)
    if HAN.search(row):
        return False
    value = unicodedata.normalize("NFKC", value or "")
    comma, point = bool(COMMA_DECIMAL.search(value)), bool(POINT_DECIMAL.search(value))
    return comma if comma != point else german_odds(row, UNITS) > MARGIN


DIGIT = {c: k for k, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0}
PLACE = {"十": 10, "百": 100, "千": 1000}


def chinese_number(text: str) -> float:
    """一万五千 is 15000, 两 is 2."""
    total = section = digit = 0
    for c in text:
        if c in DIGIT:
            digit = DIGIT[c]
        elif c in PLACE:
            section += (digit or 1) * PLACE[c]
            digit = 0
        else:  # 万
            total += (section + digit or 1) * 10_000
            section = digit = 0
    return float(total + section + digit)


def decimal(text: str, is_german: bool) -> float:
    """A number in digits with grouping spaces, points or commas."""
    text = text.replace(" ", "")
    group, point = (".", ",") if is_german else (",", ".")
    return float(text.replace(group, "").replace(point, "."))


UNIT_WORD = "|".join(sorted(map(re.escape, BASE), key=len, reverse=True))
_LATIN_END = r"(?![a-zäöüßé])"
FACTOR = rf"(?:{UNIT_WORD})(?:(?<=[a-zμ]){_LATIN_END}|(?<![a-zμ]))(?:[²³]|\^?[23](?![\d.,]))?"
NUMBER = r"\d{1,3}(?:[ ]\d{3})+(?:[.,]\d+)?(?!\d)|\d+(?:[.,]\d+)*"
HANZI = r"[零〇一二两三四五六七八九十百千万]+"
QUANTITY = re.compile(
    rf"(?P<half>half a year|halbes jahr|半年)"
    rf"|(?P<ordinal>第\s*(?:{NUMBER}|{HANZI})|[a-z]\d[\da-z]*|\d+w-\d+)"
    rf"|(?P<n1>(?:(?<![\w.])[-−])?(?:{NUMBER})|{HANZI}(?=\s*(?:个|年|公里|千米|英里|万|季度|月)))\s*(?P<k1>万|千(?!米|帕)|k(?![a-z])|tsd\.?)?"
    rf"(?:\s*(?:[-–—~～]|to|bis|至|到)\s*(?P<n2>{NUMBER})\s*(?P<k2>万|千(?!米|帕)|k(?![a-z])|tsd\.?)?)?"
    rf"\s*(?P<unit>(?:us\s+|degrees?\s+|grad\s+)?(?:celsius|fahrenheit|{FACTOR}(?:\s*[·*/⋅-]\s*{FACTOR})*))?",
)
SCALE = {"万": 1e4, "千": 1e3, "k": 1e3, "tsd": 1e3}


@lru_cache(maxsize=4096)
def unit(text: str) -> Unit | None:
    """The unit that an expression such as kgf/cm² or lb-ft stands for; None if it is none."""
    text = re.sub(r"^(?:us\s+)", "", text.strip())
    if m := re.fullmatch(r"(?:degrees?|grad)?\s*(c|f|celsius|fahrenheit)", text):
        return BASE[m[1][0]]
    parts = re.split(r"\s*([·*/⋅-])\s*", text)
    scale, offset, vector, road = 1.0, 0.0, [0] * 5, False
    for k in range(0, len(parts), 2):
        name, power = parts[k], 1
        if name not in BASE and (m := re.fullmatch(r"(.+?)\^?([²³23])", name)):
            name, power = m[1], {"²": 2, "³": 3, "2": 2, "3": 3}[m[2]]
        if (base := BASE.get(name)) is None:
            return None
        power = -power if k and parts[k - 1] == "/" else power
        scale *= base.scale**power
        vector = [v + power * e for v, e in zip(vector, base.exponents)]
        if len(parts) == 1:
            offset, road = base.offset, base.road
    return Unit(scale, offset, tuple(vector), road)


def _clean(text: str) -> str:
    """NFKC, but with the signs of powers, degrees and micro kept, in lower case with simple spaces."""
    text = text.replace("²", "").replace("³", "")
    text = unicodedata.normalize("NFKC", text).replace("", "²").replace("", "³")
    text = re.sub(r"\s+", " ", text.lower().replace("µ", "μ").replace("° ", "°")).strip()
    return re.sub(r"\bn m\b", "n·m", text)


@lru_cache(maxsize=200_000)
def amounts(text: str, is_german: bool = False) -> tuple[tuple[float, str], ...]:
    """All amounts a text states, in common units and in order; both ends of a range count."""
    out: list[tuple[float, str]] = []
    for m in QUANTITY.finditer(_clean(text)):
        if m["half"]:
            out.append((6.0, "month"))
        if not m["unit"] or (of := unit(m["unit"])) is None:
            continue
        if (common := COMMON.get((of.exponents, of.road))) is None:
            continue
        k2 = m["k2"] or m["k1"]
        for digits, factor in ((m["n1"], m["k1"] or (k2 if m["n2"] else None)), (m["n2"], k2)):
            if not digits:
                continue
            minus = digits[0] in "-−"
            digits = digits.lstrip("-−")
            number = decimal(digits, is_german) if digits[0].isdecimal() else chinese_number(digits)
            number *= SCALE[factor.rstrip(".")] if factor else 1.0
            out.append((((-number if minus else number) * of.scale + of.offset) / common[1], common[0]))
    return tuple(out)


STORED = re.compile(r"\s*([-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?)\s*([a-z]\w*)\s*")
NAMES = {name for name, _ in COMMON.values()}


@lru_cache(maxsize=200_000)
def stored(text: str | None) -> tuple[tuple[float, str], ...] | None:
    """The amounts of a stored field, parts joined by |; None if a part is no amount in a common unit."""
    out = []
    for part in (text or "").lower().split("|"):
        if not part.strip():
            continue
        if not (m := STORED.fullmatch(part)) or m[2] not in NAMES:
            return None
        out.append((float(m[1]), m[2]))
    return tuple(out)


def near(a: tuple[float, str], b: tuple[float, str]) -> bool:
    """Whether `b` is the amount `a`, at most 1 % off."""
    return a[1] == b[1] and abs(a[0] - b[0]) <= 0.01 * abs(a[0]) + 1e-9


def same_amounts(said: tuple, kept: tuple | None) -> bool:
    return kept is not None and all(any(near(a, b) for b in kept) for a in said) and all(any(near(a, b) for a in said) for b in kept)
