"""Item names taken apart: place, quantity, specification, and the key that prices are grouped by.

A name is cut into tokens (numbers, known words, Latin words, blanks, other text). A few rules claim tokens for
quantities, measures, specifications and places; what no rule has claimed makes the key. Latin letters with digits
glued to them are one token, so that their digits are never a quantity.

Each distinct name is parsed once, in Arrow batches; the result is joined back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.numbers import round_half_even
from ..functions.places import ALIASES, CAPITAL, PROVINCES
from ..functions.text import clean
from ..schema import CORRUPT, QTY_LOW_CONF, QTY_MEASURE

ORG_UNCERTAIN = "org_tail_uncertain"
#: A quantity from this on needs an explicit marker to be trusted.
HIGH_QTY = 20
#: How far an organisation's name may reach back before a place marker.
REACH_BACK = 40

# Units, markers and words of the domain, fixed values.
COUNT_UNITS = ("ตารางเมตร", "ลูกบาศก์เมตร", "กิโลเมตร", "ตร.ม.", "เมตร", "กม.", "ห้องเรียน", "ห้อง", "เครื่อง", "คัน", "ชุด", "ตัว", "หลัง", "แห่ง", "รายการ", "ราย", "คน", "ไร่", "ต้น", "เล่ม", "ระบบ", "งาน", "โครงการ", "ป้าย", "สาย")
SPEC_UNITS = ("บีทียู", "BTU", "ตัน", "ล้อ", "ฟุต", "นิ้ว", "kW", "กิโลวัตต์", "แรงม้า", "ที่นั่ง", "ลิตร", "ซีซี", "GB", "TB", "หน้า/นาที")
SIZE_UNITS = ("ลูกบาศก์เมตร", "ตารางเมตร", "เซนติเมตร", "กิโลเมตร", "ลบ.ม.", "ตร.ม.", "กม.", "ซม.", "ฟุต", "นิ้ว", "ไร่", "เมตร", "ม.")
SIZE_WORDS = ("เส้นผ่าศูนย์กลาง", "หน้ากว้าง", "ปริมาตร", "ความจุ", "ขนาด", "กว้าง", "ยาว", "หนา", "สูง", "ลึก")
EXTENT_WORDS = ("ระยะทางรวม", "ความยาวรวม", "ความยาว", "ระยะทาง", "พื้นที่", "ปริมาณ")
SPEC_WORDS = ("inverter", "ติดผนัง", "ตั้งพื้น", "แขวน")
COUNT_WORD = "จำนวน"
ORG_WORDS = ("โครงการส่งน้ำและบำรุงรักษา", "องค์การบริหารส่วน", "แขวงทางหลวง", "หมวดทางหลวง", "โครงการชลประทาน", "มหาวิทยาลัย", "โรงพยาบาล", "สำนักงาน", "วิทยาลัย", "ที่ว่าการ", "โรงเรียน", "เทศบาล", "บ้านพัก", "สถาบัน", "สถานี", "ศูนย์", "ด่าน", "กอง")
# Words that say nothing at the end of a key, fixed values: those that may be glued to the word before, and those that stand alone.
GLUED_ENDS = ("ความยาวรวม", "ระยะทางรวม", "พื้นที่รับผลประโยชน์", "พื้นที่รับประโยชน์", "ความยาว", "ระยะทาง")
LONE_ENDS = ("พื้นที่", "ปริมาณ", "รวม")
# Words before a place's name, and words that look like one but aren't, fixed values.
PLACE_WORDS = {"จังหวัด": "province", "จว.": "province", "จ.": "province", "อำเภอ": "amphoe", "อ.": "amphoe", "ตำบล": "tambon", "ต.": "tambon", "หมู่ที่": "moo", "หมู่": "moo", "ม.": "moo", "บ้าน": "village", "เทศบาล": "town"}
TOWN_KINDS = ("เมือง", "นคร")
NOT_PLACES = ("อบต.", "อบจ.", "กม.", "ซม.", "บ้านพัก", "บ้านเลขที่", "บ้านเดี่ยว", "บ้านแถว", "บ้านเรือน", "บ้านมั่นคง")
CAPITAL_WORDS = (CAPITAL, "กทม.", "กรุงเทพฯ")
#: How many letters may lie between the word for a size and its number.
SIZE_GAP = 20

PARSED = StructType(
    [StructField(n, StringType()) for n in ("item_key", "province", "amphoe", "tambon", "location_text")]
    + [StructField("item_qty", DoubleType()), StructField("item_unit", StringType()), StructField("spec_tokens", ArrayType(StringType())), StructField("quality_flags", ArrayType(StringType()))]
)


class Token(NamedTuple):
    kind: str  # number, word, latin, blank, bracket, text or sign
    text: str


def any_of(words) -> str:
    """The words as alternatives, longer ones first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True)) + ")"


_WORDS = {*COUNT_UNITS, *SPEC_UNITS, *SIZE_UNITS, *SIZE_WORDS, *EXTENT_WORDS, *ORG_WORDS, *PLACE_WORDS, *NOT_PLACES, *CAPITAL_WORDS, COUNT_WORD}
_UNITS = {*COUNT_UNITS, *SPEC_UNITS, *SIZE_UNITS}
_SCAN = re.compile(
    rf"(?P<number>\d+(?:,\d{{3}})*(?:\.\d+)?)|(?P<word>{any_of(w for w in _WORDS if not w.isascii())})|(?P<latin>[A-Za-z][A-Za-z0-9_-]*)"
    r"|(?P<blank>\s+)|(?P<bracket>[()\[\]])|(?P<text>[฀-๿])|(?P<sign>.)", re.DOTALL
)
_GLUED = rf"\d{any_of(COUNT_UNITS)}"


def tokens_of(name: str) -> list[Token]:
    """The name's tokens, with letters in a row as one. Numbers are written plainly: without commas and, before a unit, without idle zeros."""
    out: list[Token] = []
    for m in _SCAN.finditer(name):
        kind, text = m.lastgroup, m.group()
        if kind == "text" and out and out[-1].kind == "text":
            out[-1] = Token("text", out[-1].text + text)
        elif kind == "word" and text in _UNITS and out and out[-1].kind == "text" and text not in PLACE_WORDS and text not in ORG_WORDS:
            out[-1] = Token("text", out[-1].text + text)  # a unit follows a number; within other letters it is a part of them
        else:
            out.append(Token(kind, text.replace(",", "") if kind == "number" else text))
    for i, t in enumerate(out):
        if t.kind == "number" and unit_at(out, i, _UNITS):
            whole, point, part = t.text.partition(".")
            part = part.rstrip("0")
            out[i] = Token("number", (whole if point else whole.lstrip("0") or "0") + (f".{part}" if part else ""))
    return out


def skip_blank(tokens: list[Token], at: int) -> int:
    return at + 1 if at < len(tokens) and tokens[at].kind == "blank" else at


def unit_at(tokens: list[Token], number: int, units) -> int:
    """The place of the unit that follows a number, or 0."""
    at = skip_blank(tokens, number + 1)
    return at if at < len(tokens) and tokens[at].text in units else 0


def before(tokens: list[Token], at: int) -> int:
    """The place of the last token before ``at`` that isn't blank, or -1."""
    return at - 2 if at > 1 and tokens[at - 1].kind == "blank" else at - 1


def size_word(tokens: list[Token], number: int) -> str | None:
    """The word for a size or extent that a number belongs to: only letters of the local script and blanks lie between."""
    gap = 0
    for t in reversed(tokens[:number]):
        if t.text in SIZE_WORDS or t.text in EXTENT_WORDS:
            return t.text
        gap += len(t.text)
        if gap > SIZE_GAP or t.kind not in ("text", "blank", "word"):
            return None
    return None


class Amount(NamedTuple):
    rule: str  # explicit, extent, plain, size or spec
    number: int
    unit: int


def amounts_of(tokens: list[Token]) -> list[Amount]:
    """What each number with a unit is; the first rule that fits has it."""
    found = []
    for i, t in enumerate(tokens):
        if t.kind != "number":
            continue
        size, at = size_word(tokens, i), before(tokens, i)
        if (u := unit_at(tokens, i, COUNT_UNITS)) and at >= 0 and tokens[at].text == COUNT_WORD:
            found.append(Amount("explicit", i, u))
        elif size and (u := unit_at(tokens, i, SIZE_UNITS)):
            found.append(Amount("extent" if size in EXTENT_WORDS else "size", i, u))
        elif u := unit_at(tokens, i, COUNT_UNITS):
            found.append(Amount("plain", i, u))
        elif u := unit_at(tokens, i, SPEC_UNITS):
            found.append(Amount("spec", i, u))
    return found


def name_after(tokens: list[Token], at: int) -> tuple[str, int]:
    """The name that starts at a token, up to a blank, a sign or the next place, and where it ends."""
    end = at
    while end < len(tokens) and tokens[end].kind in ("text", "word") and (PLACE_WORDS.get(tokens[end].text, "village") == "village") and tokens[end].text not in NOT_PLACES[:2]:
        end += 1
    return "".join(t.text for t in tokens[at:end]), end


def place_at(tokens: list[Token], at: int) -> tuple[str, str | None, int]:
    """Kind, name and end of the place whose word is at ``at``; the end is ``at`` if it isn't one."""
    kind, start = PLACE_WORDS[tokens[at].text], skip_blank(tokens, at + 1)
    if kind == "moo":
        end = at
        while start < len(tokens) and tokens[start].kind == "number":
            end = start + 1
            start = skip_blank(tokens, end + 1) if end < len(tokens) and tokens[end].text == "," else len(tokens)
        return kind, None, end
    name, end = name_after(tokens, at + 1 if kind in ("village", "town") else start)
    if kind == "village" and name and end < len(tokens) and tokens[end].kind == "number" and not unit_at(tokens, end, _UNITS):
        end += 1  # a village's number
    if kind == "province":
        known = max((p for p in (*PROVINCES, *ALIASES) if name.startswith(p)), key=len, default=None)
        return kind, ALIASES.get(known, known), end if known else at
    if kind == "town":
        town = next((name[len(k) :] for k in TOWN_KINDS if name.startswith(k)), "")
        return kind, town if town in PROVINCES else None, end if len(town) > 1 else at
    while kind in ("amphoe", "tambon") and len(name) > 1 and end < len(tokens) and tokens[end].text == ",":  # a list of names
        more, stop = name_after(tokens, skip_blank(tokens, end + 1))
        if len(more) < 2:
            break
        end = stop
    return kind, name, end if len(name) > 1 or (kind == "village" and name) else at


def reach_back(tokens: list[Token], at: int, taken: set[int]) -> int:
    """Where the words glued to a place's word begin: after a blank, a bracket or an amount, if that is near."""
    start, length = at, 0
    while start and tokens[start - 1].kind not in ("blank", "bracket") and start - 1 not in taken:
        start -= 1
        length += len(tokens[start].text)
    glued = "".join(t.text for t in tokens[start:at])
    return start if start and length <= REACH_BACK and not glued.isdigit() else at


def places_of(tokens: list[Token], taken: set[int]) -> tuple[set[int], dict[str, str | None], bool]:
    """Claimed tokens, names by kind, and whether an organisation's name is glued to other words."""
    claimed, names = set(), dict.fromkeys(("province", "amphoe", "tambon"))
    town, marks, at = None, [], 0
    while at < len(tokens):
        if tokens[at].kind != "word" or tokens[at].text not in PLACE_WORDS:
            at += 1
            continue
        marks.append(at)
        kind, name, end = place_at(tokens, at)
        if end > at:
            claimed.update(range(reach_back(tokens, at, taken), end))
            if kind == "town":
                town = town or name
            elif kind in names:
                names[kind] = re.match("[^,]*", name).group()
        at = max(end, at + 1)
    capital = [i for i, t in enumerate(tokens) if t.text in CAPITAL_WORDS and i not in claimed]
    if capital and not names["province"]:
        names["province"] = CAPITAL
        for i in capital:
            claimed.update(range(reach_back(tokens, i, taken), i + 1))
    names["province"] = names["province"] or town
    last = max([i for i in marks if PLACE_WORDS[tokens[i].text] != "village" and tokens[i].text != "ม."] + [i for i, t in enumerate(tokens) if t.text in CAPITAL_WORDS], default=-1)
    glued = False
    for i, t in enumerate(tokens[: last + 1]):
        if t.kind == "word" and t.text in ORG_WORDS:
            if i and (tokens[i - 1].kind in ("blank", "bracket") or i - 1 in taken):
                return claimed | set(range(i, len(tokens))), names, False
            glued = True
    return claimed, names, glued


def joined(tokens: list[Token], claimed: set[int], want: bool) -> str:
    """The text of the tokens that are claimed, or of those that aren't; a blank stands for what is left out."""
    out = []
    for i, t in enumerate(tokens):
        out.append(t.text if (i in claimed) == want else " ")
    return "".join(out)


def _thai_letter(c: str) -> bool:
    return "ก" <= c <= "๎"


def key_of(text: str) -> str:
    """The grouping key of what is left of a name: plain letters and digits, decimals, plus signs."""
    text, out = text.lower(), []
    for c, last, following in zip(text, " " + text, text[1:] + " ", strict=False):
        decimal = c == "." and last.isdecimal() and following.isdecimal()
        if not (decimal or c == "+" or "฀" <= c <= "๿" or (c.isascii() and c.isalnum())):
            out.append(" ")
            continue
        apart = (c.isdecimal() and _thai_letter(last)) or (_thai_letter(c) and last.isdecimal())
        out.append(" " + c if apart else c)
    first, *rest = "".join(out).split(COUNT_WORD)
    key = " ".join((first + "".join((COUNT_WORD if part.strip()[:1].isdecimal() else " ") + part for part in rest)).split())
    while True:
        end = next((w for w in GLUED_ENDS if key.endswith(w)), None) or next((w for w in LONE_ENDS if key.endswith(" " + w)), None)
        if not end or not (shorter := key[: -len(end)].strip()):
            return key
        key = shorter


def parse_name(name: str) -> dict:
    """What a cleaned name says. A name of nothing but places keeps its whole text as the key."""
    tokens = tokens_of(name)
    amounts = amounts_of(tokens)
    counts = [a for a in amounts if a.rule in ("explicit", "extent", "plain")]
    chosen = next((a for a in reversed(counts) if a.rule == "explicit"), counts[-1] if counts else None)
    span = lambda a: range(a.number, a.unit + 1)
    claimed, names, glued = places_of(tokens, {i for a in amounts for i in span(a)})
    flags = [flag for flag, holds in ((QTY_MEASURE, chosen and chosen.rule == "extent"), (QTY_LOW_CONF, len(counts) > 1), (ORG_UNCERTAIN, glued)) if holds]
    said = [f"{tokens[a.number].text} {tokens[a.unit].text}" for rule in ("size", "spec") for a in amounts if a.rule == rule]
    key = key_of(joined(tokens, claimed | {i for a in counts for i in span(a)}, False))
    if not key and name.strip():
        key = key_of("".join(t.text for t in tokens))
        key = parse_name(key)["item_key"] if key != name else key  # what is left of the words may be read anew
    return {
        "item_key": key, **names, "location_text": " ".join(joined(tokens, claimed, True).split()) or None, "item_qty": float(tokens[chosen.number].text) if chosen else None, "item_unit": tokens[chosen.unit].text if chosen else None,
        "spec_tokens": said + [w for w in SPEC_WORDS if w in name.lower()], "quality_flags": flags,
    }


@pandas_udf(PARSED)
def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for names in batches:
        yield pd.DataFrame([parse_name(n) if n else dict.fromkeys(PARSED.fieldNames()) for n in names], columns=PARSED.fieldNames())


def parse_items(lines: DataFrame, name: str = "item_name_raw") -> DataFrame:
    """The lines with ``item`` (the parsed parts), each distinct name parsed once."""
    distinct = lines.select(F.col(name).alias("__raw")).filter(F.col("__raw").isNotNull()).distinct()
    read = distinct.withColumn("item_name", clean(F.col("__raw"))).withColumn("item", parsed("item_name"))
    return lines.drop("item_name", "item").join(read, F.col(name) == F.col("__raw"), "left").drop("__raw")


def explicit_quantity(name):
    """Whether a name says outright that a number is a count."""
    return name.contains(COUNT_WORD) | name.rlike(_GLUED)


def computed_price(flags, qty, amount, given, name):
    """A given unit price, or amount / quantity where the quantity can be trusted; rounded half to even."""
    trusted = ~F.arrays_overlap(flags, F.array(F.lit(QTY_MEASURE), F.lit(QTY_LOW_CONF), F.lit(CORRUPT)))
    ok = (qty > 0) & amount.isNotNull() & trusted & ((qty < HIGH_QTY) | explicit_quantity(name))
    return F.coalesce(given, F.when(ok, round_half_even(amount / qty).cast("long")))
