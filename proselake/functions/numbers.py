"""Numbers as values: a grammar that finds them in a text, and what they are worth, so that equal numbers are equal however they are written.

An atom is a struct of ``kind`` (number, ordinal, ``p<`` and its like, or power: a base other than ten that is raised to the exponent), ``sign``, ``digits`` (an exact decimal without needless zeros), ``exponent`` (a power of ten), ``unit``
and what was written. Digits and exponent are normal: the digits end in no zero, and the exponent takes what they lost; zero has exponent 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, units of counting and larger units of Chinese numerals, and digits as superscripts.
ZH_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
ZH_TENS = {"十": 10, "百": 100, "千": 1000}
ZH_LARGE = {"万": 10_000, "亿": 100_000_000}
RAISED, FLAT = "⁺⁻⁰¹²³⁴⁵⁶⁷⁸⁹", "+-0123456789"
ZH_UNIT = (
    "人|份|例|次|项|组|个|年|月|日|小时|分钟|秒|天|周|万元|亿元|元|平方千米|平方厘米|平方毫米|平方米|立方厘米|立方毫米|立方米|千米|厘米|毫米|米|毫升|升|千克|克|毫克|微克|毫摩尔|微摩尔|摩尔|摄氏度|华氏度"
)

_PLAIN = r"[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?|[.][0-9]+"
_POWER = r"(?:\^[+\-−]?[0-9]+|[⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)"
_UNIT = r"[A-Za-zμµΩ%‰℃℉][A-Za-z0-9μµΩ·⋅*/^⁻¹²³]{0,23}"
_ZH = "〇零一二两三四五六七八九十百千万亿"
#: What stands before a number, by which it is told from a part of a word or of another number; then sign, digits, power and unit.
BODY = (
    rf"(?:([pP])\s*([<>=])\s*)?([+\-−]?)(?:({_PLAIN})(?:\s*[×xX·⋅]\s*10({_POWER})|[eE]([+\-−]?[0-9]+)|({_POWER}))?(?:(st|nd|rd|th)|[ ]?({_UNIT}|{ZH_UNIT}))?|(第?)([{_ZH}]+)({ZH_UNIT})?)"
)
BEFORE = "[^A-Za-z0-9._]"
ATOM = f"(^|{BEFORE}){BODY}"
KINDS = "struct<kind:string,sign:string,digits:string,exponent:int,unit:string,written:string>"


def chinese_value(numeral: Column) -> Column:
    """What a Chinese numeral counts, as decimal: larger units multiply what stands before them, digits side by side are digits."""
    chars = F.split(numeral, "")
    table = lambda d, c: F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).cast("decimal(38,0)").alias("v")) for k, v in d.items()]), lambda x: x["k"] == c), 0)["v"]
    zero, one = F.lit(0).cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")
    state = lambda total, part, digit, seen: F.struct(total.cast("decimal(38,0)").alias("total"), part.cast("decimal(38,0)").alias("part"), digit.cast("decimal(38,0)").alias("digit"), seen.alias("seen"))

    def step(s: Column, c: Column) -> Column:
        d, t, big = table(ZH_DIGITS, c), table(ZH_TENS, c), table(ZH_LARGE, c)
        return (
            F.when(d.isNotNull(), state(s["total"], s["part"], s["digit"] * 10 + d, F.lit(True)))
            .when(t.isNotNull(), state(s["total"], s["part"] + F.when(s["seen"], s["digit"]).otherwise(one) * t, zero, F.lit(False)))
            .when(big.isNotNull(), state((s["total"] + F.greatest(s["part"] + s["digit"], F.when((s["total"] == 0) & (s["part"] + s["digit"] == 0), one).otherwise(zero))) * F.when((s["part"] + s["digit"] == 0) | (s["total"] == 0) | (big > s["total"]), big).otherwise(one) + F.when((s["part"] + s["digit"] == 0) | (s["total"] == 0) | (big > s["total"]), zero).otherwise((s["part"] + s["digit"]) * (big - 1)), zero, zero, F.lit(False)))
            .otherwise(s)
        )

    return F.aggregate(F.filter(chars, lambda c: c != ""), state(zero, zero, zero, F.lit(False)), step, lambda s: s["total"] + s["part"] + s["digit"])


def _normal(digits: Column, exponent: Column) -> tuple[Column, Column]:
    """The digits without point and zeros at either end, and the exponent that belongs to them."""
    bare = F.regexp_replace(digits, ",", "")
    places = F.length(F.regexp_extract(bare, r"[.]([0-9]*)$", 1))
    whole = F.regexp_replace(F.regexp_replace(bare, r"[.]", ""), r"^0+(?=[0-9])", "")
    short = F.regexp_replace(whole, r"(?<=[0-9])0+$", "")
    none = whole.rlike("^0+$")
    return F.when(none, F.lit("0")).otherwise(short), F.when(none, F.lit(0)).otherwise(exponent - places + F.length(whole) - F.length(short)).cast("int")


def atoms(text: Column) -> Column:
    """Array of a text's numbers in order; null texts have none."""
    names = ["p", "sign_of_p", "sign", "digits", "times", "e", "power", "th", "unit", "nth", "zh", "zh_unit"]
    whole = F.transform(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(f"{BEFORE}(?:{BODY})"), F.lit(0)), lambda m: F.substr(m, F.lit(2)))
    parts = lambda m: F.struct(m.alias("all"), *[F.regexp_extract(m, f"^{BODY}", i + 1).alias(n) for i, n in enumerate(names)])
    rows = F.transform(whole, parts)  # a text is searched once, its numbers are taken apart by themselves

    def one(x: Column) -> Column:
        power = F.regexp_replace(F.translate(F.concat(x["times"], x["e"], x["power"]), RAISED, FLAT), "−", "-")
        exponent = F.when(power == "", F.lit(0)).otherwise(F.coalesce(F.regexp_replace(power, r"^\^?[+]?", "").try_cast("int"), F.lit(0)))
        han = x["zh"] != ""
        ten = (x["power"] != "") & (x["digits"] == "10")
        digits, shift = _normal(F.when(han, chinese_value(x["zh"]).cast("string")).when(ten, "1").otherwise(x["digits"]), F.when(han, F.lit(0)).otherwise(exponent))
        kind = F.when((x["power"] != "") & ~ten, "power").when(x["p"] != "", F.concat(F.lit("p"), x["sign_of_p"])).when((x["th"] != "") | (x["nth"] != ""), "ordinal").otherwise("number")
        sign = F.when(x["sign"].isin("-", "−") & (digits != "0"), "-").otherwise("")
        unit = F.concat(x["unit"], x["zh_unit"])
        return F.struct(kind.alias("kind"), sign.alias("sign"), digits.alias("digits"), shift.alias("exponent"), unit.alias("unit"), x["all"].alias("written")).cast(KINDS)

    single = lambda x: (x["zh"] == "") | (F.length(x["zh"]) > 1) | (x["nth"] != "") | (x["zh_unit"] != "")  # noqa: E731  one character alone is a word
    return F.coalesce(F.transform(F.filter(rows, single), one), F.array().cast(f"array<{KINDS}>"))


def value(atom: Column) -> Column:
    """An atom as one comparable text, without how it was written."""
    return F.concat(atom["kind"], F.lit(":"), atom["sign"], atom["digits"], F.lit("e"), atom["exponent"], F.lit(" "), atom["unit"])


def same_numbers(a: Column, b: Column) -> Column:
    """Whether two texts hold the same numbers, repeats counted, in any order."""
    bag = lambda t: F.array_sort(F.transform(atoms(t), value))
    return bag(a) == bag(b)
