"""Format-preserving pseudonyms for validated numbers, dates and mail names. DataFrame functions only.

A keyed Feistel network permutes each value within its own format, so a pseudonym is as
valid as the value was (checksum, octets, calendar), equal values get equal pseudonyms in
every document, and the holder of the key can reverse them. Kinds and their domains:

* card: 13 to 19 digits with a right Luhn digit, single spaces or hyphens between; the digits
  before the last are permuted and the check digit is computed anew. A run of 13 or more digits
  is one of its own, and neither it nor a social number, a date or a phone with hyphens is taken as a
  card's part beyond a space, whatever the digits: pseudonyms are found as the values were
* address: four octets up to 255
* phone: a ten-digit North American number, area and exchange from 200 on, a country code kept
* social: ddd-dd-dddd without the areas, groups and serials that are never given
* date (also before a T and a time): yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy (as dd/mm/yyyy if only that is a date), 1800 to 2199
* mail: the name before the @ keeps its length, case and digits' places; the domain stays

What looks like a value but fails its check stays as it is. Values are found from left to
right; of two at one place, the earlier kind above wins. A null text gives a null text
and no values; all other columns and repeated rows pass through unchanged.

Everything is a column of its own row: no shuffle, no state, and any executor may be lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# The formats.
_SOLID = r"[0-9]{13,19}(?![0-9A-Za-z]|-[0-9])"
_HYPHENED = r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-SU-Za-z]|-[0-9])"
_APART = rf"(?!{_SOLID}|{_HYPHENED})"
_FORMATS = {
    "card": rf"(?<![0-9A-Za-z.+-])(?:{_SOLID}|{_APART}[0-9](?:(?:-| {_APART})?[0-9]){{12,18}}(?![0-9A-Za-z]))",
    "address": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "social": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]{2}:)|[-./][0-9])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
}
_ANY = "|".join(_FORMATS.values())
# 400 Gregorian years repeat after 146,097 = 189 * 773 days.
_FIRST_DAY = "1800-01-01"


def _number(hash_text: Column) -> Column:
    return F.conv(F.substring(hash_text, 1, 15), 16, 10).cast("bigint")


def permuted(left: Column, right: Column, sizes: tuple[Column, Column], key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of the pairs below ``sizes``, as a struct of ``l`` and ``r``.

    Each round adds to one half a keyed hash of the other, modulo the half's size.
    """
    a, b = sizes

    def turn(halves: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        source = F.when(even, halves["r"]).otherwise(halves["l"])
        mixed = _number(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), a, b, i, source), 256))
        mixed = -mixed if back else mixed
        return F.struct(
            F.when(even, F.pmod(halves["l"] + F.pmod(mixed, a), a)).otherwise(halves["l"]).alias("l"),
            F.when(even, halves["r"]).otherwise(F.pmod(halves["r"] + F.pmod(mixed, b), b)).alias("r"),
        )

    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    return F.aggregate(rounds, F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``; all else stays in place."""
    step = lambda acc, c: F.when(
        c.between("0", "9"),
        F.struct(F.concat(acc["out"], F.substring(digits, acc["at"] + 1, F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")),
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)["out"]


def _padded(number: Column, width: int | Column) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    text = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), width - F.length(text)), text)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that are to be followed by a check digit."""
    n = F.length(digits)

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), weighed), F.lit(0), lambda s, x: s + x)


def _check_digit(digits: Column) -> Column:
    return F.pmod(-luhn_sum(digits), F.lit(10)).cast("string")


def _card(value: Column, key: str, back: bool) -> Column:
    digits = _digits(value)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    n_left = F.floor(F.length(body) / 2).cast("int")
    n_right = F.length(body) - n_left
    sizes = tuple(F.pow(F.lit(10), n).cast("bigint") for n in (n_left, n_right))
    halves = permuted(F.substring(body, F.lit(1), n_left), F.substring(body, n_left + 1, n_right), sizes, key, "card", back)
    fresh = _let(halves, lambda h: F.concat(_padded(h["l"], n_left), _padded(h["r"], n_right)))
    filled = _let(_let(fresh, lambda f: F.concat(f, _check_digit(f))), lambda f: _refill(value, f))
    return F.when(_check_digit(body) == F.substring(digits, F.length(digits), F.lit(1)), filled)


def _address(value: Column, key: str, back: bool) -> Column:
    octet = lambda i: F.split(value, r"\.")[i].cast("int")
    high, low = octet(0) * 256 + octet(1), octet(2) * 256 + octet(3)
    halves = permuted(high, low, (F.lit(65536), F.lit(65536)), key, "address", back)
    octets = lambda x: (F.floor(x / 256), F.pmod(x, F.lit(256)))
    fresh = _let(halves, lambda h: F.concat_ws(".", *octets(h["l"]), *octets(h["r"])))
    return F.when(F.greatest(*[octet(i) for i in range(4)]) < 256, fresh)


def _phone(value: Column, key: str, back: bool) -> Column:
    every = _digits(value)
    digits = F.substring(every, F.length(every) - 9, F.lit(10))
    area, exchange, line = (F.substring(digits, i, n).cast("int") for i, n in ((1, 3), (4, 3), (7, 4)))
    halves = permuted(area - 200, (exchange - 200) * 10000 + line, (F.lit(800), F.lit(8_000_000)), key, "phone", back)
    prefix = F.substring(every, F.lit(1), F.length(every) - 10)
    fresh = _let(halves, lambda h: F.concat(prefix, _padded(h["l"] + 200, 3), _padded(h["r"] + 2_000_000, 7)))
    return F.when((area > 199) & (exchange > 199), _let(fresh, lambda f: _refill(value, f)))


def _social(value: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    # Areas 1 to 899 without 666 are 898 numbers in a row.
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    halves = permuted(place, (group - 1) * 9999 + serial - 1, (F.lit(898), F.lit(99 * 9999)), key, "social", back)
    parts = lambda h: (
        _padded(F.when(h["l"] > 664, h["l"] + 2).otherwise(h["l"] + 1), 3),
        _padded(F.floor(h["r"] / 9999) + 1, 2),
        _padded(F.pmod(h["r"], F.lit(9999)) + 1, 4),
    )
    given = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(given, _let(halves, lambda h: F.concat_ws("-", *parts(h))))


def _date(value: Column, key: str, back: bool) -> Column:
    read = lambda form: F.to_date(F.try_to_timestamp(value, F.lit(form)))
    first = F.lit(_FIRST_DAY).cast("date")

    def moved(form: str) -> Callable[[Column], Column]:
        def of(day: Column) -> Column:
            halves = permuted(F.floor(day / 773), F.pmod(day, F.lit(773)), (F.lit(189), F.lit(773)), key, "date", back)
            fresh = _let(halves, lambda h: F.date_format(F.date_add(first, (h["l"] * 773 + h["r"]).cast("int")), form))
            return F.when(day.between(0, 146_096), fresh)

        return of

    forms = (("yyyy-MM-dd", r"^[0-9]{4}-"), ("dd.MM.yyyy", r"^[0-9]{2}\."), ("MM/dd/yyyy", r"^[0-9]{2}/"), ("dd/MM/yyyy", r"^[0-9]{2}/"))
    return F.coalesce(*[F.when(value.rlike(looks), _let(F.datediff(read(form), first), moved(form))) for form, looks in forms])


def _mail(value: Column, key: str, back: bool) -> Column:
    name = F.substring_index(value, "@", 1)
    n_left = F.floor(F.length(name) / 2).cast("int")

    def moved(half: Column, other: Column, i: Column) -> Column:
        secret = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.length(name), i, other), 512)
        return _let(secret, lambda stream: F.array_join(F.transform(F.split(half, ""), lambda c, at: one(stream, c, at)), ""))

    def one(stream: Column, c: Column, at: Column) -> Column:
        by = F.conv(F.substring(stream, F.pmod(at * 3, F.lit(125)) + 1, F.lit(3)), 16, 10).cast("int")
        by = -by if back else by
        turned = lambda low, n: F.char(F.pmod(F.ascii(c) - ord(low) + by, F.lit(n)) + ord(low))
        return (
            F.when(c.between("0", "9"), turned("0", 10)).when(c.between("a", "z"), turned("a", 26))
            .when(c.between("A", "Z"), turned("A", 26)).otherwise(c)
        )

    def turn(halves: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, moved(halves["l"], halves["r"], i)).otherwise(halves["l"]).alias("l"),
            F.when(even, halves["r"]).otherwise(moved(halves["r"], halves["l"], i)).alias("r"),
        )

    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    start = F.struct(F.substring(name, F.lit(1), n_left).alias("l"), F.substring(name, n_left + 1, F.length(name)).alias("r"))
    halves = F.aggregate(rounds, start, turn)
    rest = F.substring(value, F.length(name) + 1, F.length(value))
    return _let(halves, lambda h: F.concat(h["l"], h["r"], rest))


_MAKERS = {"card": _card, "address": _address, "phone": _phone, "social": _social, "date": _date, "mail": _mail}


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """A struct of ``kind`` and ``fresh`` for one found value; ``kind`` is null if it fails its check."""
    def attempt(kind: str, make: Callable) -> Column:
        made = _let(make(value, key, back), lambda m: F.when(m.isNotNull(), F.struct(F.lit(kind).alias("kind"), m.alias("fresh"))))
        return F.when(value.rlike(f"^(?:{_FORMATS[kind]})$"), made)

    unchanged = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("fresh"))
    return F.coalesce(*[attempt(kind, make) for kind, make in _MAKERS.items()], unchanged)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with ``text`` pseudonymized and a column ``pii`` of the values' kinds in order.

    ``back=True`` with the same key restores the texts. An own column named ``pii`` is replaced.
    """
    source = F.col(f"`{text}`")
    # Short columns of their own, so that the formats are matched once for the values and once for the rest.
    found = docs.withColumn("pii", F.regexp_extract_all(source, F.lit(_ANY), F.lit(0)))
    made = found.withColumn("pii", F.transform("pii", lambda v: pseudonym(v, key, back)))
    pieces = F.split(source, _ANY, -1)
    fresh = F.concat(F.transform("pii", lambda p: p["fresh"]), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, fresh, lambda a, b: F.concat(a, b)), "")
    kinds = F.filter(F.transform("pii", lambda p: p["kind"]), lambda k: k.isNotNull())
    return made.withColumn(text, F.when(F.size("pii") > 0, joined).otherwise(source)).withColumn(
        "pii", F.coalesce(kinds, F.array().cast("array<string>"))
    )
