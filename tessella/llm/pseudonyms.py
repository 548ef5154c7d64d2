"""Format-preserving pseudonyms for personal numbers, dates and addresses, in SQL expressions only.

Every found value is replaced by a keyed permutation of the values of its own format, so equal
values stay equal across documents and the text keeps its form:

* payment card numbers (13 to 19 digits): Feistel rounds over the digits before the last; the last
  one is the check digit. An unbroken number that passes the check gets a number that passes it, and
  one that fails gets one that fails by as much. Groups with single spaces or hyphens between them
  (four by four with a rest, 4-6-5, 4-6-4 and 4-4-5, not starting with a year) keep the separators and
  must pass the check, with or without the last group of three digits or fewer;
* telephone numbers with a country code, 8 to 15 digits with single spaces, dots, hyphens, slashes and
  brackets between them or none: all digits after the country code;
* IPv4 addresses, each part at most 255: a Feistel permutation of the 32 bits;
* dates from 1900 to 2099 that exist, year first or last, with hyphens, dots or slashes: an unbalanced
  Feistel permutation of the 73,049 = 17 x 4,297 days, so the result exists too. With the year last the
  day is read first; if that is no date, the month is read first, and so it is in the result. Spellings
  of one day get spellings of one day;
* e-mail addresses: the local part, letter for letter and digit for digit; the domain stays.

Rounds draw on SHA-256 of the key, the format and the other half. Values that do not validate
(a 300 in an address, a 31st of February) are left alone.

Defined cases: a null text stays null, with nothing found; an empty table gives an empty table; ids may be
null or repeated, and rows with equal ids or texts are judged one by one; other columns are ignored, whatever
their names. Texts of any length are read whole: no pattern repeats a group without a bound. The text between
values is not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Every repeat of a group is bounded: the matcher recurses once for each. A domain holds at most 32 labels here.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9][A-Za-z0-9\-]{0,62}(?:\.[A-Za-z0-9\-]{1,63}){0,30}\.[A-Za-z]{2,24}"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
_JOIN = r"(?:[ .\-/]?\(|\)[ .\-/]?|[ .\-/])"
#: A number of country code 1 has ten more digits; others go on until another value starts.
PHONE = rf"\+1{_JOIN}?\d{{3}}{_JOIN}?\d{{3}}{_JOIN}?\d{{4}}(?!\d)|\+[1-9](?:(?! (?:{IPV4}|{DATE}|\d{{13}})){_JOIN}?\d){{7,14}}(?!\d)"
DATES = DATE + "".join(
    rf"|(?<![\d.\-/])(?:\d{{4}}{c}\d{{1,2}}{c}\d{{1,2}}|\d{{1,2}}{c}\d{{1,2}}{c}\d{{4}})(?![\d\-/]|\.\d)" for c in (r"\.", "/", "-")
)
CARD = r"(?<![\d.\-])\d{13,19}(?![\d])" + "".join(
    rf"|(?<![\d.\-])(?!(?:19|20)\d\d)\d{{4}}{c}(?:\d{{4}}{c}\d{{4}}{c}\d{{4}}(?:{c}\d{{1,3}})?|\d{{4}}{c}\d{{4}}{c}\d{{1,3}}|\d{{6}}{c}\d{{4,5}}|\d{{4}}{c}\d{{5}})(?!\d)" for c in " -"
)
VALUE = "|".join((EMAIL, PHONE, IPV4, DATES, CARD))
YEARS = ("1900-01-01", 17, 4297)
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: A month-first result needs a day above 12, which three of five days have; so many tries are made.
TRIES = 48


def _draw(key: str, kind: str, number, *parts: Column) -> Column:
    """A number below 2**52 that depends on the key, the format, the round and the other half."""
    text = F.concat_ws("|", F.lit(f"{key}|{kind}"), number.cast("string"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def _rounds(start: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_string(value: Column, key: str, kind: str) -> Column:
    """Keyed permutation of strings: each letter stays a letter of its case, each digit a digit."""
    size = F.length(value)
    half = F.ceil(size / 2).cast("int")

    def shifted(part: Column, other: Column, number: Column) -> Column:
        def one(char: Column, at: Column) -> Column:
            code, draw = F.ascii(char), _draw(key, kind, number, at, other)

            def within(first: int, count: int) -> Column:
                return F.char((F.pmod(code - first + draw, F.lit(count)) + first).cast("long"))

            return (F.when(code.between(48, 57), within(48, 10)).when(code.between(65, 90), within(65, 26)).when(code.between(97, 122), within(97, 26)).otherwise(char))

        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), one), "")

    def step(acc: Column, number: Column) -> Column:
        even = number % 2 == 0
        changed = shifted(F.when(even, acc["l"]).otherwise(acc["r"]), F.when(even, acc["r"]).otherwise(acc["l"]), number)
        return F.struct(F.when(even, changed).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(changed).alias("r"))

    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, size).alias("r"))
    out = _rounds(start, step)
    return F.concat(out["l"], out["r"])


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """Keyed permutation of the pairs (left < sizes[0], right < sizes[1])."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc: Column, number: Column) -> Column:
        even = number % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + _draw(key, kind, number, acc["r"]), F.lit(sizes[0]))).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + _draw(key, kind, number, acc["l"]), F.lit(sizes[1]))).alias("r"),
        )

    return _rounds(start, step)


def check_sum(digits: Column) -> Column:
    """Sum of a payload's digits as card numbers count them, before its check digit."""
    parts = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, at: F.struct((c.cast("int") * F.when(at % 2 == 0, 2).otherwise(1)).alias("d")))
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.when(p["d"] > 9, p["d"] - 9).otherwise(p["d"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c, at: F.when(c.between("0", "9"), F.substring(
        digits, F.length(digits_of(F.substring(value, F.lit(1), at + 1))), F.lit(1))).otherwise(c)), "")


def card_of(digits: Column, key: str) -> Column:
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    hidden = permute_string(payload, key, "card")
    return F.concat(hidden, F.pmod(card_off(digits) - check_sum(hidden), F.lit(10)).cast("string"))


def card_off(digits: Column) -> Column:
    """What the last digit is off by: zero for numbers that pass the check."""
    return F.pmod(F.substring(digits, -1, 1).cast("int") + check_sum(F.substring(digits, F.lit(1), F.length(digits) - 1)), F.lit(10))


def grouped_card_of(value: Column, key: str) -> Column:
    """The card number in groups: all of them, or without a last group of three digits or fewer that is not part of it."""
    shorter = F.regexp_replace(value, r"[ \-]\d{1,3}$", "")
    whole, less = digits_of(value), digits_of(shorter)
    return F.when(card_off(whole) == 0, refill(value, card_of(whole, key))).when(
        (F.length(less) >= 13) & (F.length(less) < F.length(whole)) & (card_off(less) == 0),
        F.concat(refill(shorter, card_of(less, key)), F.substring(value, F.length(shorter) + 1, F.length(value))),
    ).otherwise(value)


def date_of(value: Column, key: str) -> Column:
    """The moved date in the layout of ``value``, or the value itself if there is no such date."""
    first, small, large = YEARS
    start = F.lit(first).cast("date")
    mark = F.regexp_extract(value, r"\D", 0)
    part = F.split(value, r"\D")
    year_first = F.length(part[0]) == 4
    year = F.when(year_first, part[0]).otherwise(part[2])
    padded = F.length(part[1]) + F.length(F.when(year_first, part[2]).otherwise(part[0])) == 4

    def day_number(month: Column, day: Column) -> Column:
        number = F.datediff(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))), start)
        return F.when(number.between(0, small * large - 1), number)

    def moved(number: Column) -> Column:
        pair = permute_pair(F.floor(number / large), F.pmod(number, F.lit(large)), (small, large), key, "date")
        return (pair["l"] * large + pair["r"]).cast("int")

    def date(number: Column) -> Column:
        return F.date_add(start, number)

    def written(number: Column, order: str) -> Column:
        def text(name: str) -> Column:
            if name == "y":
                return F.year(date(number)).cast("string")
            plain = (F.month(date(number)) if name == "m" else F.dayofmonth(date(number))).cast("string")
            return F.when(padded, F.lpad(plain, 2, "0")).otherwise(plain)
        return F.concat(text(order[0]), mark, text(order[1]), mark, text(order[2]))

    ymd, dmy, mdy = day_number(part[1], part[2]), day_number(part[1], part[0]), day_number(part[0], part[1])
    # With the day above 12, the result cannot be taken for one with the day first.
    again = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), moved(mdy), lambda acc, _: F.when(F.dayofmonth(date(acc)) > 12, acc).otherwise(moved(acc)))
    return F.when(year_first, F.coalesce(written(moved(ymd), "ymd"), value)).when(dmy.isNotNull(), written(moved(dmy), "dmy")).otherwise(
        F.coalesce(F.when(mdy.isNotNull(), written(again, "mdy")), value))


def pseudonym_of(value: Column, key: str) -> Column:
    """The pseudonym of one found value, or the value itself if it does not validate."""
    code = F.regexp_extract(value, COUNTRY, 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    phone = F.concat(code, refill(rest, permute_string(digits_of(rest), key, "phone")))

    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    pair = permute_pair(F.get(octets, F.lit(0)) * 256 + F.get(octets, F.lit(1)), F.get(octets, F.lit(2)) * 256 + F.get(octets, F.lit(3)), (65536, 65536), key, "ip")
    address = F.concat_ws(".", *[F.floor(pair[h] / 256).cast("string") if top else (pair[h] % 256).cast("string") for h in "lr" for top in (True, False)])
    valid_address = F.forall(octets, lambda o: o <= 255)

    name = F.substring_index(value, "@", 1)
    email = F.concat(permute_string(name, key, "email"), F.substring(value, F.length(name) + 1, F.length(value)))
    return (
        F.when(F.contains(value, F.lit("@")), email).when(F.startswith(value, F.lit("+")), phone)
        .when(value.rlike(r"^\d+$"), card_of(value, key)).when(F.length(digits_of(value)) >= 13, grouped_card_of(value, key))
        .when(value.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.when(valid_address, address).otherwise(value)).otherwise(date_of(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``text`` with pseudonyms, ``n_found`` (values), ``n_replaced``."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # Most texts have no digit and no address: they are passed on as they are.
    found = F.when(F.col("text").rlike(r"\d{3}|@|\d\.|\+\d"), F.regexp_extract_all("text", F.lit(VALUE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", "text", found.alias("found"))
    rows = rows.select("id", "text", "found", F.transform("found", lambda v: pseudonym_of(v, key)).alias("made"))
    parts = F.zip_with(F.split("text", VALUE, -1), "made", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.aggregate(F.zip_with("found", "made", lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda acc, c: acc + c)
    return rows.select(
        F.col("id").alias(id_col), F.when(F.size("found") > 0, F.array_join(parts, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNotNull(), F.size("found")).otherwise(0).cast("long").alias("n_found"),
        F.coalesce(changed, F.lit(0)).cast("long").alias("n_replaced"),
    )
