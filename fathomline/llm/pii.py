"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A candidate is found by shape, then validated (card check digits, address octets, calendar dates,
social security areas, account check digits).  What holds is permuted under a key by a Feistel
network over the numbers of its own format and written back in the same spelling: a card becomes
another valid card with the same separators, a date another date.  A permutation keeps equal values
equal and different values different across all documents, and ``key`` and round function alone
decide it.  Dates stay within their 400-year cycle of the calendar.  Mail addresses have no number to permute and become keyed addresses of a reserved
domain.  Candidates that don't validate are left as they are.

Texts are cut at the candidates once, and the pieces joined again; a text without a digit or an at
sign isn't searched.  Nothing is shuffled and no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted

#: The shapes of candidates (Java regular expressions), tried in this order at each place.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9]|[0-9]\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5})(?![0-9])",
    "card": r"(?<![0-9A-Za-z]|[0-9]\.)(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|\.[0-9])",
}
PATTERN = "|".join(SHAPES.values())
ROUNDS = 8
#: Days of a whole 400-year cycle of the calendar, as the product of the two halves' sizes; cycle 0 begins on 1800-01-01.
DATE_HALVES = (189, 773)
CYCLE_DAYS = 189 * 773
FIRST_DAY = "1800-01-01"
#: The years 1 to 199 and 9800 to 9999 are parts of cycles: first day, cycle number and halves of each.
CUT_CYCLES = (("0001-01-01", -5, (13, 5591)), ("9800-01-01", 20, (184, 397)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def feistel(left: Column, right: Column, sizes: tuple[Column, Column], key: str, tweak: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs below ``sizes``, halves in turn added a keyed digest of the other."""

    def mixed(i: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    def one(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(pair["l"] + mixed(i, pair["r"]), sizes[0])).otherwise(pair["l"]).alias("l"),
            F.when(even, pair["r"]).otherwise(F.pmod(pair["r"] + mixed(i, pair["l"]), sizes[1])).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one)


def _joined_halves(pair: Column, a: Column, b: Column) -> Column:
    """Digits of both halves with their leading zeros."""
    return F.concat(F.lpad(pair["l"].cast("string"), a, "0"), F.lpad(pair["r"].cast("string"), b, "0"))


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Digits of the same number, 2 to 36 of them."""
    n = F.length(digits)
    a, b = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    pair = feistel(F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, b), (power(a), power(b)), key, tweak)
    return _joined_halves(pair, a, b)


def refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced one after the other."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def one(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, F.substring(digits, state["used"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            F.when(is_digit, state["used"] + 1).otherwise(state["used"]).alias("used"),
        )

    return F.aggregate(_chars(shape), start, one, lambda s: s["out"])


def _luhn_sum(digits: Column) -> Column:
    """Sum of digits, every second from the right doubled (nines cast out)."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda s, d: s + d)


def _mod97(account: Column) -> Column:
    """An account number's remainder: first four characters moved behind, letters as 10 to 35."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(moved), F.lit(0), lambda r, c: (r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _date_of(s: Column) -> Column:
    """The calendar day of any of the spellings; month before day with slashes where that is a date, else day before month."""
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy")]
    return F.coalesce(*[t.cast("date") for t in tries])


def _permuted_day(day: Column, key: str) -> Column:
    """Another day of the same 400-year cycle, or of the part of one that four-digit years cut off."""
    since = lambda first: F.datediff(day, F.lit(first).cast("date"))
    cycle = F.floor(since(FIRST_DAY) / CYCLE_DAYS)
    chosen = lambda whole, cut: reduce(lambda c, k: c.when(cycle == CUT_CYCLES[k][1], cut(k)), range(len(CUT_CYCLES)), F).otherwise(whole)
    first = chosen(F.date_add(F.lit(FIRST_DAY).cast("date"), (cycle * CYCLE_DAYS).cast("int")), lambda k: F.lit(CUT_CYCLES[k][0]).cast("date"))
    a, b = (chosen(F.lit(DATE_HALVES[h]), lambda k, h=h: F.lit(CUT_CYCLES[k][2][h])) for h in (0, 1))
    days = F.datediff(day, first)
    tweak = F.concat_ws(":", F.lit("date"), F.when(cycle != 0, cycle.cast("string")))
    pair = feistel(F.floor(days / b), days % b, (a, b), key, tweak)
    return F.aggregate(F.array(pair), day, lambda _, p: F.date_add(first, (p["l"] * b + p["r"]).cast("int")))


def _date_format(s: Column) -> Column:
    slashed = F.when(F.try_to_timestamp(s, F.lit("MM/dd/yyyy")).isNotNull(), "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    return F.when(s.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(s.rlike("^[0-9]{4}/"), "yyyy/MM/dd").when(s.contains("/"), slashed).otherwise("dd.MM.yyyy")


def _octets(s: Column) -> Column:
    return F.transform(F.split(s, r"\."), lambda o: o.cast("int"))


def _ssn_parts(s: Column) -> tuple[Column, Column, Column]:
    return F.substring(s, 1, 3).cast("int"), F.substring(s, 5, 2).cast("int"), F.substring(s, 8, 4).cast("int")


def kind_of(s: Column) -> Column:
    """The kind of a candidate that validates, else null."""
    whole = lambda kind: s.rlike(f"^(?:{SHAPES[kind]})$")
    area, group, serial = _ssn_parts(s)
    n = F.length(_digits(s))
    return (
        F.when(F.locate("@", s) > 0, "email")
        .when(whole("iban"), F.when(_mod97(s) == 1, "iban"))
        .when(whole("date"), F.when(_date_of(s) >= F.lit(CUT_CYCLES[0][0]).cast("date"), "date"))
        .when(whole("ssn"), F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), "ssn"))
        .when(whole("ip"), F.when(F.forall(_octets(s), lambda o: o <= 255) & ~s.rlike(r"(^|\.)0[0-9]"), "ip"))
        .when(whole("phone"), F.when(n.between(7, 15), "phone"))
        .when(whole("card"), F.when(n.between(13, 19) & (_luhn_sum(_digits(s)) % 10 == 0) & (_digits(s) != F.repeat(F.lit("0"), n)), "card"))
    )


def pseudonym(s: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a validated value."""
    digits, n = _digits(s), F.length(_digits(s))
    email = F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(s)), 256), 1, 16), F.lit("@example.invalid"))
    # a card keeps its first digit and gets the check digit that fits
    inner = F.concat(F.substring(digits, 1, 1), permuted_digits(F.substring(digits, F.lit(2), n - 2), key, F.concat(F.lit("card"), F.substring(digits, 1, 1), n.cast("string"))))
    card = refill(s, F.concat(inner, F.pmod(10 - _luhn_sum(F.concat(inner, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    # a phone number keeps what stands before its last ten digits
    own = F.least(n, F.lit(10))
    phone = refill(s, F.concat(F.substring(digits, F.lit(1), n - own), permuted_digits(F.substring(digits, n - own + 1, own), key, F.lit("phone"))))
    o = _octets(s)
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], (F.lit(65536), F.lit(65536)), key, F.lit("ip"))
    ip = F.aggregate(F.array(pair), F.lit(""), lambda _, p: F.concat_ws(".", *[(F.floor(p[h] / 256) if high else p[h] % 256).cast("string") for h in ("l", "r") for high in (True, False)]))
    date = F.date_format(_permuted_day(_date_of(s), key), "yyyy-MM-dd")
    day = F.to_date(date, "yyyy-MM-dd")
    date = reduce(lambda c, f: c.when(_date_format(s) == f, F.date_format(day, f)), ("yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy"), F.when(_date_format(s) == "yyyy-MM-dd", date))
    area, group, serial = _ssn_parts(s)
    pair = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, (F.lit(898), F.lit(99 * 9999)), key, F.lit("ssn"))
    ssn = F.aggregate(
        F.array(pair),
        F.lit(""),
        lambda _, p: F.concat_ws("-", F.lpad((p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0")),
    )
    # an account keeps country and letters; its digits are permuted and its check digits made to fit
    rest = F.substring(s, F.lit(5), F.length(s))
    bban = refill(rest, permuted_digits(_digits(rest), key, F.concat(F.lit("iban"), F.substring(s, 1, 2), F.regexp_replace(rest, "[0-9]", "0"))))
    bban = F.when(F.length(_digits(rest)) >= 2, bban).otherwise(rest)
    country = F.substring(s, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), bban))).cast("string"), 2, "0"), bban)
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "iban", iban).otherwise(s)


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", chars_col: str = "n_chars", count_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all columns stay, rows stay as they are.

    ``chars_col``, if there is one, is set to the new length where a text changes.  ``count_col``
    adds the number of values replaced (it takes the place of a column of that name).  Null texts
    stay null with no values, empty ones empty; texts of any length are treated whole; repeated rows
    are treated alike; an empty table gives an empty table; no other column's name matters.
    """
    columns = docs.columns
    name = free_name("pii hits", *columns)
    text, hits = quoted(text_col), F.col(name)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    checked = F.transform(found, lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    none = F.array().cast("array<struct<value: string, kind: string>>")
    held = docs.withColumn(name, F.when(text.rlike("[0-9@]"), checked).otherwise(none))
    kinds = F.filter(hits, lambda h: h["kind"].isNotNull())
    renamed = F.transform(hits, lambda h: F.when(h["kind"].isNull(), h["value"]).otherwise(pseudonym(h["value"], h["kind"], key)))
    rebuilt = F.array_join(F.zip_with(F.split(text, PATTERN, -1), renamed, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = F.size(kinds) > 0
    out = []
    for c in columns:
        if c == text_col:
            out.append(F.when(changed, rebuilt).otherwise(text).alias(c))
        elif c != count_col:
            out.append(quoted(c))
    if count_col:
        out.append(F.size(kinds).cast("long").alias(count_col))
    result = held.select(*out)
    if chars_col in columns and chars_col != count_col:
        kind = docs.schema[chars_col].dataType
        result = result.withColumn(chars_col, F.when(text.isNull(), quoted(chars_col)).otherwise(F.char_length(text).cast(kind)))
    return result
