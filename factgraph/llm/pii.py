"""Format-preserving pseudonyms for validated numbers and dates, by keyed Feistel networks in SQL expressions.

Candidates are found by one pattern and validated (checksums, number ranges, the calendar).  A value is a number in a
domain of a * b; rounds add a keyed hash of one part to the other, modulo a and b in turn, so the map is a permutation of
the domain: equal values get equal pseudonyms in all documents, different ones stay different, and the format holds
(checksums are made anew, dates are dates).  Nothing is joined or shuffled, and no table of values exists.

What is validated, and what of it is permuted:

* card numbers of 13 to 19 digits with a right check digit: all digits but the last, which is computed anew
* phone numbers with a country code, dashes, dots, an area code in parentheses, or in groups by blanks: all digits after the
  country code (in groups: after the leading zero, or with first digits of 2 to 9)
* IPv4 addresses: the 32-bit number
* social security numbers in range: the index among valid ones
* dates of 1900 to 2099 as y-m-d, y/m/d, d.m.y, m/d/y or, where that is no date, d/m/y: the day's number; days and months
  have a leading zero unless one of the date's was without
* IBANs with right check digits: the account's digits; check digits are computed anew
* mail addresses: letters and digits of the local part, each within its kind
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import common

#: Session setting that holds the key.  Whoever knows it can undo the pseudonyms, so a corpus that leaves the house needs
#: one of its own; without it queries use the demonstration key, which is no secret.
KEY_SETTING, DEMONSTRATION_KEY = "spark.factgraph.pseudonymKey", "factgraph"
ROUNDS = 8

# Formats of personal numbers.  {B} and {E}: no word character before, after.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IPV4 = r"{B}[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}{E}"
DATE = r"{B}(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}){E}"
SSN = r"{B}[0-9]{3}-[0-9]{2}-[0-9]{4}{E}"
CARD = r"{B}(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}){E}"
IBAN = r"{B}[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?{E}"
#: Characters of each country's IBAN, so that a match ends where the number does; IBAN is the form of all.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BF BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC NI", 33: "RU",
}
IBANS = "{B}(?:" + "|".join("(?:%s)[0-9]{2}(?: ?[A-Z0-9]{4}){%d}%s" % ("|".join(c.split()), (n - 4) // 4, " ?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "") for n, c in sorted(IBAN_LENGTHS.items(), reverse=True)) + "){E}"
PHONE = r"(?:(?<!\w)\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}{E}|(?<!\w)\+[2-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}{E}|(?<!\w)\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}{E}|{B}[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}{E}|{B}[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}{E}|{B}0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}{E})"


def _java(pattern: str) -> str:
    return pattern.replace("{B}", r"(?<!\w)").replace("{E}", r"(?!\w)")


PATTERN = "|".join(_java(p) for p in (EMAIL, IPV4, DATE, SSN, IBANS, CARD, PHONE))
#: Texts without any of these hold nothing to find.
HINT = "[0-9@]"


def _whole(match: Column, pattern: str) -> Column:
    return match.rlike(f"^(?:{_java(pattern)})$")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _hash(key: str, kind: str, i: Column, value: Column) -> Column:
    """56 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256), 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, rounds: int = ROUNDS) -> tuple[Column, Column]:
    """Keyed permutation of pairs below (a, b)."""
    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        first = F.struct(F.pmod(s["l"] + _hash(key, kind, i, s["r"]), a.cast("long")).alias("l"), s["r"].alias("r"))
        second = F.struct(s["l"].alias("l"), F.pmod(s["r"] + _hash(key, kind, i, s["l"]), b.cast("long")).alias("r"))
        return F.when(i % 2 == 1, first).otherwise(second)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, turn)
    return out["l"], out["r"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Permutes digit strings of each length up to 36; shorter than 2: as they are."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half)
    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    a, b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), n - half).cast("long")

    def turn(s: Column, i: Column) -> Column:
        first = F.struct(F.pmod(s["l"] + _hash(key, kind, i, F.concat_ws(":", n.cast("string"), s["r"].cast("string"))), a).alias("l"), s["r"].alias("r"))
        second = F.struct(s["l"].alias("l"), F.pmod(s["r"] + _hash(key, kind, i, F.concat_ws(":", n.cast("string"), s["l"].cast("string"))), b).alias("r"))
        return F.when(i % 2 == 1, first).otherwise(second)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, turn, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0")))
    return F.when(n < 2, digits).otherwise(out)


def _fill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order."""
    chars = F.transform(
        F.sequence(F.lit(1), F.length(form)),
        lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))).otherwise(F.substring(form, i, F.lit(1))),
    )
    return F.array_join(chars, "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right, every second one doubled; ``doubled``: remainder of the doubled places (from 0)."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        payload = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return _let(payload, lambda p: F.concat(p, F.pmod(10 - luhn_sum(p, 0) % 10, F.lit(10)).cast("string")))

    return _let(_digits(m), lambda d: F.when((luhn_sum(d, 1) % 10 == 0) & d.rlike("[1-9]") & F.length(d).between(13, 19), _fill(m, made(d))))


def _phone(m: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        code = F.when(m.startswith("+1"), 1).when(m.startswith("+"), 2).when(m.startswith("0"), 1).otherwise(0)
        tail = F.substring(digits, code + 1, F.length(digits) - code)
        return F.concat(F.substring(digits, F.lit(1), code), permute_digits(tail, key, "phone"))

    return _let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), _fill(m, made(d))))


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))

    def made(p: Column) -> Column:
        l, r = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, "ipv4")
        return F.concat_ws(".", (l / 256).cast("int").cast("string"), (l % 256).cast("string"), (r / 256).cast("int").cast("string"), (r % 256).cast("string"))

    return _let(parts, lambda p: F.when(F.array_max(p) <= 255, made(p)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)  # of 898 areas: 001 to 899 without 666
    l, r = feistel(index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    new = l + 1 + F.when(l + 1 >= 666, 1).otherwise(0)
    made = F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.floor(r / 9999) + 1).cast("string"), 2, "0"), F.lpad((r % 9999 + 1).cast("string"), 4, "0"))
    return F.when((area >= 1) & (area != 666) & (area < 900) & (group >= 1) & (serial >= 1), made)


#: Days of 1900 to 2099: 319 * 229.
FIRST_DAY, DAY_FACTORS = "1900-01-01", (319, 229)


def _date(m: Column, key: str) -> Column:
    dotted, year_first = m.contains("."), m.rlike("^[0-9]{4}")
    parts = F.split(m, r"[-/.]")
    y, mo, d = (F.when(year_first, parts[0]).otherwise(parts[2]), F.when(year_first, parts[1]).when(dotted, parts[1]).otherwise(parts[0]), F.when(year_first, parts[2]).when(dotted, parts[0]).otherwise(parts[1]))
    date = lambda month, day: F.try_to_date(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    day_first = ~dotted & ~year_first & date(mo, d).isNull()
    day = F.when(day_first, date(d, mo)).otherwise(date(mo, d))
    bare = F.least(F.length(mo), F.length(d)) == 1

    def made(day: Column) -> Column:
        number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        a, b = DAY_FACTORS
        l, r = feistel(F.floor(number / b), number % b, F.lit(a), F.lit(b), key, "date")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), (l * b + r).cast("int"))
        dash = F.substring(m, 5, 1)

        def part(n: Column) -> Column:
            return F.when(bare, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))

        def day_of(t: Column) -> Column:
            year, month, of_month = F.year(t).cast("string"), part(F.month(t)), part(F.dayofmonth(t))
            return F.when(year_first, F.concat(year, dash, month, dash, of_month)).when(dotted, F.concat(of_month, F.lit("."), month, F.lit("."), year)).when(day_first, F.concat(of_month, F.lit("/"), month, F.lit("/"), year)).otherwise(F.concat(month, F.lit("/"), of_month, F.lit("/"), year))

        return _let(new, day_of)

    return _let(day, lambda t: F.when(F.year(t).between(1900, 2099), made(t)))


def _mod97(text: Column) -> Column:
    """Remainder of a letter-and-digit text read as a number, letters as 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda total, c: F.pmod(total * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    def made(plain: Column) -> Column:
        account = F.substring(plain, F.lit(5), F.length(plain) - 4)
        new = _fill(account, permute_digits(_digits(account), key, "iban"))

        def with_check(account: Column) -> Column:
            check = 98 - _mod97(F.concat(account, F.substring(plain, 1, 2), F.lit("00")))
            return F.concat(F.substring(plain, 1, 2), F.lpad(check.cast("string"), 2, "0"), account)

        return _let(new, with_check)

    def spaced(new: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(new, F.length(F.regexp_replace(F.substring(m, F.lit(1), i), " ", "")), F.lit(1))))
        return F.array_join(chars, "")

    rotated = lambda p: F.concat(F.substring(p, F.lit(5), F.length(p) - 4), F.substring(p, 1, 4))
    return _let(F.regexp_replace(m, " ", ""), lambda p: F.when((_mod97(rotated(p)) == 1) & F.length(p).between(15, 34), _let(made(p), spaced)))


#: Alphabets within which a character of a local part moves.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _shift(c: Column, by: Column) -> Column:
    """A character moved within its alphabet; others stay."""
    out = c
    for alphabet in ALPHABETS:
        at = F.call_function("instr", F.lit(alphabet), c)
        moved = F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))
        out = F.when((at > 0) & (F.length(c) == 1), moved).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    """Rounds shift each character of one half by a keyed hash of the other half."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    half = F.floor(n / 2).cast("int")

    def moved(part: Column, other: Column, i: Column) -> Column:
        stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), n.cast("string"), other, F.lit(str(part))), 256) for part in (0, 1)])
        return _let(stream, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), lambda k: _shift(F.substring(part, k, F.lit(1)), F.conv(F.substring(s, F.pmod(k * 2 - 2, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int"))), ""))

    begin = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, n - half).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        first = F.struct(moved(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        second = F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i).alias("r"))
        return F.when(i % 2 == 1, first).otherwise(second)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, turn, lambda s: F.concat(s["l"], s["r"], F.lit("@"), domain))


def _iban_or_card(m: Column, key: str) -> Column:
    """Check digits that fail leave a card within the candidate to be found."""
    card = F.regexp_extract(m, _java(CARD), 0)
    return F.coalesce(_iban(m, key), F.when(card != "", F.replace(m, card, _card(card, key))))


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or DEMONSTRATION_KEY


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a candidate; null if it isn't valid."""
    cases = F.when(m.contains("@"), _email(m, key))
    for pattern, make in ((IPV4, _ipv4), (DATE, _date), (SSN, _ssn), (IBAN, _iban_or_card), (CARD, _card)):
        cases = cases.when(_whole(m, pattern), make(m, key))
    return cases.otherwise(_phone(m, key))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in the text; ``found`` names a column for how many there are (0 if none).

    Null and empty texts stay; rows, their order of columns and all other columns are untouched.
    """
    matches, made = common.fresh(docs, "__matches", "__made")
    candidates = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(matches, candidates).withColumn(made, F.transform(matches, lambda m: pseudonym(m, key)))
    between = F.split(F.col(text), PATTERN, -1)
    new = F.transform(F.arrays_zip(F.col(matches).alias("m"), F.col(made).alias("p")), lambda x: F.coalesce(x["p"], x["m"]))
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda s, p: F.concat(s, p)), "")
    columns = [F.when(F.size(matches) > 0, joined).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if found:
        columns.append(F.coalesce(F.size(F.filter(made, lambda p: p.isNotNull())), F.lit(0)).cast("long").alias(found))
    return out.select(*columns)
