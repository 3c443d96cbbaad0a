"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers, dates and addresses in whole texts are replaced by others of
the same format: a keyed Feistel network permutes the values of each format, so
that equal values become equal pseudonyms in every document, different values
stay different, and the key's holder can go back.  Check digits are made anew,
so a pseudonym is as valid as what it replaces.

Texts are cut at matches by one pattern.  A number's digits (or an address's
letters and digits) form two halves; each round shifts one half, character by
character within its class, by a stream of SHA-256 of the key, the round, the
format and the other half.  Dates are permuted as days of two centuries, IPv4
addresses as pairs of 16-bit halves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import marked, present, unmarked

ROUNDS = 8

# The forms of the values, in order of precedence: what must not
# stand before, the value, what must not stand after, in Java's pattern language.
FORMS = {
    "email": (r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", None),
    "iban": (
        r"[A-Za-z0-9]",
        r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?",
        r"[A-Za-z0-9]",
    ),
    "date": (
        r"[0-9./-]",
        r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}",
        r"[0-9]",
    ),
    "ip": (r"[0-9.]", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"\.?[0-9]"),
    "ssn": (r"[0-9-]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9-]"),
    "phone": (
        r"[0-9+.-]",
        r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}"
        r"|(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
        r"|\+[0-9]{1,3}[ .-][0-9](?:[ .-]?[0-9]){6,11}",
        r"[0-9-]",
    ),
    "card": (r"[0-9.+-]", r"[0-9](?:[ -]?[0-9]){12,18}", r"[0-9-]"),
}
KINDS = tuple(FORMS)
# The groupings of cards, which may stand beside a short number.
CARD = (
    r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])"
)
#: A card beside a number is permuted until both together pass no test, so that
#: the way back finds the same card; 0.1 to the power of this remain.
WALK = 16
#: Likewise of dates with the month first: 0.4 to the power of this remain.
DAY_WALK = 32
PATTERN = "|".join(f"(?<!{a})(?:{v})" + (f"(?!{z})" if z else "") for a, v, z in FORMS.values())
#: A text with a match has one of this.
MAYBE = r"[0-9]{2}|@|[0-9]\.[0-9]"
# The first day of 1900 to 2099, 73,049 days: 17 times 4,297.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297


def _hex_at(stream: Column, i: Column) -> Column:
    """A number from 0 to 4095 at the i-th place (of 21) of a hash's digits."""
    return F.conv(F.substring(stream, (i % 21) * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _shifted(c: Column, by: Column) -> Column:
    """A letter or digit moved within its class; other characters stay."""

    def moved(first: str, size: int) -> Column:
        base = ord(first)
        return F.chr(F.pmod(F.ascii(c) - base + by, F.lit(size)) + base)

    return (
        F.when(c.between("0", "9"), moved("0", 10))
        .when(c.between("a", "z"), moved("a", 26))
        .when(c.between("A", "Z"), moved("A", 26))
        .otherwise(c)
    )


def _classes(s: Column) -> Column:
    return F.translate(
        s,
        "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "0" * 10 + "a" * 26 + "A" * 26,
    )


def permuted(value: Column, key: str, kind: str, backwards: bool = False) -> Column:
    """A string of letters and digits permuted among those with the same
    classes of characters at every place.  One character is only shifted by the
    key; an empty string stays."""
    half = F.shiftright(F.length(value), 1)
    left = F.substring(value, F.lit(1), half)
    right = F.substring(value, half + 1, F.length(value))
    form = _classes(value)

    def step(state: Column, round_: Column) -> Column:
        """Shifts one half by the other: the left one in even rounds."""
        even = round_ % 2 == 0
        target, other = F.when(even, state.l).otherwise(state.r), F.when(even, state.r).otherwise(state.l)
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), form, other), 256)
        sign = -1 if backwards else 1
        chars = F.filter(F.split(target, ""), lambda c: c != "")
        moved = F.array_join(F.transform(chars, lambda c, i: _shifted(c, _hex_at(stream, i) * sign)), "")
        return F.struct(F.when(even, moved).otherwise(state.l).alias("l"), F.when(even, state.r).otherwise(moved).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.reduce(rounds, F.struct(left.alias("l"), right.alias("r")), step, lambda s: F.concat(s.l, s.r))


def _permuted_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str, backwards: bool, finish: Callable) -> Column:
    """A pair of numbers below the sizes, permuted; ``finish`` takes the pair."""

    def step(state: Column, round_: Column) -> Column:
        even = round_ % 2 == 0
        other = F.when(even, state.b).otherwise(state.a)
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), other.cast("string")), 256)
        by = F.conv(F.substring(stream, 1, 12), 16, 10).cast("long") * (-1 if backwards else 1)
        return F.struct(
            F.when(even, F.pmod(state.a + by, F.lit(size_a))).otherwise(state.a).alias("a"),
            F.when(even, state.b).otherwise(F.pmod(state.b + by, F.lit(size_b))).alias("b"),
        )

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.reduce(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step, finish)


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counted once."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c > "4", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _passes(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def _card_in(value: Column) -> list[Column]:
    """What stands before a grouped card in a stretch of digits, the card, and
    what stands after it; empty if there is none."""
    return [F.regexp_extract(value, f"^(.*?)({CARD})(.*)$", i) for i in (1, 2, 3)]


def _joined(value: Column) -> Column:
    return F.replace(value, F.lit(" "))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """The rest modulo 97 of a text of digits and capitals (A is 10)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(
        chars,
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), F.pmod(s * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(
            F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))
        ),
    )


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.reduce(
        chars,
        start,
        lambda s, c: F.struct(
            F.concat(s.out, F.when(c.between("0", "9"), F.substring(digits, s.at, F.lit(1))).otherwise(c)).alias("out"),
            (s.at + F.when(c.between("0", "9"), 1).otherwise(0)).alias("at"),
        ),
        lambda s: s.out,
    )


def _month_first(value: Column) -> Column:
    """Whether a date with slashes can only have its month first."""
    return value.contains("/") & (F.substring(value, 4, 2) > "12")


def _date_of(value: Column) -> Column:
    year, one, two = F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2)
    iso = (
        F.when(value.contains("-"), value)
        .when(_month_first(value), F.concat_ws("-", year, one, two))
        .otherwise(F.concat_ws("-", year, two, one))
    )
    return F.try_to_date(iso, "yyyy-MM-dd")


def kind_of(value: Column) -> Column:
    """The kind of a match if it is valid; else null.

    Cards pass Luhn's test, alone or with a short number beside them, IBANs have a rest of 1 modulo 97, dates exist,
    octets are at most 255, social security numbers have no excluded group.
    """
    is_ = lambda k: value.rlike(f"^(?:{FORMS[k][1]})$")
    card = _card_in(value)[1]
    return (
        F.when(value.contains("@"), "email")
        .when(is_("iban"), F.when(_mod97(F.concat(F.substring(_joined(value), 5, 40), F.substring(value, 1, 4))) == 1, "iban"))
        .when(is_("date"), F.when(_date_of(value).isNotNull(), "date"))
        .when(is_("ip"), F.when(F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255), "ip"))
        .when(is_("ssn"), F.when(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "ssn"))
        .when(is_("phone"), "phone")
        .when(is_("card"), F.when(_passes(_digits(value)) | ((card != "") & _passes(_digits(card))), "card"))
    )


def _card(value: Column, key: str, backwards: bool) -> Column:
    """The pseudonym of a card, in any grouping."""
    digits = _digits(value)
    payload = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", backwards)
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return _refilled(value, F.concat(payload, check))


def _card_beside(value: Column, key: str, backwards: bool) -> Column:
    """A stretch of digits with the pseudonym of the grouped card in it."""
    before, card, after = _card_in(value)

    def step(state: Column, _: Column) -> Column:
        tried = F.transform(
            F.array(_card(state.v, key, backwards)),
            lambda v: F.struct(v.alias("v"), (~_passes(_digits(F.concat(before, v, after)))).alias("done")),
        )
        return F.when(state.done, state).otherwise(F.get(tried, F.lit(0)))

    start = F.struct(card.alias("v"), F.lit(False).alias("done"))
    return F.concat(before, F.reduce(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda s: s.v), after)


def _day_over_12(day: Column, moved: Callable, at: Callable) -> Column:
    """``day`` moved until it is after the 12th of a month, so that its date, too,
    can only have its month first."""

    def step(state: Column, _: Column) -> Column:
        tried = F.transform(
            F.array(moved(state.v)), lambda v: F.struct(v.alias("v"), (F.dayofmonth(at(v)) > 12).alias("done"))
        )
        return F.when(state.done, state).otherwise(F.get(tried, F.lit(0)))

    start = F.struct(day.cast("long").alias("v"), F.lit(False).alias("done"))
    return F.reduce(F.sequence(F.lit(1), F.lit(DAY_WALK)), start, step, lambda s: s.v)


def pseudonym(value: Column, kind: Column, key: str, backwards: bool = False) -> Column:
    """The pseudonym by ``key`` of a match of this kind; of a null kind, the
    match itself."""
    digits = _digits(value)
    n = F.length(digits)

    # the longest that passes is the card
    card = F.when(_passes(digits), _card(value, key, backwards)).otherwise(_card_beside(value, key, backwards))

    # written in groups of four or in one, an account has one pseudonym
    body = permuted(F.substring(_joined(value), 5, 40), key, "iban", backwards)
    country = F.substring(value, 1, 2)
    iban = F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)
    iban = F.when(value.contains(" "), F.regexp_replace(iban, "(.{4})(?=.)", "$1 ")).otherwise(iban)

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.concat(permuted(local, key, "email", backwards), F.lit("@"), domain)

    # the last seven digits of a phone number are the line; codes before stay
    phone = _refilled(
        value, F.concat(F.substring(digits, F.lit(1), n - 7), permuted(F.substring(digits, n - 6, F.lit(7)), key, "phone", backwards))
    )

    # area and group stay among valid ones: 1 to 665 and 1 to 99; the serial from 1 to 9999
    area, group, serial = (F.substring(digits, *x).cast("int") for x in ((1, 3), (4, 2), (6, 4)))
    low = area <= 665
    place = F.when(low, area - 1).otherwise(area - 2) * 99 + (group - 1)  # 898 areas
    ssn = _permuted_pair(
        place, serial - 1, 898 * 99, 9999, key, "ssn", backwards,
        lambda s: F.concat_ws(
            "-",
            F.lpad((F.when((s.a / 99).cast("int") <= 664, (s.a / 99).cast("int") + 1).otherwise((s.a / 99).cast("int") + 2)).cast("string"), 3, "0"),
            F.lpad((F.pmod(s.a, F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad((s.b + 1).cast("string"), 4, "0"),
        ),
    )

    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    o = lambda i: F.get(octets, F.lit(i))
    ip = _permuted_pair(
        o(0) * 256 + o(1), o(2) * 256 + o(3), 1 << 16, 1 << 16, key, "ip", backwards,
        lambda s: F.concat_ws(".", *(x.cast("string") for y in (s.a, s.b) for x in (F.shiftright(y, 8), y.bitwiseAND(255)))),
    )

    at = lambda day: F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
    moved = lambda day: _permuted_pair(
        (day / DAYS_B).cast("int"), F.pmod(day, F.lit(DAYS_B)), DAYS_A, DAYS_B, key, "date", backwards, lambda s: s.a * DAYS_B + s.b
    )
    day = F.date_diff(_date_of(value), F.lit(FIRST_DAY).cast("date"))
    new = F.when(_month_first(value), _day_over_12(day, moved, at)).otherwise(moved(day))
    shown = lambda d: (
        F.when(_month_first(value), F.date_format(d, "MM/dd/yyyy"))
        .when(value.contains("-"), F.date_format(d, "yyyy-MM-dd"))
        .when(value.contains("/"), F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.date_format(d, "dd.MM.yyyy"))
    )
    date = F.get(F.transform(F.array(new), lambda v: shown(at(v))), F.lit(0))
    by_kind = {"email": email, "card": card, "iban": iban, "ssn": ssn, "phone": phone, "ip": ip, "date": date}
    out = F.when(kind.isNull(), value)
    for k in KINDS:
        out = out.when(kind == k, by_kind[k])
    return F.coalesce(out, value)


def pseudonymised(df: DataFrame, key: str, text: str = "text", backwards: bool = False) -> DataFrame:
    """``df`` with the values in its texts replaced by pseudonyms; all rows and
    columns stay, whatever their names.

    Texts are searched whole; null texts stay null; equal texts become equal
    ones; an empty table gives no rows.  ``backwards`` puts the values back.
    """
    new = _searched(marked(df, body=F.col(text)), key, backwards)
    return unmarked(new.withColumn(f"c{df.columns.index(text)}", F.col("body")), df)


def _searched(rows: DataFrame, key: str, backwards: bool = False) -> DataFrame:
    """``rows`` with the pseudonyms in the texts of body, and found: the value
    and the kind of each match."""
    body = F.col("body")
    none = F.array().cast("array<struct<v:string,k:string>>")
    matches = F.transform(
        F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("v"), kind_of(m).alias("k"))
    )
    found = rows.withColumn("found", F.when(body.rlike(MAYBE), matches).otherwise(none))
    new = F.transform("found", lambda x: pseudonym(x.v, x.k, key, backwards))
    woven = F.zip_with(F.split(body, PATTERN, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return found.withColumn("body", F.when(F.size("found") > 0, F.array_join(woven, "")).otherwise(body))


def pseudonym_rows(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, text with pseudonyms by the key
    ``secret``, and n_email to n_date, how many values of a kind it had.

    Equal values of a kind get equal pseudonyms in all rows.  What only looks
    like a value (a wrong check digit, no such day) stays.  Other columns are
    not read; repeated rows are treated each; an empty table gives no rows.
    """
    some = docs.select(present(docs, key, "long").alias(key), F.col(text).cast("string").alias("body"))
    count = lambda k: F.coalesce(F.size(F.filter("found", lambda x: x.k == k)).cast("long"), F.lit(0))
    return _searched(some, secret).select(key, F.col("body").alias("text"), *(count(k).alias(f"n_{k}") for k in KINDS))
