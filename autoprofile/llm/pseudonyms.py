"""Pseudonyms for personal numbers, dates and addresses by a format-preserving Feistel network.

Candidates are found by patterns and validated (check digits, calendar, ranges); what passes is
permuted under a key within its own format, so a card number stays a valid card number, a date a
date, and equal values, however they are written, become equal pseudonyms in every document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import column

#: the first and last day that a date may be; 17 * 4297 days lie between them, both included
FIRST_DAY, LAST_DAY, DAY_PARTS = "1900-01-01", "2099-12-31", (17, 4297)

MONTHS = (
    "January February March April May June July August September October November December"
).split()
MONTH = (
    r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![A-Za-z])"
)
MONTH_DAY = r"\d{1,2}(?i:st|nd|rd|th)?(?!\w)"
#: what stands between a day, a month's name and a year
APART = r"(?:\.?,?\s{1,3}(?:of\s{1,3})?|\.?,|[-/])"

PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "iso_date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?:(?=[Tt]\d{2})|(?![\w-]))",
    "date": (
        r"(?<![\w./])\d{1,2}(?<mark>[./])\d{1,2}\k<mark>\d{4}(?:(?=[Tt]\d{2})|(?![\w/]|\.\d))"
        r"|(?<![\w./])\d{4}(?<sign>[./])\d{1,2}\k<sign>\d{1,2}(?:(?=[Tt]\d{2})|(?![\w/]|\.\d))"
        rf"|(?<!\w)\d{{1,2}}(?i:st|nd|rd|th)?{APART}{MONTH}{APART}\d{{4}}(?!\w)"
        rf"|(?<!\w){MONTH}{APART}{MONTH_DAY}{APART}\d{{4}}(?!\w)"
        rf"|(?<!\w)\d{{4}}{APART}{MONTH}{APART}{MONTH_DAY}"
    ),
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": (
        # groups of three, three and four apart by spaces are none amid other groups of digits
        r"(?<![\w+])(?!\d{3} \d{3} \d{4} \d)(?:(?<![02-9] )(?<!\d1 )|(?!\d{3} \d{3} \d{4}))"
        r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
        r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
    ),
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w|[ -]\d)",
}

#: groups in a row that may hold several numbers with check digits, and what stands beside them
RUNS = {
    "iban": r"(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{0,31}+(?!\w)(?: [A-Z0-9]{1,35}+(?!\w))*+",
    "card": r"(?<![\w.])(?=\d(?:[ -]?\d){12})\d{1,19}+(?!\w)(?:[ -]\d{1,19}+(?!\w))*+",
}
#: card numbers as they are written: in one, 4-4-4-4, 4-6-5 or 4-6-4 digits
CARD_LAYOUTS = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
#: first digits of card numbers and how many digits they have (fixed values)
ISSUERS = {
    "^4": (13, 16, 19), "^(?:5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720))": (16,), "^3[47]": (15,),
    "^3(?:0[0-5]|[68])": (14,), "^35(?:2[89]|[3-8])": (16,), "^6(?:011|4[4-9]|5)": (16, 17, 18, 19),
    "^62": (16, 17, 18, 19),
}
#: characters of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


@dataclass(frozen=True)
class PseudonymRules:
    """``key`` decides the permutation: the same key gives the same pseudonyms; keep it secret.
    ``kinds``: what is replaced."""

    key: str
    kinds: tuple[str, ...] = tuple(PATTERNS)
    rounds: int = 8


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chars(text: Column) -> Column:
    """The characters of a text; none for an empty one."""
    places = F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: i > 0)
    return F.transform(places, lambda i: F.substring(text, i, F.lit(1)))


def _digest(rules: PseudonymRules, *parts: Column | str) -> Column:
    listed = [p if isinstance(p, Column) else F.lit(p) for p in (rules.key, *parts)]
    return F.sha2(F.concat_ws("\x1f", *listed), 256)


def _shifted(text: Column, digest: Column) -> Column:
    """Every letter and digit moved on within its class, by the bytes of a digest."""

    def moved(c: Column, i: Column) -> Column:
        place = (i % 32) * 2 + 1
        by = F.conv(F.substring(digest, place, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)

        def within(first: str, size: int) -> Column:
            return F.char(F.lit(ord(first)) + (code - ord(first) + by) % size)

        return (
            F.when(c.between("0", "9"), within("0", 10))
            .when(c.between("a", "z"), within("a", 26))
            .when(c.between("A", "Z"), within("A", 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(text), moved), "")


def permuted_text(text: Column, kind: str, rules: PseudonymRules) -> Column:
    """A text permuted among those with the same classes of characters in the same places.

    The halves take turns: one is moved on by a keyed digest of the other.  Upper and lower case
    move alike, so texts that differ in case stay linked.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substring(text, F.lit(1), half).alias("l"),
        F.substring(text, half + 1, F.length(text)).alias("r"),
    )

    def turn(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]  # noqa: E741
        other = F.when(i % 2 == 0, F.lower(r)).otherwise(F.lower(l))
        digest = _digest(rules, kind, F.length(text).cast("string"), i.cast("string"), other)
        return F.struct(
            F.when(i % 2 == 0, _shifted(l, digest)).otherwise(l).alias("l"),
            F.when(i % 2 == 1, _shifted(r, digest)).otherwise(r).alias("r"),
        )

    turns = F.sequence(F.lit(0), F.lit(rules.rounds - 1))
    return F.aggregate(turns, start, turn, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(
    number: Column, sizes: tuple[int, int], kind: str, rules: PseudonymRules
) -> Column:
    """A number below sizes[0] * sizes[1] permuted among these."""
    start = F.struct(
        F.floor(number / sizes[1]).cast("long").alias("l"),
        (number % sizes[1]).cast("long").alias("r"),
    )

    def turn(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]  # noqa: E741
        other = F.when(i % 2 == 0, r).otherwise(l)
        digest = _digest(rules, kind, i.cast("string"), other.cast("string"))
        by = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 0, (l + by % sizes[0]) % sizes[0]).otherwise(l).alias("l"),
            F.when(i % 2 == 1, (r + by % sizes[1]) % sizes[1]).otherwise(r).alias("r"),
        )

    turns = F.sequence(F.lit(0), F.lit(rules.rounds - 1))
    return F.aggregate(turns, start, turn, lambda s: s["l"] * sizes[1] + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, one by one."""
    return F.array_join(
        F.zip_with(
            F.split(text, "[0-9]"), _chars(digits),
            lambda between, digit: F.concat(between, F.coalesce(digit, F.lit(""))),
        ),
        "",
    )


def _luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """The sum of digits, every second one doubled; whether the first one is."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((i % 2 == 0) == doubled_first, twice).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), value), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, F.length(digits) % 2 == 0) % 10 == 0


def _card(text: Column, rules: PseudonymRules) -> Column:
    def with_check(payload: Column) -> Column:
        rest = _luhn_sum(payload, F.length(payload) % 2 == 1) % 10
        return F.concat(payload, ((10 - rest) % 10).cast("string"))

    digits = _digits(text)
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return _refilled(text, _once(permuted_text(payload, "card", rules), with_check))


def _iban_rest(country: Column, check: Column, account: Column) -> Column:
    """The number that an IBAN stands for, modulo 97."""

    def step(rest: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise(
            (rest * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97
        )

    return F.aggregate(_chars(F.concat(account, country, check)), F.lit(0), step)


def _iban_parts(text: Column) -> tuple[Column, Column, Column]:
    plain = F.regexp_replace(text, " ", "")
    return F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, 5, 64)


def _iban(text: Column, rules: PseudonymRules) -> Column:
    country, _, account = _iban_parts(text)

    def rebuilt(new: Column) -> Column:
        check = F.lpad((98 - _iban_rest(country, F.lit("00"), new)).cast("string"), 2, "0")
        return _once(F.concat(country, check, new), lambda whole: F.array_join(
            F.zip_with(
                F.split(text, "[A-Z0-9]"), _chars(whole),
                lambda between, c: F.concat(between, F.coalesce(c, F.lit(""))),
            ),
            "",
        ))

    return _once(permuted_text(account, "iban", rules), rebuilt)


def _ip_number(text: Column) -> Column:
    return F.aggregate(
        F.split(text, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long")
    )


def _ip(text: Column, rules: PseudonymRules) -> Column:
    def dotted(n: Column) -> Column:
        octets = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
        return F.concat_ws(".", *octets)

    return _once(permuted_number(_ip_number(text), (1 << 16, 1 << 16), "ip", rules), dotted)


def _ssn(text: Column, rules: PseudonymRules) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    digits = _digits(text)
    area = F.substring(digits, 1, 3).cast("long")
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    number = (place * 99 + F.substring(digits, 4, 2).cast("long") - 1) * 9999 + (
        F.substring(digits, 6, 4).cast("long") - 1
    )

    def written(n: Column) -> Column:
        front = F.floor(n / 9999)
        place = F.floor(front / 99)
        area = F.when(place >= 665, place + 2).otherwise(place + 1)
        return F.format_string("%03d-%02d-%04d", area, front % 99 + 1, n % 9999 + 1)

    return _once(permuted_number(number, (898 * 99, 9999), "ssn", rules), written)


def _date_of(text: Column) -> Column:
    """The day a text names: by a month's name, else year first, else day or month first by what
    is possible, day first where both are; NULL where none is."""
    name = F.lower(F.substring(F.regexp_extract(text, MONTH, 0), 1, 3))
    parts = F.split(text, "[-./]")
    n = [F.get(parts, F.lit(i)).try_cast("int") for i in range(3)]

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(
            F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                        F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")

    iso = F.length(F.get(parts, F.lit(0))) == 4
    named = made(
        F.regexp_extract(text, r"\d{4}", 0).try_cast("int"),
        F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), name).cast("int"),
        F.regexp_extract(text, r"(?<!\d)\d{1,2}(?!\d)", 0).try_cast("int"),
    )
    return F.when(name != "", named).when(iso, made(n[0], n[1], n[2])).otherwise(
        F.coalesce(made(n[2], n[1], n[0]), made(n[2], n[0], n[1]))
    )


def _day_number(text: Column) -> Column:
    return F.datediff(_date_of(text), F.lit(FIRST_DAY).cast("date"))


def _named_date(text: Column, day: Column) -> Column:
    """A day written like a text with a month's name: short or in full, in its case."""
    word = F.regexp_extract(text, MONTH, 0)
    full = F.date_format(day, "MMMM")
    short = (F.length(word) <= 4) & ~F.lower(word).isin("may", "june", "july")
    month = F.when(short, F.substring(full, 1, 3)).otherwise(full)
    month = F.when(word == F.upper(word), F.upper(month)).when(
        word == F.lower(word), F.lower(month)
    ).otherwise(month)
    number = F.dayofmonth(day)
    ending = F.when(number.isin(1, 21, 31), "st").when(number.isin(2, 22), "nd").when(
        number.isin(3, 23), "rd").otherwise("th")
    old = F.regexp_extract(text, r"(?<!\d)(\d{1,2})((?i:st|nd|rd|th)?)(?!\w)", 0)
    padded = F.when(old.startswith("0"), F.lpad(number.cast("string"), 2, "0")).otherwise(
        number.cast("string")
    )
    written = F.concat(padded, F.when(old.rlike("[A-Za-z]"), ending).otherwise(""))
    text = F.regexp_replace(text, F.lit(MONTH), month)
    text = F.regexp_replace(text, F.lit(r"\d{4}"), F.date_format(day, "yyyy"))
    return F.regexp_replace(text, F.lit(r"(?<!\d)\d{1,2}(?i:st|nd|rd|th)?(?!\w)"), written)


def _date(text: Column, rules: PseudonymRules) -> Column:
    """The same way of writing; a date that only fits month first stays month first."""
    parts = F.split(text, "[-./]")
    month_first = F.get(parts, F.lit(1)).try_cast("int") > 12
    mark = F.substring(F.regexp_extract(text, "([-./])", 1), 1, 1)

    def written(day: Column) -> Column:
        y, m, d = (f(day).cast("int") for f in (F.year, F.month, F.dayofmonth))
        first, second = F.when(month_first, m).otherwise(d), F.when(month_first, d).otherwise(m)
        return F.when(text.rlike(MONTH), _named_date(text, day)).when(
            F.length(F.get(parts, F.lit(0))) == 4,
            F.concat(F.date_format(day, "yyyy"), mark, F.date_format(day, "MM"), mark,
                     F.date_format(day, "dd")),
        ).otherwise(
            F.concat(F.lpad(first.cast("string"), 2, "0"), mark,
                     F.lpad(second.cast("string"), 2, "0"), mark,
                     F.lpad(y.cast("string"), 4, "0"))
        )

    moved = permuted_number(_day_number(text).cast("long"), DAY_PARTS, "date", rules)
    return _once(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), written)


def _phone(text: Column, rules: PseudonymRules) -> Column:
    """The digits after the country's."""
    digits = _digits(text)
    code = F.length(F.regexp_extract(text, r"^\+(\d{1,3})(?=[ .(-])", 1))
    kept = F.when(text.startswith("+"), F.greatest(code, F.lit(1))).otherwise(F.lit(0))
    return _once(kept, lambda k: _refilled(text, F.concat(
        F.substring(digits, F.lit(1), k),
        permuted_text(F.substring(digits, k + 1, F.length(digits)), "phone", rules),
    )))


def _email(text: Column, rules: PseudonymRules) -> Column:
    """The name and the first part of the domain; the rest says what kind of address it is."""
    name = F.substring_index(text, "@", 1)
    domain = F.substring_index(text, "@", -1)
    host = F.substring_index(domain, ".", 1)
    rest = F.substring(domain, F.length(host) + 1, F.length(domain))
    return F.concat(
        permuted_text(name, "email", rules), F.lit("@"), permuted_text(host, "host", rules), rest
    )


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(text: Column, rules: PseudonymRules) -> Column:
    """The kind of a candidate, NULL where its validation fails."""
    digits = _digits(text)
    area, group, serial = (F.split(text, "-")[i] for i in range(3))
    octets = F.split(text, r"\.")
    day = _day_number(text)
    in_range = day.isNotNull() & (day >= 0) & (day < DAY_PARTS[0] * DAY_PARTS[1])
    checks = {
        "email": F.lit(True),
        "iban": _iban_rest(*_iban_parts(text)) == 1,
        "ip": F.forall(octets, lambda x: x.cast("int") <= 255),
        "iso_date": in_range,
        "date": in_range,
        "ssn": (~area.isin("000", "666")) & (area < "900") & (group != "00") & (serial != "0000"),
        "phone": F.length(digits).between(7, 15),
        "card": F.length(digits).between(13, 19) & luhn_valid(digits),
    }
    found = F.lit(None).cast("string")
    for kind in reversed(rules.kinds):
        fits = text.rlike(_whole(PATTERNS[kind]))
        found = F.when(fits & F.when(fits, checks[kind]), F.lit(kind)).otherwise(found)
    return found


def pseudonym(text: Column, kind: Column, rules: PseudonymRules) -> Column:
    """The pseudonym of a value of a kind; the value itself where the kind is NULL."""
    made = {
        "email": _email, "iban": _iban, "ip": _ip, "iso_date": _date, "date": _date,
        "ssn": _ssn, "phone": _phone, "card": _card,
    }
    out = text
    for name in rules.kinds:
        out = F.when(kind == name, made[name](text, rules)).otherwise(out)
    return out


def _card_fits(text: Column, layouts: bool) -> Column:
    digits = _digits(text)
    fits = F.length(digits).between(13, 19)
    if layouts:
        fits &= text.rlike(CARD_LAYOUTS)
    return fits & F.when(fits, luhn_valid(digits))


def _issued(digits: Column) -> Column:
    """Do the digits begin as an issuer of cards has them begin, and have its length?"""
    size = F.length(digits)
    return F.coalesce(
        *[F.when(digits.rlike(begin), size.isin(*sizes)) for begin, sizes in ISSUERS.items()],
        F.lit(False),
    )


def _odd_card(run: Column) -> Column:
    """A whole run of groups as one card number in no usual layout, or as nothing."""
    fits = _card_fits(run, False) & _issued(_digits(run))
    return F.array(F.struct(run.alias("old"), F.when(fits, F.lit("card")).alias("kind")))


def _iban_fits(text: Column, of_country: bool) -> Column:
    fits = text.rlike(_whole(PATTERNS["iban"]))
    if of_country:
        size = F.length(F.regexp_replace(text, " ", ""))
        country = F.substring(text, 1, 2)
        fits &= F.coalesce(*[
            F.when(country.isin(names.split()), size == n) for n, names in IBAN_LENGTHS.items()
        ], F.lit(False))
    return fits & F.when(fits, _iban_rest(*_iban_parts(text)) == 1)


def _parts(run: Column, kind: str, groups: str, begin: str, most: int, fits: list) -> Column:
    """A run taken apart: structs of a text and its kind, NULL for what is none.

    From left to right, the groups from each one on that fit together are one number: by the
    first rule in ``fits`` that any count of groups (at most ``most``) meets, the longest.
    """

    def taken_apart(tokens: Column) -> Column:
        def joined(start: Column, n: Column) -> Column:
            return F.array_join(F.slice(tokens, start + 1, n), "")

        def part(text: Column, of: str | None) -> Column:
            return F.struct(text.alias("old"), F.lit(of).cast("string").alias("kind"))

        def turn(state: Column, i: Column) -> Column:
            counts = F.sequence(F.least(F.lit(most), F.size(tokens) - i), F.lit(1), F.lit(-1))
            texts = F.transform(
                counts,
                lambda n: F.struct(n.alias("n"), F.ltrim(joined(i, n), F.lit(" -")).alias("s")),
            )

            def chosen(own: Column) -> Column:
                def first(rule: Callable[[Column], Column]) -> Column:
                    return F.get(F.filter(own, lambda x: rule(x["s"])), F.lit(0))

                return F.coalesce(*map(first, fits))

            def taken(x: Column) -> Column:
                before = F.concat(
                    joined(state["until"], i - state["until"]),
                    F.regexp_extract(F.get(tokens, i), "^[ -]?", 0),
                )
                more = F.concat(state["parts"], F.array(part(before, None), part(x["s"], kind)))
                return F.when(x.isNotNull(), F.struct(
                    (i + x["n"]).alias("until"), more.alias("parts")
                )).otherwise(state)

            tried = (i >= state["until"]) & F.get(tokens, i).rlike(begin)
            return F.when(tried, _once(_once(texts, chosen), taken)).otherwise(state)

        start = F.struct(
            F.lit(0).alias("until"),
            F.array().cast("array<struct<old:string,kind:string>>").alias("parts"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(tokens) - 1), start, turn,
            lambda s: F.concat(s["parts"], F.array(
                part(joined(s["until"], F.size(tokens) - s["until"]), None)
            )),
        )

    return _once(F.regexp_extract_all(run, F.lit(groups), F.lit(0)), taken_apart)


#: a run of more groups than two cards have is a list of numbers
CROWDED = 8


def _cards(run: Column) -> Column:
    crowded = F.size(F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0))) > CROWDED

    def fits(x: Column) -> Column:
        return _card_fits(x, True) & (
            ~crowded | x.rlike(r"^\d+$") | _issued(_digits(x))
        )

    # the layouts have up to four groups
    return _parts(run, "card", r"[ -]?\d+", r"\d", 4, [fits])


def _ibans(run: Column) -> Column:
    fits = [lambda x: _iban_fits(x, True), lambda x: _iban_fits(x, False)]
    return _parts(run, "iban", " ?[A-Z0-9]+", r"^ ?[A-Z]{2}\d{2}", 9, fits)


def _passes(rules: PseudonymRules) -> list[tuple[str, tuple[str, ...], Callable]]:
    """Patterns, the kinds that they find, and how a candidate is taken apart, one after the
    other: each searches what the earlier ones left."""

    def simple(kinds: tuple[str, ...]) -> tuple[str, tuple[str, ...], Callable]:
        pattern = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)
        own = PseudonymRules(rules.key, kinds, rules.rounds)
        return pattern, kinds, lambda x: F.array(
            F.struct(x.alias("old"), kind_of(x, own).alias("kind"))
        )

    def runs(x: Column) -> Column:
        if checked == ("iban",):
            return _ibans(x)
        cards = _cards(x)
        return F.when(x.rlike("^[A-Z]"), _ibans(x)).otherwise(cards) if checked[1:] else cards

    checked = tuple(k for k in rules.kinds if k in RUNS)
    # a group behind + belongs to a telephone number as long as that may be one
    written = "|".join(f"(?:{RUNS[k]})" for k in checked).replace(r"(?<![\w.])", r"(?<![\w.+])")
    passes = [
        simple(tuple(k for k in rules.kinds if k == "email")),
        (written, checked, runs),
        simple(tuple(k for k in rules.kinds if k != "email" and k not in RUNS)),
        (RUNS["card"], tuple(k for k in checked if k == "card"), _odd_card),
    ]
    return [p for p in passes if p[1]]


def _filled(text: Column, mark: str, new: Column) -> Column:
    """The text with the values in place of the marks."""
    return F.array_join(
        F.zip_with(
            F.split(text, mark), new,
            lambda between, x: F.concat(between, F.coalesce(x, F.lit(""))),
        ),
        "",
    )


def pseudonymise(
    df: DataFrame, rules: PseudonymRules, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep``, then the text with pseudonyms, n_replaced, and kinds (sorted, distinct).

    Kinds: e-mail addresses, IBANs (check digits), IPv4 addresses (ranges), dates (calendar, 1900
    to 2099), social security numbers (ranges), telephone numbers (7 to 15 digits), card numbers
    (check digit).  Other numbers, and everything else, stay as they are; a null text stays null
    with nothing replaced.  Texts are searched whole; repeated rows give repeated results.

    Dates are read as yyyy-MM-dd, yyyy/M/d, yyyy.M.d, d.M.yyyy, d/M/yyyy and M/d/yyyy (also with
    dots), each also before ``T`` and a time, which stays; and with an English month's name, in
    full or short, as d MMM yyyy, MMM d yyyy and yyyy MMM d, apart by spaces, ``-``, ``/``,
    commas or ``of``, the day also as 1st.  Not read: years of two digits, d-M-yyyy, dates
    without marks (yyyyMMdd), without a day or year, and months' names of other languages.

    Groups of digits that stand side by side are tried from left to right for card numbers in
    their usual layouts, which in a row of more than eight groups need an issuer's prefix; where
    no other kind is found, a whole run of groups is one if it passes
    the check and has an issuer's prefix and length, so lists of numbers stay; groups of four after a country code likewise for IBANs, of the country's length
    first.  A group is never cut.
    """
    passes = _passes(rules)
    # what is replaced leaves a mark to later passes; marks of the text itself come back last
    first = 0xE000
    marks = [chr(first + i) for i in range(len(passes) + 1)]
    own_marks = f"[{marks[0]}-{marks[-1]}]"
    rows = df.select(
        *[column(df, c).alias(f"k{i}") for i, c in enumerate(keep)],
        column(df, text).cast("string").alias("t"),
    )
    t = F.col("t")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("candidate", F.coalesce(t.rlike("[0-9@]"), F.lit(False)))
    rows = rows.withColumn("own", F.when(
        F.col("candidate") & t.rlike(own_marks),
        F.regexp_extract_all("t", F.lit(own_marks), F.lit(0)),
    ))
    rows = rows.withColumn(
        "w", F.when(F.col("own").isNotNull(), F.regexp_replace("t", own_marks, marks[0]))
        .otherwise(t),
    )

    def marked(parts: Column, mark: str) -> Column:
        return F.array_join(F.transform(
            parts, lambda p: F.when(p["kind"].isNull(), p["old"]).otherwise(F.lit(mark))
        ), "")

    def made(part: Column, kinds: tuple[str, ...]) -> Column:
        own = PseudonymRules(rules.key, kinds, rules.rounds)
        new = pseudonym(part["old"], part["kind"], own)
        return F.struct(new.alias("new"), part["kind"].alias("kind"))

    def replaced(found: Column, kinds: tuple[str, ...]) -> Column:
        of_kind = F.filter(F.flatten(found), lambda p: p["kind"].isNotNull())
        return F.transform(of_kind, lambda p: made(p, kinds))

    def left(found: Column, mark: str) -> Column:
        return F.transform(found, lambda parts: marked(parts, mark))

    for i, (pattern, kinds, apart) in enumerate(passes):
        w, found = F.col("w"), F.col(f"found{i}")
        parts = F.transform(F.regexp_extract_all("w", F.lit(pattern), F.lit(0)), apart)
        rows = rows.withColumn(
            f"found{i}", F.when(F.col("candidate") & w.rlike(pattern), parts)
        )
        rows = rows.withColumn(f"new{i}", replaced(found, kinds))
        rows = rows.withColumn(
            "w", F.when(
                found.isNotNull(), _filled(w, pattern, left(found, marks[i + 1]))
            ).otherwise(w)
        )
    for i in reversed(range(len(passes))):
        w, new = F.col("w"), F.col(f"new{i}.new")
        rows = rows.withColumn(
            "w", F.when(F.size(new) > 0, _filled(w, marks[i + 1], new)).otherwise(w)
        )
    w = F.when(F.col("own").isNotNull(), _filled(F.col("w"), marks[0], F.col("own")))
    kinds = F.concat(none, *[
        F.coalesce(F.col(f"new{i}.kind"), none) for i in range(len(passes))
    ])
    return rows.withColumn("found", kinds).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce(w, F.col("w")).alias(text),
        F.size("found").cast("long").alias("n_replaced"),
        F.array_sort(F.array_distinct("found")).alias("kinds"),
    )
