import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from autoprofile.llm import pseudonyms as P

RULES = P.PseudonymRules(key="test")


def replaced(spark, texts, rules=RULES):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return P.pseudonymise(df.withColumn("kinds", F.lit(0)), rules).orderBy("doc_id").collect()


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10


FORMATS = {
    "card": ("4901293795153942", r"\d{16}"),
    "phone": ("+1 (171) 555-2028", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    "ip": ("64.147.79.24", r"\d{1,3}(\.\d{1,3}){3}"),
    "email": ("the.72@mail3.example.com", r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com"),
    "iso_date": ("1984-02-29", r"\d{4}-\d\d-\d\d"),
    "date": ("29.02.1984", r"\d\d\.\d\d\.\d{4}"),
    "ssn": ("123-45-6789", r"\d{3}-\d\d-\d{4}"),
    "iban": ("DE89 3704 0044 0532 0130 00", r"DE\d\d( \d{4}){4} \d\d"),
}


@pytest.mark.parametrize("kind", FORMATS)
def test_formats_stay(spark, kind):
    value, shape = FORMATS[kind]
    rows = replaced(spark, [f"before {value}, after", f"({value})", f"{value}."])
    found = [re.search(shape, r["text"]).group() for r in rows]
    assert len(set(found)) == 1 and found[0] != value
    assert [r["kinds"] for r in rows] == [[kind]] * 3
    assert [r["n_replaced"] for r in rows] == [1] * 3
    assert rows[0]["text"] == f"before {found[0]}, after"
    if kind == "card":
        assert luhn(found[0]) == 0
    if kind == "iso_date":
        datetime.date.fromisoformat(found[0])
    if kind == "iban":
        plain = found[0].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_equal_values_stay_linked(spark):
    one, two, three, four = (r["text"] for r in replaced(spark, [
        "4901293795153942", "4901 2937 9515 3942", "+1 (171) 555-2028", "171-555-2028",
    ]))
    assert one == two.replace(" ", "")
    assert re.sub(r"\D", "", three)[1:] == re.sub(r"\D", "", four)
    other = replaced(spark, ["4901293795153942"], P.PseudonymRules(key="other"))[0]["text"]
    assert other != one


def test_what_is_not_valid_stays(spark):
    texts = [
        "4901293795153943", "300.1.1.1", "version 2.0 and 3.14", "31.02.1984", "000-12-3456",
        "1799-01-01", "token = 6cfd1f1f244d4c4c327ecfd8fd9898497c475388", "7324201", "a@b",
        "DE88 3704 0044 0532 0130 00", "", None, "x" * 100_000, "1" * 100_000, "@" * 5000,
    ]
    rows = replaced(spark, texts)
    assert [r["text"] for r in rows] == texts
    assert {r["n_replaced"] for r in rows} == {0} and all(r["kinds"] == [] for r in rows)


def test_permutations_are_one_to_one(spark):
    days = spark.range(P.DAY_PARTS[0] * P.DAY_PARTS[1]).select(
        P.permuted_number(F.col("id"), P.DAY_PARTS, "date", RULES).alias("p")
    )
    row = days.agg(F.countDistinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(row) == (73049, 0, 73048)
    digits = spark.range(10_000).select(
        P.permuted_text(F.lpad(F.col("id").cast("string"), 4, "0"), "x", RULES).alias("p")
    )
    assert digits.filter("p rlike '^[0-9]{4}$'").distinct().count() == 10_000


def test_several_in_one_text(spark):
    text = " ".join(v for v, _ in FORMATS.values()) + "\n" + "1984-02-29 " * 500
    row = replaced(spark, [text])[0]
    assert row["n_replaced"] == len(FORMATS) + 500
    assert row["kinds"] == sorted(FORMATS)
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert P.pseudonymise(empty, RULES).collect() == []


CARDS = ["4901293795153942", "4901 2937 9515 3942", "4901-2937-9515-3942", "3782 822463 10005"]


def test_cards_beside_other_numbers(spark):
    """What stands next to a card number neither hides it nor goes with it."""
    frames = ["{}", "{} 2024", "{} 123", "{} 12/27", "7 {}", "{} 2nd", "{}.50", "no {} {}"]
    odd = [
        "49012 93795 15394 2", f"\ue000 {CARDS[0]} \ue003\ue001 1984-02-29 \ue002",
        "1 2 3 4 5 6 7 8 9 0 " * 200,
    ]
    rows = replaced(spark, [f.format(c, c) for c in CARDS for f in frames] + odd)
    for i, card in enumerate(CARDS):
        own = rows[i * len(frames):(i + 1) * len(frames)]
        alone = own[0]["text"]
        assert alone != card and luhn(re.sub(r"\D", "", alone)) == 0
        assert [r["text"] for r in own] == [f.format(alone, alone) for f in frames]
        assert [r["kinds"] for r in own] == [["card"]] * len(frames)
    groups, marks, long = (r["text"] for r in rows[-3:])
    assert groups.replace(" ", "") == rows[0]["text"] and rows[0]["text"] in marks
    assert re.findall("[^0-9-]", marks) == re.findall("[^0-9-]", odd[1])
    assert re.sub(r"\d", "0", long) == re.sub(r"\d", "0", odd[2])


def test_cards_and_ibans_beside_other_kinds(spark):
    values = ["1984-02-29", "29.02.1984", "123-45-6789", "171-555-2028", "64.147.79.24",
              "the.72@mail3.example.com", "7536784127813050"]
    ibans = ["ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00",
             "GB82WEST12345698765432"]
    frames = ["{} EUR 50", "{} 2024", "{} PAY NOW", "IBAN {} BIC ABCDEFGH", "AB12 {}", "{} {}"]
    frames = [f.format("{0}", "{0}") for f in frames]
    pairs = [(CARDS[0], v) for v in [*values, *ibans]]
    pairs += [(v, w) for w, v in pairs]
    rows = replaced(spark, [
        CARDS[0], *values, *ibans, *(" ".join(p) for p in pairs),
        *(f.format(i) for f in frames for i in ibans),
    ])
    texts = [r["text"] for r in rows]
    known = dict(zip([CARDS[0], *values, *ibans], texts))
    assert all(known[v] != v for v in known)
    assert texts[len(known):] == [f"{known[a]} {known[b]}" for a, b in pairs] + [
        f.format(known[i]) for f in frames for i in ibans
    ]


def test_layouts_of_dates(spark):
    """One day in every layout becomes one other day in the same layout."""
    layouts = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%d.%m.%Y", "%d/%m/%Y", "%d %B %Y", "%d %b %Y",
               "%B %d, %Y", "%b. %d %Y", "%d-%b-%Y", "%d/%b/%Y:10:00", "%Y %B %d", "%d of %B %Y",
               "%Y-%m-%dT10:00:00Z", "%Y/%m/%dT10:00", "%d. %B %Y"]
    day = datetime.date(1984, 2, 29)
    odd = ["FEB 29th, 1984", "february 29 1984", "Feb 30 1984", "Maybe 29 1984", "29 Mayor 1984"]
    rows = replaced(spark, [f"on {day.strftime(f)}, x" for f in layouts] + odd)
    texts = [r["text"] for r in rows]
    new = datetime.date.fromisoformat(texts[0][3:13])
    assert new != day and new.month != 5
    for f, text in zip(layouts, texts):
        assert datetime.datetime.strptime(text, f"on {f}, x").date() == new, (f, text)
    assert re.fullmatch(r"[A-Z]{3} \d+(st|nd|rd|th), \d{4}", texts[-5])
    assert texts[-4] == f"{new:%B} {new.day} {new.year}".lower()
    assert texts[-3:] == odd[-3:]


def test_lists_of_numbers_stay(spark):
    """Numbers that stand in rows are no card numbers because some of them pass a check digit."""
    random_numbers = random.Random(3)
    texts = [
        "scores 12 15 18 22 35 41 55 60 71 84 90 93 97", "rows: " + " ".join(
            str(100 * i) for i in range(1, 21)), " ".join(map(str, range(1, 21))),
        "1984 1985 1986 1987 1988 1989 1990 1991 1992 1993",
    ] + [
        " ".join(str(random_numbers.randint(1, 10**size)) for _ in range(40))
        for size in (1, 2, 3, 5, 6) for _ in range(20)
    ]
    rows = replaced(spark, texts)
    assert [r["text"] for r in rows] == texts
    odd = replaced(spark, ["49012 93795 15394 2", "49012 93795 15394 2 17"])
    assert odd[0]["kinds"] == ["card"] and odd[1]["kinds"] == []
