import re
from random import Random

import pytest
from pyspark.sql import functions as F

from autoprofile.llm import quotations as Q

ROWS = [
    (1, 0, "user", "How do I sort?\nAnd how do I group?"),
    (1, 1, "assistant", "Use sort.\n"),
    (1, 2, "user", "On Monday Ann wrote:\n> > How do I sort?\n> Use sort.\nThanks,\nwhich one?"),
    (1, 3, "assistant", ">Thanks,\n> Which   ONE?\nquicksort"),
    (1, 4, "user", "> And how do I group?\ngroup by"),
    (2, 0, "user", "> quicksort\nnot stable"),
    (2, 1, None, None),
    (2, 1, "x", "> nobody said\nhm"),
    (None, None, "u", "x"),
    (3, 0, "user", "How do I sort?"),
    (3, 1, "user", "> How do I sort?\nI know now"),
    (4, 0, "user", ">\n> \n"),
]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    return df.withColumn("depth", F.lit("x"))


def test_links(spark):
    found = {
        (r["conv_id"], r["turn"], r["passage"]): (r["level"], r["source_conv"], r["source_turn"])
        for r in Q.quotation_links(frame(spark)).collect()
    }
    assert found == {
        (1, 2, 0): (2, 1, 0), (1, 2, 1): (1, 1, 1), (1, 3, 0): (1, 1, 2), (1, 4, 0): (1, 1, 0),
        (2, 0, 0): (1, 1, 3), (2, 1, 0): (1, None, None), (3, 1, 0): (1, 3, 0),
        (4, 0, 0): (1, None, None),
    }


def test_reply_order(spark):
    rows = Q.reply_ordered(frame(spark)).orderBy(F.col("thread").asc_nulls_first(), "position")
    found = [(r["thread"], r["position"], r["conv_id"], r["turn"], r["depth"], r["content"])
             for r in rows.collect()]
    assert found[:7] == [
        (None, 1, None, None, 0, "x"),
        (1, 1, 1, 0, 0, "How do I sort?\nAnd how do I group?"),
        (1, 2, 1, 4, 1, "group by"),
        (1, 3, 1, 1, 0, "Use sort.\n"),
        (1, 4, 1, 2, 1, "Thanks,\nwhich one?"),
        (1, 5, 1, 3, 2, "quicksort"),
        (1, 6, 2, 0, 3, "not stable"),
    ]
    assert sorted(x[5] for x in found[7:9]) == ["", "hm"]
    assert found[9:] == [(3, 1, 3, 0, 0, "How do I sort?"), (3, 2, 3, 1, 1, "I know now"),
                         (4, 1, 4, 0, 0, "")]


def test_long_chain_and_popular_message(spark):
    rows = [(1, 0, "u", "the start")]
    rows += [(1, i, "u", f"> {'the start' if i == 1 else f'answer {i - 1}'}\nanswer {i}")
             for i in range(1, 40)]
    rows += [(c, 0, "u", "> the start\nme too") for c in range(2, 200)]
    found = Q.reply_ordered(frame(spark, rows)).collect()
    assert {r["thread"] for r in found} == {1} and len(found) == len(rows)
    assert max(r["depth"] for r in found) == 39
    assert sum(r["reply_to_turn"] == 0 for r in found) == 199
    assert sorted(r["position"] for r in found) == list(range(1, len(rows) + 1))


def test_formatted_and_empty(spark):
    row = Q.reply_ordered(frame(spark, [(1, 0, None, "hi")]), template="[%s] %s").first()
    assert row["formatted"] == "[none] hi"
    assert Q.reply_ordered(frame(spark).limit(0)).collect() == []
    assert Q.quotation_links(frame(spark).limit(0)).collect() == []


def plain(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def found_by(text):
    """The normalised whole, lines and sentences of a text, none blank, none twice."""
    whole = plain(text)
    parts = [whole, *map(plain, text.split("\n")), *re.split(r"(?<=[.!?]) ", whole)]
    return list(dict.fromkeys(p for p in parts if p))


def brute_force(rows, most):
    """(conv, turn, passage) -> level and source, message by message."""
    said, asked = [], []
    for conv, turn, _, text in rows:
        runs = []
        for line in text.split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", line).group()
            level = marks.count(">")
            content = re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line) if level else line
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(content)
        own = [x for level, lines in runs if level == 0 for x in lines]
        said += [(p, conv, turn) for p in found_by("\n".join(own))]
        asked += [(conv, turn, n, level, found_by("\n".join(lines)))
                  for n, (level, lines) in enumerate(
                      [r for r in runs if r[0] > 0])]
    result = {}
    for conv, turn, number, level, parts in asked:
        best = None
        for place, part in enumerate(parts):
            mine = min((t for p, c, t in said if (p, c) == (part, conv)), default=None)
            others = {c for p, c, _ in said if p == part}
            first = min(((c, t) for p, c, t in said if p == part), default=None)
            if mine is not None and mine < turn:
                source = (conv, mine)
            elif first and len(others) <= most and first < (conv, turn):
                source = first
            else:
                continue
            candidate = (place > 0, len(others), place, source)
            best = min(best or candidate, candidate)
        result[conv, turn, number] = (level, *(best[3] if best else (None, None)))
    return result


@pytest.mark.parametrize("most", [1, 3])
def test_links_against_brute_force(spark, most):
    random = Random(5)
    sentences = [f"{w} goes {x}." for w in ("One", "two", "THREE") for x in ("up", "down", "by")]
    rows = []
    for conv in range(8):
        for turn in range(6):
            lines = []
            for level in (2, 1):
                for _ in range(random.randint(0, 2)):
                    words = " ".join(random.choices(sentences, k=2)).split(" ")
                    cut = random.randint(1, len(words))
                    lines += ["> " * level + " ".join(words[:cut]),
                              ">" * level + " ".join(words[cut:])]
            lines += random.choices([*sentences, f"only here {conv} {turn}!", ""], k=2)
            rows.append((conv, turn, "u", "\n".join(lines)))
    found = {
        (r["conv_id"], r["turn"], r["passage"]): (r["level"], r["source_conv"], r["source_turn"])
        for r in Q.quotation_links(frame(spark, rows), most_conversations=most).collect()
    }
    assert found == brute_force(rows, most)
    assert any(v[1] is not None and v[1] != k[0] for k, v in found.items()) or most == 1


def test_common_lines_link_nowhere_else(spark):
    rows = [(1, 0, "u", "Thanks!"), (2, 0, "u", "Thanks!"), (3, 0, "u", "> Thanks!\nFor what?"),
            (4, 0, "u", "said once in all"), (5, 0, "u", "> said once\n> in all\nyes")]
    found = {r["conv_id"]: r["reply_to_conv"] for r in Q.reply_ordered(frame(spark, rows)).collect()}
    assert found == {1: None, 2: None, 3: None, 4: None, 5: 4}


def test_mail_is_linked_to_what_it_quotes(spark):
    """Every quotation is found again, at both levels, wrapped anew or not."""
    rows = [(c, t, "u", f"Message {t} of {c} speaks.\n" + f"Word{c}x{t} comes again. " * 9 + "\n")
            for c in range(3) for t in range(6)]
    rows += [(7, 0, "u", "> looks quoted\nbut is not"), (7, 1, "u", None), (7, 2, "u", "late"),
             (8, 4, "u", "alone"), (None, 0, "u", "none"), (9, None, "u", "no turn")]
    mail = Q.as_replies(frame(spark, rows))
    assert mail.columns == ["conv_id", "turn", "role", "text"] and mail.count() == len(rows)
    for r in Q.reply_ordered(mail).collect():
        c, t = r["conv_id"], r["turn"]
        if c not in (0, 1, 2):
            continue
        assert (r["reply_to_conv"], r["reply_to_turn"], r["depth"]) == (
            (c, t - 1, t) if t else (None, None, 0))
        assert r["quotes"] == r["quotes_linked"] == r["deepest"] == min(t, 2)
        assert (r["origin_conv"], r["origin_turn"]) == (
            (c, max(t - 2, 0)) if t else (None, None))
        own = next(x[3] for x in rows if x[:2] == (c, t))
        # quotations and announcements are gone; a text without them is as it was
        assert r["content"] == (own.rstrip() if t else own)
    odd = {(r["conv_id"], r["turn"]): (r["quotes"], r["content"])
           for r in Q.reply_ordered(mail).collect() if r["conv_id"] not in (0, 1, 2)}
    assert odd == {
        (7, 0): (0, "\u00a0> looks quoted\nbut is not"), (7, 1): (1, ""), (7, 2): (0, "late"),
        (8, 4): (0, "alone"), (None, 0): (0, "none"), (9, None): (0, "no turn"),
    }
    assert Q.as_replies(frame(spark).limit(0)).collect() == []
