import random
from collections import defaultdict

import pytest

from autoprofile.llm import jaccard_join as J
from autoprofile.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:], words[2:], words[3:]))


def brute(rows):
    """(key, size, component, links) with every pair of rows compared."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)
    for i, (key, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            if not both or key is None or rows[j][0] is None or 100 * both < 85 * union:
                continue
            links[i] += 1
            links[j] += 1
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for (key, _), own in zip(rows, label):
        least[own].append(key)
    return sorted(
        (
            (key, len(sets[i]), None if key is None else min(least[label[i]]), links[i])
            for i, (key, _) in enumerate(rows)
        ),
        key=str,
    )


def joined(df):
    return sorted(map(tuple, J.jaccard_join(df).collect()), key=str)


def near_copies(seed, groups=12, size=9):
    rnd = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(14))
    rows = []
    for g in range(groups):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 4, 5, 20, 60, 150]))]
        for _ in range(rnd.randint(1, size)):
            own = list(words)
            for _ in range(rnd.randint(0, max(1, len(own) // 40))):
                own[rnd.randrange(len(own))] = f"x{rnd.randint(0, 9)}"
            rows.append(common + "\n" + " ".join(own) if g % 3 == 0 else " ".join(own))
    rnd.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


ODD = [
    (2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"),
    (None, "one"), (2006, "É a b c d"), (2007, "é a b c d"), (2008, "long " * 6000),
    (2009, "long " * 6001), (2010, "a b c d"), (2010, "a b c d"),
]


def test_against_brute_force(spark):
    rows = near_copies(1) + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "n")
    assert joined(df) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 5])
def test_small_blocks_and_buckets(spark, monkeypatch, partitions):
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 2)
    monkeypatch.setattr(J, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(J, "BUCKET_TOKENS", 64)
    rows = near_copies(2, groups=6, size=14)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert joined(df) == brute(rows)


def test_no_links_and_empty_table(spark):
    rows = [(i, " ".join(f"{i}.{k}" for k in range(10))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == brute(rows)
    assert joined(df.limit(0)) == []


def test_the_bound_never_exceeds_the_threshold():
    """Prefixes of linked sets share as many tokens as the bound asks for."""
    rules = J.JaccardRules()
    for n in range(1, 400):
        for s in range(rules.least(n), n + 1):
            shared = -(-(n + s) * 85 // 185)
            asked = shared - rules.least(n) + rules.extra(n) - 1
            rest = max(n - rules.prefix(n), s - rules.prefix(s))
            assert rules.prefix(n) <= n and shared - rest >= min(asked, 1)
            assert asked <= shared - rest


def test_components(spark):
    rnd = random.Random(4)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 530)]
    rest = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)]
    links = path + star + rest + [(7, 7)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(links, "x long, y long")
    assert dict(map(tuple, components(frame).collect())) == label
    assert components(frame.limit(0)).collect() == []


def test_classes_that_share_a_key(spark):
    """Unlike texts under one key have links of their own, and one component each by its key."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, b + " even more")]
    found = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in found)
    assert links == [(1, 57, 1, 1), (1, 57, 1, 2), (2, 58, 1, 1), (3, 58, 1, 2), (4, 59, 1, 2)]
