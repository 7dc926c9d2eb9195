import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from autoprofile.llm import prefix_trie as module
from autoprofile.llm.prefix_trie import Fingerprint, TrieRules, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, block=100, head_turns=6):
    """Every rebuilt conversation as a list, every prefix of it as a node."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    rebuilt = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % head_turns
        base = c - (abs(c) % block if c >= 0 else -(abs(c) % block))
        rebuilt[c] = tuple(stored.get(base, [])[:h] + own[h:])
    members = defaultdict(set)
    for c, sequence in rebuilt.items():
        for d in range(len(sequence) + 1):
            members[sequence[:d]].add(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        more = (len(own) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += more
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(rebuilt[c]) == len(node)))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(df, rules=TrieRules()):
    return sorted(map(tuple, prefix_trie(df, rules).collect()), key=str)


def conversations(count=260, texts=3):
    """Few different turns, so that prefixes meet in every way; some conversations repeat."""
    rows = []
    for c in range(count):
        for turn in range(zlib.crc32(b"%d" % c) % 9 + (c % 50 == 0) * 6):
            said = zlib.crc32(f"{c % 130 if c > 150 else c} {turn}".encode()) % texts
            rows.append((c, turn, "user" if turn % 2 else "assistant", "say " * said + "é"))
    return rows


def test_products_and_quotients():
    base = module._base(0)
    parts = [Fingerprint(1, n, 10**20 + n) for n in range(6)]
    one = two = Fingerprint()
    for p in parts[:3]:
        one = one.then(p, base)
    for p in parts[3:]:
        two = two.then(p, base)
    whole = Fingerprint()
    for p in parts:
        whole = whole.then(p, base)
    assert one.then(two, base) == whole
    assert whole.after(one, base) == two
    assert whole.after(Fingerprint(), base) == whole


def test_against_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == expected(rows)
    assert found(df.repartition(7, "text")) == expected(rows)


def test_blocks_and_heads_are_rules(spark):
    rows = conversations(90)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, TrieRules(block=10, head_turns=4)) == expected(rows, 10, 4)


def test_a_conversation_over_many_ranges(spark):
    """Ranges end inside a conversation; its fingerprints go on in the next ranges."""
    rows = [(100, i, "user", f"line {i % 7}") for i in range(900)]
    rows += [(c, i, "user", f"line {i % 7}") for c in (3, 101, 102) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(df) == expected(rows)


ODD = [
    (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "assistant", "a"),
    (5, 2, "user", "x" * 100_000), (6, None, "", ""), (None, 1, "user", "nobody"),
    (-7, 0, "user", "below"), (-100, 0, "user", "base"), (-100, 1, "", "base"),
    (8, 3, "a", "b"), (8, 4, "", "ab"), (9, 3, "", "ab"), (9, 4, "a", "b"), (0, 0, "user", "a"),
    (99, 1, "user", "\U0001f600"), (99, 2, None, "\U0001f600"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns(
        {"hash": F.lit(1), "depth": F.lit("x"), "base": F.lit(None).cast("string")}
    )
    assert found(df) == expected(ODD)


def test_rebuilt_without_turns(spark):
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 4, 5, 6) if zlib.crc32(b"%d" % c) % 6]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    nobody = spark.createDataFrame([(None, 1, "user", "nobody")], SCHEMA)
    assert prefix_trie(nobody).collect() == []


def test_shared_fingerprints_are_drawn_again(spark, monkeypatch):
    """With 1 as multiplier the order of turns does not tell sequences apart."""
    drawn = module._base
    rows = [(c, t, "u", x) for c, turns in ((200, "abcdef"), (300, "bacdef"))
            for t, x in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(module, "_base", lambda draw: drawn(draw) if draw else 1)
    assert found(df) == expected(rows)
    monkeypatch.setattr(module, "_base", lambda draw: 1)
    with pytest.raises(ValueError, match="share a fingerprint"):
        prefix_trie(df)


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(module, "END_BYTES", 16)
    rows = [(c, t, "user", "hi") for c in range(300) for t in range(7)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
