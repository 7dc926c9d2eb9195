import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from autoprofile.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RULES = K.PackRules(length=64)


@given(st.integers(1, 40), st.data())
def test_best_fit_decreasing(length, data):
    sizes = data.draw(st.lists(st.integers(1, length), max_size=60))
    rows = K.best_fit_decreasing(sizes, length)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    rooms = []
    for size in sorted(sizes, reverse=True):  # the same by looking at every row
        fitting = [r for r in rooms if r >= size]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else length) - size)
    assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


def packed(df):
    return K.pack(K.token_pieces(df, PATH, public_tokenizers.PATTERN, rules=RULES), 3, rules=RULES)


def test_packing_loses_nothing(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, "word " * rnd.randint(0, 60)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "long text " * 3000), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = packed(df).collect()
    encoder = K._encoder(PATH, public_tokenizers.PATTERN)
    expected = sorted((k, tuple(encoder.encode_ordinary(t or "") + [50256])) for k, t in rows)
    pieces = defaultdict(lambda: defaultdict(list))
    for line in lines:
        ids = np.frombuffer(line["input_ids"], "<u2")
        places = np.frombuffer(line["positions"], "<u2")
        assert len(ids) == len(places) == 64 and line["cu_seqlens"][-1] == line["n_tokens"]
        ends = line["cu_seqlens"]
        for a, b, s in zip(ends, ends[1:], line["segments"], strict=False):
            assert places[a:b].tolist() == list(range(b - a)) and s["length"] == b - a
            pieces[s["key"]][s["piece"]].append(tuple(ids[a:b].tolist()))
    found = []
    for key, own in pieces.items():
        copies = len(own[0])
        whole = [sum((own[k][c] for k in sorted(own) if c < len(own[k])), ()) for c in range(copies)]
        if key == 7:
            assert len(whole) == 3
            found += [(key, w) for w in whole]
        else:
            found.append((key, whole[0]))
    short = [e for e in expected if e[0] != 7]
    assert sorted(f for f in found if f[0] != 7) == short
    again = packed(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, lines))

    K.write_matrices(packed(df), str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out")).filter("shard = 1").orderBy("row").collect()
    matrix = np.frombuffer(b"".join(bytes(r["input_ids"]) for r in read), "<u2").reshape(-1, 64)
    assert len(matrix) == sum(r["shard"] == 1 for r in lines)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert K.packed_documents(df, PATH, public_tokenizers.PATTERN).collect() == []
