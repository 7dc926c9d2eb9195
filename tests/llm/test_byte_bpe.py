import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from autoprofile.llm import byte_bpe
from autoprofile.llm.byte_bpe import RankBuckets

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.read_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={}
    )


@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 50)), max_size=80))
def test_buckets_come_in_order_of_rank(pairs):
    queue = RankBuckets(5001)
    if pairs:
        queue.push(*(np.array(x) for x in zip(*pairs)))
    found = []
    while (lowest := queue.pop()) is not None:
        found += [(lowest[0], p) for p in lowest[1].tolist()]
    assert found == sorted(set(pairs))


def test_equals_the_library(bpe, library):
    rnd = random.Random(0)
    odd = "aabbAB  \n\t\x1c\x85 ' 0129éß漢字🎉.,$#'s 're　​"
    texts = ["", None, "a" * 30_000, "ab" * 999, " " * 700, "é" * 500]
    texts += ["".join(rnd.choices(odd, k=rnd.randint(1, 150))) for _ in range(800)]
    texts += ["".join(rnd.choices("abcdeth", k=rnd.randint(1, 250))) for _ in range(800)]
    for text, ids in zip(texts, bpe.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text or "")
        assert bpe.decode(ids) == (text or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_any_text_round_trips(text):
    bpe = byte_bpe.load(PATH, PATTERN)
    (ids,) = bpe.encode_all([text])
    assert bpe.decode(ids) == text.encode()


def test_pre_tokens_are_forgotten_and_found_again(bpe, monkeypatch):
    first = [x.tolist() for x in bpe.encode_all(["some words", "words here"])]
    monkeypatch.setattr(byte_bpe, "MOST_KEPT", 0)
    assert [x.tolist() for x in bpe.encode_all(["some words", "words here"])] == first


def test_frames(spark, library):
    rows = [(1, "Hello there", 5), (2, None, 6), (3, "", 7), (1, "Hello there", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = byte_bpe.encode(df, PATH, PATTERN, ids="token_ids")
    back = byte_bpe.decode(encoded, PATH, PATTERN)
    found = sorted((r["doc_id"], bytes(r["content"])) for r in back.collect())
    assert found == [(1, b"Hello there"), (1, b"Hello there"), (2, b""), (3, b"")]
    done = byte_bpe.round_trip(df, PATH, PATTERN)
    counts = sorted((r["doc_id"], r["n_tokens"]) for r in done.collect())
    n = len(library.encode_ordinary("Hello there"))
    assert counts == [(1, n), (1, n), (2, 0), (3, 0)]
    assert byte_bpe.round_trip(df.limit(0), PATH, PATTERN).collect() == []
