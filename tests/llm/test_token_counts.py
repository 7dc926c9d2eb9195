import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from autoprofile.llm import token_counts as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


def check(spark, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("x"))
    found = sorted(map(tuple, C.token_counts(df, PATH).collect()), key=str)
    expected = []
    for key, text in rows:
        n = len(model.encode(text or ""))
        expected.append((key, len((text or "").encode()), n, n > 4096))
    assert found == sorted(expected, key=str)


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_equals_the_library(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    monkeypatch.setattr(C, "BUCKET_BYTES", 2000)
    rnd = random.Random(1)
    texts = [None, "", " ", "  ", "a ", "▁", "▁▁ x", "\n", " \n ", "<s>hi</s> <unk>", "a" * 5000,
             "word " * 6000, "ﬁ　x\x00y"]
    texts += ["".join(rnd.choices(" ▁ab\n\t漢é🎉.!  the", k=rnd.randint(1, 60)))
              for _ in range(300)]
    check(spark, [(i, t) for i, t in enumerate(texts)] + [(1, "again"), (1, "again"), (None, "n")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert C.token_counts(df, PATH).collect() == []


def test_vocabularies_that_do_not_fit_are_refused(monkeypatch):
    counter = C.load(PATH)
    assert counter.alone == 1

    class Joined:
        def __init__(self, **_):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, _):
            return "▁of▁the"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Joined)
    with pytest.raises(ValueError):
        C.PieceCounter(PATH)
