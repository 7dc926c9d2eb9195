import contextlib
import io
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from autoprofile.llm import byte_bpe, language_id, mixing
from autoprofile.llm.exact_dedup import normalised
from autoprofile.llm.queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
STEMS = {"aa": "ka lo mi ta ru ne so pe".split(), "bb": "str gn ux eff wyn zor qua ij".split()}
NATIVE = ["op3_quotation_linking", "op4_fingerprints", "op6_mix_sources", "op8_pseudonyms"]


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:], words[2:], words[3:]))


@pytest.fixture(scope="module")
def documents(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(160):
        lang = "aa" if i % 3 else "bb"
        words = ["".join(rnd.choices(STEMS[lang], k=rnd.randint(1, 4))) for _ in range(60)]
        rows.append((i, " ".join(words), lang, f"src{i % 5}", "extra"))
        if i % 8 == 0:  # an exact copy but for white space
            rows.append((1000 + i, "\n".join(words) + " ", lang, "src1", "extra"))
        if i % 10 == 0:  # a near copy
            words[30] = "changed"
            rows.append((2000 + i, " ".join(words), lang, "src2", "extra"))
    rows += [(3000, None, "aa", "src0", "x"), (3001, "", None, None, "x"),
             (3002, "жшчщ " * 60, None, "src0", "x"), (3003, "123 456", "bb", "src0", "x"),
             (0, rows[0][1], "bb", "src0", "extra")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, _id string"
    )


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark, documents):
    docs, expected = documents, [tuple(r) for r in documents.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    # language: everything that the model, asked row by row, does not reject
    model = language_id.fit(documents)
    rejected = model.judge([r[1] for r in expected])[3]
    expected = [r for r, no in zip(expected, rejected, strict=True) if not no]
    docs = stages["language ID"](spark, docs, "")
    assert Counter(map(tuple, docs.collect())) == Counter(expected)
    assert {3000, 3001, 3002, 3003}.isdisjoint(r[0] for r in expected) and len(expected) > 190

    # exact copies: the longest text of each group, then the smallest id
    groups = defaultdict(list)
    for r in expected:
        groups[normalised(r[1].encode())].append(r)
    expected = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    docs = stages["exact dedup"](spark, docs, "")
    assert Counter(map(tuple, docs.collect())) == Counter(expected)

    # near copies: the smallest id of what is linked
    ordered = sorted(expected)
    sets, label = [shingles(r[1]) for r in ordered], list(range(len(ordered)))
    for i in range(len(ordered)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and both:
                old, new = sorted((label[i], label[j]))[::-1]
                label = [new if x == old else x for x in label]
    expected = [r for i, r in enumerate(ordered) if label[i] == i]
    docs = stages["n-gram Jaccard join"](spark, docs, "")
    assert Counter(map(tuple, docs.collect())) == Counter(expected)

    # mixture: as often as the operator says
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs)[0].collect()}
    docs = stages["mixing sources to target weights"](spark, docs, "")
    assert Counter(map(tuple, docs.collect())) == Counter(
        {r: copies[r[0]] for r in expected if copies[r[0]]}
    )
    assert docs.columns == documents.columns

    # encoding: the ids decode to the texts
    bpe = byte_bpe.load(*_vocabulary())
    last = stages["byte-level BPE encoding and decoding"](spark, docs, "").collect()
    assert len(last) == docs.count()
    by_id = texts(docs)
    for r in last:
        (ids,) = bpe.encode_all([by_id[r["doc_id"]]])
        assert bytes(r["token_ids"]) == ids.astype("<u4").tobytes()
        assert r["n_tokens"] == len(ids)


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_rows_that_share_an_id(spark):
    """Unlike texts under one id, or under none, are documents of their own."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, c), (None, c + " more"),
            (None, "solo"), (4, "solo"), (4, "solo"), (None, None), (5, ""), (5, "")]
    rows = [(key, text, "en", "src", "own") for key, text in rows]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, row string"
    )
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["n-gram Jaccard join"](spark, docs, "")
    assert kept.columns == docs.columns
    by_text = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    nones = by_text.pop((None, c), 0) + by_text.pop((None, c + " more"), 0)
    assert nones == 1
    assert by_text == Counter([(1, a), (1, b), (4, "solo"), (None, None), (5, ""), (5, "")])

    # two rows without an id: the mixture takes one twice, one once
    words = [(None, "a " * 10, "s"), (None, "b " * 10, "s"), (7, "c " * 10, "t"), (7, "", "t")]
    docs = spark.createDataFrame(words, "doc_id long, text string, source string")
    mixed = stages["mixing sources to target weights"](spark, docs, "")
    found = Counter(r["text"] for r in mixed.collect())
    numbered = corpus_pipeline._by_row(docs, "row")
    copies = mixing.mix(numbered, keys=("row",))[0].select("row", "copies")
    assert sum(found.values()) == copies.agg(F.sum("copies")).first()[0] and "" not in found
    assert sum(found.values()) == 3  # the budget is 30 words


def test_stages_take_empty_tables(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


# ------------------------------------------------------------------ registered queries

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    numbers = {n.split("_")[0] for n in QUERIES if n != "pipeline"}
    assert numbers == {f"op{i}" for i in range(1, 14)} and "pipeline" in QUERIES


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    relation = duck.sql(SQL[name])
    frame = QUERIES[name](spark, SF_DIR)
    assert sorted(frame.columns) == sorted(relation.columns)
    found = sorted(map(str, (tuple(r[c] for c in relation.columns) for r in frame.collect())))
    assert found == sorted(map(str, relation.fetchall()))


@needs_tables
@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    plan = out.getvalue()
    assert not [w for w in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop") if w in plan]


@needs_tables
def test_contract_columns(spark):
    columns = {
        "op1_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op2_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string",
                         "decoded_sha256": "string"},
        "op4_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string",
                             "fingerprint": "string", "edited_fingerprint": "string",
                             "near_edited": "double", "near_next": "double"},
        "op7_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint",
                             "over_limit": "boolean"},
        "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string",
                             "score": "double"},
    }
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    decoded = documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    for name, kinds in columns.items():
        frame = QUERIES[name](spark, SF_DIR)
        assert kinds.items() <= dict(frame.dtypes).items()
        assert frame.select("doc_id").distinct().count() == frame.count() == documents.count()
        if name == "op2_byte_bpe":
            same = frame.join(decoded, "doc_id").filter("sha = decoded_sha256")
            assert same.count() == documents.count()


@needs_tables
def test_contract_columns_of_other_tables(spark):
    longs = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split()
    columns = {
        "op11_prefix_trie": {**dict.fromkeys(longs, "bigint"), "ends_sha256": "string"},
        "op12_archives": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string",
                          "record_type": "string", "refers_to": "bigint"},
        "op13_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint",
                           "deviation": "bigint", "whitened": "double", "explained": "double",
                           "identity_error": "double"},
    }
    for name, kinds in columns.items():
        assert kinds.items() <= dict(QUERIES[name](spark, SF_DIR).dtypes).items()
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    white = QUERIES["op13_whitening"](spark, SF_DIR)
    worst = white.agg(F.count("*"), F.max("identity_error"), F.max("n")).first()
    assert worst[0] == 8 * vectors and worst[1] < 1e-4 and worst[2] == vectors
