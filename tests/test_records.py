import csv
import io

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from autoprofile.sources import records as module
from autoprofile.sources.delimited import detect_headers, read_messy, read_tidy, read_with_titles
from autoprofile.sources.records import cells, lines, records, states


@given(st.lists(st.integers(0, 3), max_size=12), st.booleans())
def test_states(kinds, inside):
    expected = [inside]
    for kind in kinds:
        expected.append(bool(kind >> 1 & 1) if expected[-1] else bool(kind & 1))
    assert states(np.array(kinds, dtype=np.int8), inside).tolist() == expected


CELL = st.text(st.sampled_from('ab,;"\n é'), max_size=8)
ROWS = st.lists(st.lists(CELL, min_size=1, max_size=4), min_size=1, max_size=8)
RAW = st.text(st.sampled_from('a,"\n '), max_size=40)


def by_python(text):
    """What Python reads, but for records of nothing: (cells of each record)."""
    return [row for row in csv.reader(io.StringIO(text, newline="")) if row]


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def read(spark, path):
    found = records(lines(spark, str(path))).where("value <> ''")
    rows = found.select("key", "block_start", "line_id", cells(F.col("value")).alias("cells"))
    return [r["cells"] for r in rows.sort("key", "block_start", "line_id").collect()]


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(ROWS, RAW)
def test_equal_to_python(spark, small_blocks, tmp_path, rows, raw):
    """Well-formed files, and any text whose quotes are closed in the end."""
    made = io.StringIO(newline="")
    csv.writer(made, lineterminator="\n").writerows(rows)
    for name, text in (("made", made.getvalue()), ("raw", raw)):
        if name == "raw" and not _closed(raw):
            continue
        path = tmp_path / f"{name}.csv"
        path.write_text(text, newline="")
        assert read(spark, path) == by_python(text)


def _closed(text):
    """Does a record after the text stand by itself?"""
    return by_python(text + "\nend")[-1:] == [["end"]]


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    """Blocks that begin inside cells, cells over several blocks, quotes that open nothing."""
    rows = [["id", "text", "size"]]
    for i in range(3000):
        said = ["plain", 'two\nlines "quoted", ', "x" * 90, "\n" * 40, '5" pipe'][i % 5]
        rows.append([str(i), said, str(i * 2)])
    rows.append(["3000", "line\n" * 900, "6000"])
    made = io.StringIO(newline="")
    csv.writer(made, lineterminator="\n").writerows(rows)
    (tmp_path / "long.csv").write_text(made.getvalue(), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        found = records(lines(spark, str(tmp_path / "long.csv")))
        assert found.rdd.getNumPartitions() > 50
        assert read(spark, tmp_path / "long.csv") == rows
        table = read_tidy(spark, str(tmp_path))
        assert dict(table.dtypes) == {"id": "bigint", "text": "string", "size": "bigint"}
        got = {r["id"]: (r["text"], r["size"]) for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    blank = {i for i, r in enumerate(rows[1:]) if not r[1].strip()}
    assert {i: v for i, v in got.items() if i not in blank} == {
        int(i): (text, int(size)) for i, text, size in rows[1:] if int(i) not in blank
    }
    assert len(got) == len(rows) - 1


def test_titles_and_breaks(spark, tmp_path):
    """Title rows, a header and cells with line breaks, one file for each order of columns."""
    one = '"Report of\nMonday",,\n,,\nName,"Size\nin cm",Note\n"a\nb",3,"x ""y"", z"\nc,4,\n'
    two = 'Name,Note\n"d\n\ne","f\n"\n'
    (tmp_path / "one.csv").write_text(one)
    (tmp_path / "two.csv").write_text(two)
    found = {r["file"].rsplit("/", 1)[1]: r for r in detect_headers(spark, str(tmp_path)).collect()}
    assert (found["one.csv"]["header_row"], found["two.csv"]["header_row"]) == (2, 0)
    table = read_messy(spark, str(tmp_path))
    assert set(table.columns) == {"name", "size_in_cm", "note"}
    rows = {(r["name"], r["size_in_cm"], r["note"]) for r in table.collect()}
    assert rows == {("a\nb", 3, 'x "y", z'), ("c", 4, None), ("d\n\ne", None, "f\n")}


def test_many_quoted_cells(spark, tmp_path):
    wide = ",".join(f'"column, {i}"' for i in range(20_000))
    (tmp_path / "wide.csv").write_text(f"Title\n{wide}\n")
    found = detect_headers(spark, str(tmp_path / "wide.csv")).first()
    assert (found["header_row"], found["header"]) == (1, wide)
    names = ",".join(f'"column, {i}"' for i in range(1_500))
    values = ",".join(f'"{i}"' for i in range(1_500))
    (tmp_path / "table.csv").write_text(f"Title\n{names}\n{values}\n")
    table = read_with_titles(spark, str(tmp_path / "table.csv"))
    assert len(table.columns) == 1_500
    assert tuple(table.first()) == tuple(str(i) for i in range(1_500))


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n3,z')
    assert read(spark, tmp_path / "open.csv") == [["a", "b"], ["1", "x\n2,y\n3,z"]]
    found = module._cut({(1, 0): None}, False)
    monkeypatch.setattr(module, "LONGEST_RECORD", 4)
    batch = pa.RecordBatch.from_pydict({
        "key": [1, 1], "block_start": [0, 0], "line_id": [0, 1],
        "kind": pa.array([module.SWAP, module.KEEP], pa.int8()), "value": ['"xyz', "abc"],
    })
    with pytest.raises(ValueError, match="never closed"):
        list(found(iter([batch])))


def test_other_delimiters(spark, tmp_path):
    (tmp_path / "semi.csv").write_text('a;b\n"1;\n2";3\n')
    rows = read_tidy(spark, str(tmp_path), delimiter=";").collect()
    assert [tuple(r) for r in rows] == [("1;\n2", 3)]
    with pytest.raises(ValueError, match="cannot separate"):
        lines(spark, str(tmp_path), '"')
