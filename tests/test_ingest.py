import pytest
from pyspark.sql import functions as F

from autoprofile.config import Config
from autoprofile.sources.cleaning import drop_empty
from autoprofile.sources.delimited import detect_headers, read_messy, read_tidy
from autoprofile.sources.names import clean_headers, clean_names, sanitized_name, unique_names
from autoprofile.sources.readers import (
    load,
    open_candidates,
    pick_table,
    read_table,
    score_tables,
    tidy,
)
from autoprofile.sources.texttypes import narrow_types


def written(path, text):
    path.write_text(text)
    return str(path)


def test_basic_load(spark, tmp_path):
    path = written(tmp_path / "basic.csv", "A,B\n1,x\n2,y\n3,z\n")
    table = load(spark, path)
    assert table.df.columns == ["a", "b"]
    assert sorted(map(tuple, table.df.collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert dict(table.df.dtypes) == {"a": "bigint", "b": "string"}
    assert table.rows_raw == 3
    assert table.name == path


def test_unknown_format_and_missing_path(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, written(tmp_path / "bad.xyz", "not a table"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "missing.parquet"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "missing.csv"))


def test_unreadable_file_raises(spark, tmp_path):
    with pytest.raises(Exception):
        read_table(spark, written(tmp_path / "bad.parquet", "not a parquet file")).collect()


def test_duplicate_columns(spark, tmp_path):
    path = written(tmp_path / "dup.csv", "A,B,A\n1,2,3\n")
    table = read_tidy(spark, path)
    assert table.columns == ["a", "b", "a_1"]
    assert table.first()["a_1"] == 3


def test_title_rows_are_skipped(spark, tmp_path):
    rows = "".join(f"{i},item_{i},{i * 10.5}\n" for i in range(5))
    path = written(tmp_path / "title.csv", f"My Report Title\n\nID,Name,Value\n{rows}")
    found = detect_headers(spark, path).first()
    assert (found["header_row"], found["header"]) == (2, "ID,Name,Value")
    table = read_messy(spark, path)
    assert table.columns == ["id", "name", "value"]
    assert sorted(map(tuple, table.collect()))[1] == (1, "item_1", 10.5)
    assert table.count() == 5


def test_each_file_has_its_own_header(spark, tmp_path):
    written(tmp_path / "one.csv", "Name,Amount\nx,1\nName,2\n")
    written(tmp_path / "two.csv", 'Export of Monday\n"Amount","Place, City",Name\n7,"Rome, IT",y\n')
    found = {
        r["file"].rsplit("/", 1)[1]: r["header_row"]
        for r in detect_headers(spark, str(tmp_path)).collect()
    }
    assert found == {"one.csv": 0, "two.csv": 1}
    table = read_messy(spark, str(tmp_path))
    assert set(table.columns) == {"name", "amount", "place_city"}
    rows = {(r["name"], r["amount"], r["place_city"]) for r in table.collect()}
    # a data line that repeats a header word is kept
    assert rows == {("x", 1, None), ("Name", 2, None), ("y", 7, "Rome, IT")}


def test_files_split_into_many_blocks(spark, tmp_path):
    """Title rows are dropped from the first block of each file only."""
    for n in range(3):
        titles = "Title of it\n" * n
        rows = "".join(f"{n},{i},Title of it\n" for i in range(2000))
        written(tmp_path / f"{n}.csv", f"{titles}file,place,text\n{rows}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table = read_messy(spark, str(tmp_path))
        assert table.rdd.getNumPartitions() > 10
        found = {
            (r["file"], r["count"], r["places"])
            for r in table.groupBy("file")
            .agg(F.count("*").alias("count"), F.countDistinct("place").alias("places"))
            .collect()
        }
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {(0, 2000, 2000), (1, 2000, 2000), (2, 2000, 2000)}


def test_numbers_do_not_make_a_header(spark, tmp_path):
    path = written(tmp_path / "n.csv", "1,2,x\nid,size,name\n3,4,y\n")
    assert detect_headers(spark, path).first()["header_row"] == 1


def test_header_detection_through_reader(spark, tmp_path):
    path = written(tmp_path / "t.csv", "Title\nid,name\n1,x\n2,y\n")
    table = read_table(spark, path, header_detection=True, config=Config())
    assert sorted(map(tuple, table.collect())) == [(1, "x"), (2, "y")]
    loaded = load(spark, path, header_detection=True)
    assert loaded.skipped_rows == 1
    assert loaded.warnings == ["Skipped up to 1 title row(s) above the header in 1 file(s)."]


@pytest.mark.parametrize(
    "names, expected",
    [
        (["a", "a", "a"], ["a", "a_1", "a_2"]),
        (["a", "a", "a_1"], ["a", "a_1", "a_1_1"]),
        (["A", "a"], ["a", "a_1"]),
        ([" Unit Price ($) ", "2024", "##"], ["unit_price", "col_2024", "unnamed"]),
        (["a b", "a-b"], ["a_b", "a_b_1"]),
    ],
)
def test_clean_names(names, expected):
    assert clean_names(names) == expected


def test_unique_names_always_unique():
    names = ["x", "x", "x_1", "x_1", "X_1", "x"]
    result = unique_names(names)
    assert len({n.lower() for n in result}) == len(names)
    assert sanitized_name("__a__b__") == "a_b"


def test_clean_headers_keeps_data(spark):
    frame = spark.createDataFrame([(1, 2)], ["My Col", "my col!"])
    assert tuple(clean_headers(frame).first()) == (1, 2)


def test_missing_markers_and_types(spark, tmp_path):
    text = "n,f,b,s\n1,1.5,True,NA\nNA,nan,False,x\n3,2,True,1x\n"
    table = read_tidy(spark, written(tmp_path / "m.csv", text))
    assert dict(table.dtypes) == {"n": "bigint", "f": "double", "b": "boolean", "s": "string"}
    assert table.where("n IS NULL AND f IS NULL").count() == 1


def test_numbers_only_some_engines_accept_stay_text(spark):
    frame = spark.createDataFrame([("1.5d", "1_000"), ("2", "3")], "a string, b string")
    assert dict(narrow_types(frame).dtypes) == {"a": "string", "b": "string"}


def test_drop_empty(spark):
    nan = float("nan")
    frame = spark.createDataFrame(
        [(1, None, nan, 1.0), (None, None, nan, nan), (3, None, nan, None)],
        "a int, b string, c double, d double",
    )
    assert sorted(map(tuple, drop_empty(frame).collect())) == [(1, 1.0), (3, None)]


def test_tidy_reports_what_it_dropped(spark):
    frame = spark.createDataFrame([(1, None), (None, None)], "A int, Notes string")
    table = tidy(frame, "t")
    assert table.df.collect() == [(1,)]
    assert table.warnings == [
        "Dropped 1 fully-empty column(s).",
        "Dropped 1 fully-empty row(s).",
    ]


def test_pick_table(spark):
    small = spark.range(3)
    large = spark.range(30).selectExpr("id", "id AS other")
    empty = spark.createDataFrame([], "a int")
    candidates = {"empty": empty, "small": small, "large": large, "twin": large}
    assert pick_table(candidates).first()["name"] == "large"
    assert pick_table(candidates, prefer_largest=False).first()["name"] == "empty"


def test_unreadable_candidates_never_win(spark, tmp_path):
    paths = {
        "missing": str(tmp_path / "missing.csv"),
        "strange": written(tmp_path / "strange.xyz", "?"),
        "good": written(tmp_path / "good.csv", "a,b\n1,2\n"),
    }
    candidates = open_candidates(spark, paths)
    assert pick_table(candidates).first()["name"] == "good"
    assert pick_table(candidates, prefer_largest=False).first()["name"] == "good"
    scores = {r["name"]: r["score"] for r in score_tables(candidates).collect()}
    assert scores == {"missing": 0, "strange": 0, "good": 5}


def test_row_cap_and_catalog_table(spark):
    spark.range(50).createOrReplaceTempView("fifty")
    assert read_table(spark, "fifty", format="table").count() == 50
    assert read_table(spark, "fifty", format="table", max_rows=7).count() == 7
