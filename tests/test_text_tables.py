"""CSV files: split where that is safe, whole where a quoted value holds a line end; rows in the order of the files."""

import csv

import pytest

from tidemark.sources import raw, tables


def write(path, rows, header=("a", "b")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])


def test_plain_files_are_split_and_quoted_line_ends_stay(spark, tmp_path):
    plain = [(str(i), f'said "{i}", twice') for i in range(3000)]
    write(tmp_path / "a.csv", plain)
    wild = [("x", "one\ntwo"), ("y", 'a "b\n\n" c'), ("z", "cr\rhere"), ("", "end\r\n")]
    write(tmp_path / "b.csv", wild)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        flags = {f.rsplit("/", 1)[1]: q for f, q in tables.quoted_line_ends(spark, str(tmp_path)).items()}
        assert flags == {"a.csv": False, "b.csv": True}
        out = tables.read_text_table(spark, str(tmp_path), ["a", "b"], order="nth")
        assert out.rdd.getNumPartitions() > 8
        rows = out.orderBy("nth").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["a"] or "", r["b"]) for r in rows] == plain + [(a, b.replace("\r\n", "\n")) for a, b in wild]


@pytest.mark.parametrize("rows", [[], [("1", "")], [("1", "é x"), ("2", '"')], [("1", "odd \" quote"), ("2", "y")]])
def test_few_rows(spark, tmp_path, rows):
    write(tmp_path / "a.csv", rows)
    out = tables.read_text_table(spark, str(tmp_path / "a.csv"), ["b", "a"], {"a": "int"}).collect()
    assert [(r["a"], r["b"]) for r in out] == [(int(a), b or None) for a, b in rows]
    with pytest.raises(KeyError):
        tables.read_text_table(spark, str(tmp_path / "a.csv"), ["c"])


def test_the_first_rating_is_that_of_the_first_file(spark, tmp_path):
    header = ("user_id", "work_id", "rating")
    write(tmp_path / "b.csv", [("u", "i", "9")] + [("v", str(k), "1") for k in range(2000)], header)
    write(tmp_path / "a.csv", [("u", "i", "3"), ("u", "i", "4")], header)
    items = spark.createDataFrame([("i",)], "item_id string")
    got = raw.interactions(spark, str(tmp_path), items, spark.createDataFrame([], tables.ALIASES)).collect()
    assert [tuple(r) for r in got] == [("u", "i", 3.0)]
