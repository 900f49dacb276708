"""The stream of interactions against one batch over all of them: duplicates, late rows, a failed batch, a restart."""

import datetime as dt

import pytest

from tidemark.operators import popularity as pop
from tidemark.streaming import readers as S

DAY = dt.datetime(2024, 5, 1)


def drop(spark, folder, rows):
    spark.createDataFrame([(u, i, None if d is None else DAY + dt.timedelta(days=d)) for u, i, d in rows], S.SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def counts(df):
    return {r["item_id"]: r["n_readers"] for r in df.collect()}


def batch(spark, rows):
    return counts(pop.readers(spark.createDataFrame([(u, i) for u, i, d in rows if None not in (u, i, d)], "user_id string, item_id string")))


def test_drops_of_files_equal_the_batch(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    drops = [[(f"u{k % 17}", f"i{(k * k + n) % 11}", n) for k in range(60)] + [(None, "i1", n), ("u1", None, n), ("u1", "i1", None)] for n in range(3)]
    seen = []
    for rows in drops:
        drop(spark, folder, rows)
        seen += rows
        S.keep_counts(S.arrivals(spark, folder), table, checkpoint).awaitTermination()
        assert counts(S.readers(spark, table)) == batch(spark, seen)
    S.keep_counts(S.arrivals(spark, folder), table, checkpoint).awaitTermination()
    assert counts(S.readers(spark, table)) == batch(spark, seen)
    items = spark.createDataFrame([("i0",), ("none",)], "item_id string")
    assert {r["item_id"]: r["popularity"] for r in S.popularity(spark, table, items).collect()}["none"] == 0


def test_a_batch_that_fails_is_counted_once_when_it_runs_again(spark, tmp_path, monkeypatch):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    drop(spark, folder, [("a", "x", 0), ("b", "x", 0)])
    drop(spark, folder, [("a", "x", 1), ("c", "y", 1)])
    writer, calls = type(spark.range(1).write), []
    whole = writer.parquet

    def fails_after_writing(self, path, *a, **b):
        whole(self, path, *a, **b)
        calls.append(path)
        if len(calls) == 2:
            raise OSError("lost")

    monkeypatch.setattr(writer, "parquet", fails_after_writing)
    with pytest.raises(Exception, match="lost"):
        S.keep_counts(S.arrivals(spark, folder, 1), table, checkpoint).awaitTermination()
    monkeypatch.setattr(writer, "parquet", whole)
    S.keep_counts(S.arrivals(spark, folder, 1), table, checkpoint).awaitTermination()
    assert counts(S.readers(spark, table)) == {"x": 2, "y": 1}


def test_late_rows_are_left_out(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for rows in ([("a", "x", 0)], [("b", "x", 100)], [("c", "x", 120)], [("late", "x", 10), ("d", "x", 119)]):
        drop(spark, folder, rows)
        S.keep_counts(S.arrivals(spark, folder), table, checkpoint, "30 days").awaitTermination()
    assert counts(S.readers(spark, table)) == {"x": 4}
