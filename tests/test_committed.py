"""Tables that change with one rename: whatever step a writer dies in, readers see old or new rows."""

from __future__ import annotations

import pytest

from momentloom.operators.incremental import upsert_by_key, without_keys
from momentloom.sources import committed

SCHEMA = "k int, v string"


def rows(spark, path):
    return sorted((r.k if r.k is not None else -1, r.v) for r in committed.read(spark, path).collect())


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "table")
    committed.create(spark.createDataFrame([(None, "n"), *[(i, f"v{i}") for i in range(6)]], SCHEMA), path, "k", 4)
    return path


def test_changes_touch_their_keys_only(spark, path):
    old = rows(spark, path)
    reader = committed.read(spark, path)
    committed.change(spark, spark.createDataFrame([(None, "m"), (2, "a"), (2, "b"), (9, "c")], SCHEMA), path)
    want = sorted([r for r in old if r[0] not in (-1, 2)] + [(-1, "m"), (2, "a"), (2, "b"), (9, "c")])
    assert rows(spark, path) == want and reader.count() == len(old)
    committed.change(spark, spark.createDataFrame([(3, "u")], SCHEMA), path, upsert_by_key)
    assert (3, "u") in rows(spark, path) and (3, "v3") not in rows(spark, path)
    committed.change(spark, committed.read(spark, path), path, without_keys)
    assert rows(spark, path) == []
    committed.change(spark, spark.createDataFrame([], SCHEMA), path)
    committed.change(spark, spark.createDataFrame([(1, "x")], SCHEMA), path)
    assert rows(spark, path) == [(1, "x")]


@pytest.mark.parametrize("step", ["_write", "_buckets", "_publish"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_writer_that_dies_leaves_old_or_new_rows(spark, path, monkeypatch, step, when):
    old, real = rows(spark, path), getattr(committed, step)

    def dies(*args):
        if when == "after":
            real(*args)
        raise KeyboardInterrupt

    delta = spark.createDataFrame([(1, "new")], SCHEMA)
    monkeypatch.setattr(committed, step, dies)
    with pytest.raises(KeyboardInterrupt):
        committed.change(spark, delta, path)
    monkeypatch.undo()
    new = sorted([r for r in old if r[0] != 1] + [(1, "new")])
    assert rows(spark, path) == (new if (step, when) == ("_publish", "after") else old)
    committed.change(spark, delta, path)
    assert rows(spark, path) == new


def test_the_second_of_two_writers_is_told(spark, path, monkeypatch):
    real = committed._write

    def overtaken(*args):
        monkeypatch.undo()
        committed.change(spark, spark.createDataFrame([(1, "first")], SCHEMA), path)
        return real(*args)

    monkeypatch.setattr(committed, "_write", overtaken)
    with pytest.raises(committed.Conflict):
        committed.change(spark, spark.createDataFrame([(1, "second")], SCHEMA), path)
    assert (1, "first") in rows(spark, path)
    now = 1 << 50
    assert len(committed.remove_unread(spark, path, 0, now)) == 1 and (1, "first") in rows(spark, path)
    with pytest.raises(ValueError):
        committed.change(spark, spark.createDataFrame([(1, "x")], SCHEMA), path, lambda b, d, k: d.selectExpr("k + 1000 AS k", "v").union(d.selectExpr("k + 1001", "v")).union(d.selectExpr("k + 1002", "v")).union(d.selectExpr("k + 1003", "v")))
