"""Staged commits: writers that die, and how much of a store a batch reads."""

from __future__ import annotations

import pytest

from pairwright.sources import publish

SCHEMA = "id long, pub string, at long"


def stored(spark, store):
    return sorted((r["id"], r["pub"]) for r in spark.read.parquet(store).collect())


def send(spark, store, rows):
    return publish.publish(spark, spark.createDataFrame(rows, SCHEMA), store, "id", "pub", "at").collect()


def test_a_writer_that_dies_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    send(spark, store, [(1, "p", 0)])

    def die(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(publish, "commit", die)
    with pytest.raises(RuntimeError, match="killed"):
        send(spark, store, [(2, "q", 1), (3, "r", 2)])
    assert stored(spark, store) == [(1, "p")] and len(list((tmp_path / "store" / publish.STAGES).iterdir())) == 1
    monkeypatch.undo()
    assert {r["action"] for r in send(spark, store, [(2, "q", 1), (3, "r", 2), (1, "p", 3)])} == {"publish", "noop"}
    assert stored(spark, store) == [(1, "p"), (2, "q"), (3, "r")]
    assert publish.recover(spark, store) == 0


def test_a_batch_reads_only_files_that_may_hold_its_keys(spark, tmp_path):
    store = str(tmp_path / "store")
    for start in range(0, 1_000, 100):
        send(spark, store, [(n, "p", n) for n in range(start, start + 100)])
    every = publish.committed_rows(spark, store, spark.createDataFrame([(0, "p", 0), (999, "p", 0)], SCHEMA), "id")
    near = publish.committed_rows(spark, store, spark.createDataFrame([(250, "p", 0), (251, "p", 0), (1, None, None)][:2], SCHEMA), "id")
    assert every.count() == 1_000 and near.where("id in (250, 251)").count() == 2
    assert len(near.inputFiles()) <= 2 < len(every.inputFiles())
    assert publish.committed_rows(spark, store, spark.createDataFrame([(5_000, "p", 0)], SCHEMA), "id").isEmpty()
    assert [r["action"] for r in send(spark, store, [(999, "z", 0)])] == ["conflict"]


def test_empty_batches_and_null_keys(spark, tmp_path):
    store = str(tmp_path / "store")
    assert send(spark, store, []) == [] and not (tmp_path / "store").exists()
    assert [r["action"] for r in send(spark, store, [(None, "p", 0), (5, "q", 1)])] == ["publish", "publish"]
    assert [r["action"] for r in send(spark, store, [(None, "p", 0)])] == ["noop"]
    assert send(spark, store, []) == []
