"""Streams of updates: each counts once, replayed batches too."""

import numpy as np
import pytest

from gridloom.streaming.growing import Growing


def source(spark, folder, n_files=3):
    for k in range(n_files):
        rows = [(i % 5, i % 2, k * 100 + i, float(i)) for i in range(k, 20)]
        spark.createDataFrame(rows, "i0 long, i1 long, pos long, v double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("i0 long, i1 long, pos long, v double").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("op", ["acc", "put"])
def test_stream(spark, engine, tmp_path, op):
    stream = source(spark, f"file://{tmp_path}/in")
    g = Growing(engine.from_numpy(np.zeros((5, 2))), f"file://{tmp_path}/g", op)
    g.follow(stream, f"file://{tmp_path}/cp").awaitTermination(120)
    want = np.zeros((5, 2))
    for k in range(3):
        for i in range(k, 20):
            want[i % 5, i % 2] = want[i % 5, i % 2] + i if op == "acc" else i
    assert np.array_equal(g.current().collect(), want)
    again = g.pending().where("batch = 1").withColumnRenamed("batch", "pos")
    g.write_batch(spark.createDataFrame(again.collect(), again.schema), 1)
    assert np.array_equal(g.current().collect(), want)
    smaller = g.compact(1)
    assert np.array_equal(smaller.current().collect(), want)
    assert {r.batch for r in smaller.pending().select("batch").distinct().collect()} == {2}


def test_nothing_yet(engine, tmp_path):
    g = Growing(engine.from_numpy(np.ones(3)), f"file://{tmp_path}/g")
    assert list(g.current().collect()) == [1, 1, 1]
    with pytest.raises(ValueError):
        Growing(engine.from_numpy(np.ones(3) * 1j), "x")


@pytest.mark.parametrize("op", ["acc", "put"])
def test_a_compacted_base_outlives_scratch_and_session(spark, engine, tmp_path, op):
    from gridloom.plans.engine import Engine
    from gridloom.plans.lineage import shared_dir
    from gridloom.sources import storage

    start = engine.from_numpy(np.arange(10.0).reshape(5, 2))
    g = Growing(start, f"file://{tmp_path}/g", op)
    schema = "i0 long, i1 long, pos long, v double"
    for batch in range(3):
        g.write_batch(spark.createDataFrame([(k, k % 2, k, float(10 * batch + k)) for k in range(batch, 5)], schema), batch)
    want = g.current().collect()
    g = g.compact(1)
    g.write_batch(spark.createDataFrame([(0, 0, 0, 100.0)], schema), 3)
    want[0, 0] = want[0, 0] + 100 if op == "acc" else 100
    again = Growing(Engine(spark).from_numpy(np.zeros((5, 2))), g.path, op)
    storage.delete(spark, f"{shared_dir(spark)}/gridloom")
    assert np.array_equal(again.resumed().current().collect(), want)
    # a batch whose folder outlived the compaction, as after a stop, isn't counted again
    Growing(start, g.path, op).write_batch(spark.createDataFrame([(1, 1, 1, 7.0)], schema), 1)
    assert np.array_equal(again.resumed().current().collect(), want)
    twice = again.resumed().compact(9)
    assert np.array_equal(twice.current().collect(), want) and np.array_equal(again.resumed().current().collect(), want)


def test_saved_arrays_are_recovered(spark, engine, tmp_path):
    from gridloom.plans.engine import Engine

    path = f"file://{tmp_path}/saved"
    a, b = engine.from_numpy(np.arange(6.0).reshape(2, 3), name="a"), engine.from_numpy(np.arange(4) * 1j, name="b")
    engine.save(path, a, b)
    other = Engine(spark)
    assert np.array_equal(other.recover(path, "a").collect(), a.collect()) and np.array_equal(other.recover(path, "b").collect(), b.collect())
    engine.save(path, a.with_value(a.df["v"] * 2))
    assert np.array_equal(Engine(spark).recover(path, "a").collect(), 2 * np.arange(6.0).reshape(2, 3))
    with pytest.raises(ValueError):
        other.recover(path, "c")
    with pytest.raises(ValueError):
        engine.save(path, engine.from_numpy(np.zeros(2)))
