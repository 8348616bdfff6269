"""Tree parts see all of their training rows, in one task or in passes of many."""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def binned(spark, tmp_path_factory):
    """(stored rows in five files, their codes, labels)."""
    from shiprisk.session import ship
    ship(spark)
    rng = np.random.default_rng(2)
    codes = np.minimum(rng.integers(0, 256, (4000, 9)), [255, 200, 3, 1, 90, 7, 0, 40, 255]).astype(np.uint8)
    y = (codes[:, 0] > 99).astype(int) + (codes[:, 1] > 80) * 1 + (rng.random(4000) < .1)
    path = str(tmp_path_factory.mktemp("binned") / "rows")
    spark.createDataFrame(pd.DataFrame({"y": y.astype(float), "codes": [c.tobytes() for c in codes]}), "y double, codes binary").repartition(5).write.parquet(path)
    rows = spark.read.parquet(path)
    got = rows.toPandas()
    return rows, np.frombuffer(b"".join(map(bytes, got.codes)), np.uint8).reshape(4000, 9), got.y.to_numpy()


def test_passes_grow_the_trees_of_one_task(spark, binned, monkeypatch):
    """Blocks, levels and subtraction change nothing but the rounding of sums; nor does adding up on the executors, nor waiting for others."""
    from shiprisk.models import boosting as B
    from shiprisk.models import passes as PS
    rows, codes, y = binned
    logistic, squared = B.Settings("logistic", 3, .1, 8, 31, balanced=True), B.Settings("squared", 3, .1, 10, 31)
    forest = B.Settings("forest", 4, depth=6, leaves=64, least_rows=10, balanced=True)
    blocks = PS.blocks(rows)
    found = PS.fit(blocks, {"a": (logistic, 1), "b": (squared, None), "c": (logistic, 7), "f": (forest, 2)})
    monkeypatch.setattr(PS, "LARGE", 0)
    again = PS.fit(blocks, {"b": (dataclasses.replace(squared, trees=1), None)})
    blocks.unpersist()
    for name, settings, label in (("a", logistic, (y == 1) * 1.0), ("b", squared, y), ("c", logistic, (y == 7) * 1.0)):
        want = B.fit(codes, label, settings)
        assert np.isclose(found[name].base, want.base) and found[name].depth == want.depth and len(found[name].roots) == 3
        assert np.allclose(found[name].raw(codes), want.raw(codes)), name
    assert np.allclose(again["b"].raw(codes), B.fit(codes, y, dataclasses.replace(squared, trees=1)).raw(codes))
    f = found["f"]
    assert len(f.roots) == 4 and f.depth <= 6 and f.mean and ((f.probability(codes) >= .5) == (y == 2)).mean() > .8


def test_a_lost_block_file_is_made_again(binned, tmp_path, monkeypatch):
    """Scores and nodes of a block do not depend on whether an executor has its file, an older one or none."""
    from shiprisk.models import boosting as B
    from shiprisk.models import passes as PS
    _, codes, y = binned
    block = ("0-0", np.ascontiguousarray(codes.T).tobytes(), y.tobytes())
    seen: list = []

    def trees(folder, forget):
        folder.mkdir()
        monkeypatch.setattr(PS.SparkFiles, "getRootDirectory", staticmethod(lambda: str(folder)))
        steps = PS._grow(({"0-0": len(y)}, float(y.sum()), int((y == 1).sum()), np.flatnonzero(codes.min(0) != codes.max(0)), 9), B.Settings("squared", 3, .3, 4, 8), None)
        sums, k = None, 0
        try:
            while True:
                job = steps.send(sums)
                if forget and k % 3 == 2:
                    for p in folder.iterdir():
                        p.write_bytes(np.array([-1, 0]).tobytes() + bytes(10 * len(y)))
                sums, k = np.zeros(PS._shape(job)), k + 1
                PS._count(block, job, sums)
                if k % 4 == 1:  # a task that runs twice
                    twice = np.zeros(PS._shape(job))
                    PS._count(block, job, twice)
                    assert np.array_equal(sums, twice)
        except StopIteration as e:
            return e.value

    for forget in (False, True):
        seen.append(trees(tmp_path / str(forget), forget).raw(codes))
    assert np.allclose(seen[0], seen[1]) and np.allclose(seen[0], B.fit(codes, y, B.Settings("squared", 3, .3, 4, 8)).raw(codes))


def test_every_part_sees_all_training_rows(spark, sf):
    """Beyond ``fit_rows`` parts are fitted by passes over all rows: the regressor starts at the mean of all delayed training rows,
    each class of reasons at its share of them, and the votes' rows are all there."""
    from shiprisk.models import pipeline as MP
    from shiprisk.plans.expressions_q import training_table
    p = dataclasses.replace(MP.TrainParams.quick(), fit_rows=150, rf_trees=4, rf_depth=3, gbt_a_iter=2, gbt_b_iter=2, reg_iter=2, reason_iter=2)
    trainer = MP.DelayTrainer(training_table(spark, sf), p)
    model = trainer.fit(*MP.OUTPUTS, "cluster")
    late, votes = trainer.delayed.where(~F.col("is_test")), trainer.split.where(~F.col("is_test"))
    assert late.count() > p.fit_rows
    assert np.isclose(model.forests["regressor"].base, late.agg(F.avg("delay_days")).first()[0])
    for kind, all_rows in (("vote", votes), ("days", late), ("reason", late)):
        rows, one = trainer._rows(kind)
        assert rows.count() == all_rows.count() and not one
    share = votes.agg(F.avg("delay_flag")).first()[0]
    assert np.isclose(model.forests["gbt_b"].base, np.log(share / (1 - share)))
    assert {n: len(f.roots) for n, f in model.forests.items()} == {"rf": 4, "gbt_a": 2, "gbt_b": 2, "regressor": 2, **{f"reason_{k}": 2 for k in range(4)}}
    whole = MP.DelayTrainer(training_table(spark, sf), dataclasses.replace(p, fit_rows=10 ** 6))
    assert whole.fit("raw_days", "p_gbt_b") and whole._rows("days")[1]
    seen = trainer.split.where("is_test")
    for name, out in (("regressor", "raw_days"), ("gbt_b", "p_gbt_b")):
        assert np.isclose(whole.model.forests[name].base, model.forests[name].base)
        a, b = ([r[0] for r in m.raw_scores(seen, (out,)).orderBy("shipment_id").select(out).collect()] for m in (model, whole.model))
        assert np.abs(np.array(a) - np.array(b)).mean() < 1e-3  # equal gains may be told apart by the rounding of sums


def test_a_micro_batch_has_work_for_every_core(spark, sf, monkeypatch):
    """the request stream takes at least one file for each core at a time."""
    from pyspark.sql.streaming.readwriter import DataStreamReader
    from shiprisk.plans import ml_q, streaming_q
    taken, put = {}, DataStreamReader.option

    class Enough(Exception):
        pass

    def stop(*_):
        raise Enough

    monkeypatch.setattr(ml_q, "fitted", lambda *_: None)
    monkeypatch.setattr(streaming_q.SJ, "stream_score", stop)
    monkeypatch.setattr(DataStreamReader, "option", lambda self, key, value: taken.update({key: value}) or put(self, key, value))
    with pytest.raises(Enough):
        streaming_q.q_stream_score(spark, sf)
    assert taken["maxFilesPerTrigger"] > spark.sparkContext.defaultParallelism
