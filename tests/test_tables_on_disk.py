"""Tables that are changed in place: the keyed table of DML-01/02 and the sink of update-mode streams."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import changes as CH
from shelfwise.sources.keyed_table import KeyedTable
from shelfwise.streaming.runner import FOLD_EVERY, UpdateSink

RATINGS = "user_id bigint, function_id bigint, value bigint"


def _files(path):
    out = {}
    for f in glob.glob(f"{path}/bucket=*/part-*"):
        out.setdefault(int(f.split("bucket=")[1].split("/")[0]), set()).add(os.path.basename(f))
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    now = spark.createDataFrame([(u, f, 1) for u in range(40) for f in range(5)], RATINGS)
    t = KeyedTable.create(now, str(tmp_path / "t"), ["user_id", "function_id"], 16)
    assert _rows(t.read()) == _rows(now)
    before = _files(t.path)
    changes = spark.createDataFrame([(3, 2, 10, 5), (3, 2, 11, 4), (99, 1, 12, 3)], "user_id bigint, function_id bigint, seq bigint, value bigint")
    hit = t.upsert(changes, "seq")
    after = _files(t.path)
    assert 1 <= len(hit) <= 2 and all(after[b] == before[b] for b in before if b not in hit) and all(after[b].isdisjoint(before.get(b, set())) for b in hit)
    want = _rows(CH.upsert(now, changes, ["user_id", "function_id"], "seq", ["value"]).select("user_id", "function_id", "value"))
    assert _rows(t.read()) == want
    plan = t.read(hit)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "") or "PartitionFilters: [" in plan and "bucket" in plan
    t.upsert(changes, "seq")               # run again after a failure nobody saw the end of
    assert _rows(t.read()) == want
    assert t.upsert(changes.limit(0), "seq") == [] and _rows(t.read()) == want


def test_actions_on_a_table_of_users(spark, tmp_path, sf_dir):
    from shelfwise.sources.tables import view
    users, log = view(spark, sf_dir, "users"), view(spark, sf_dir, "actions")
    t = KeyedTable.create(users, str(tmp_path / "u"), ["user_id"], 8)
    for part in (log.where("seq < 300"), log.where("seq >= 300 AND seq < 310"), log.where("seq >= 310")):
        t.apply_actions(part)
    assert sorted(t.read().collect()) == sorted(CH.apply_actions(users, log).collect())


def test_a_table_needs_its_own_column_name(spark, tmp_path):
    with pytest.raises(ValueError):
        KeyedTable.create(spark.createDataFrame([(1, 2)], "bucket int, k int"), str(tmp_path / "x"), ["k"], 4)


def _sink(spark, path):
    return UpdateSink(spark, str(path), spark.createDataFrame([], "k bigint, v string").schema, ["k"])


def _batch(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v string").coalesce(1)


def test_two_hundred_batches_are_folded(spark, tmp_path):
    sink, want, rng, sizes = _sink(spark, tmp_path / "s"), {}, random.Random(5), []
    for n in range(200):                   # a small table: updates of 30 keys
        rows = [(rng.randrange(30), f"{n}")] if n % 9 else []
        want.update(rows)
        sink.write(_batch(spark, rows), n)
        sizes.append([r[2] for r in sink.runs()])
    runs = sink.runs()
    assert [a for a, _, _ in runs][0] == 0 and all(b + 1 == a2 for (_, b, _), (a2, _, _) in zip(runs, runs[1:])) and runs[-1][1] == 199
    assert max(map(len, sizes)) <= 12 and len(glob.glob(f"{tmp_path}/s/run-*")) == len(runs)
    folded = [s for n, s in enumerate(sizes) if n % FOLD_EVERY == FOLD_EVERY - 1]
    assert all(a > sum(s[i + 1:]) for s in folded for i, a in enumerate(s))       # so all are below twice the first
    assert dict(map(tuple, sink.table().collect())) == want


def test_a_failed_fold_changes_no_answer(spark, tmp_path, monkeypatch):
    sink, want = _sink(spark, tmp_path / "s"), {}
    for n in range(FOLD_EVERY - 1):
        rows = [(n % 2, f"{n}"), (10 + n, "x")]
        want.update(rows)
        sink.write(_batch(spark, rows), n)
    last = [(0, "last")]
    want.update(last)

    def half(self):
        runs = self.runs()                 # ends before its mark, with part of the rows
        path = f"{self.path}/run-{runs[0][0]}-{runs[-1][1]}"
        self._latest(self._read(runs)).limit(1).write.parquet(path)
        os.remove(f"{path}/_SUCCESS")
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(UpdateSink, "fold", half)
        with pytest.raises(OSError):
            sink.write(_batch(spark, last), FOLD_EVERY - 1)
    assert dict(map(tuple, sink.table().collect())) == want
    sink.write(_batch(spark, last), FOLD_EVERY - 1)                                # the batch again, and the fold
    assert dict(map(tuple, sink.table().collect())) == want and len(sink.runs()) == 1

    # a fold that ended, but did not come to delete what it folded
    sink.write(_batch(spark, [(0, "newer")]), FOLD_EVERY)
    runs = sink.runs()
    sink._latest(sink._read(runs)).write.parquet(f"{sink.path}/run-0-{FOLD_EVERY}")
    assert [r[:2] for r in sink.runs()] == [(0, FOLD_EVERY)]
    assert dict(map(tuple, sink.table().collect())) == want | {0: "newer"}


def test_an_empty_sink_has_no_rows(spark, tmp_path):
    assert _sink(spark, tmp_path / "none").table().collect() == []
    assert _sink(spark, tmp_path / "none").table().where(F.col("k") > 0).columns == ["k", "v"]
