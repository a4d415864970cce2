"""Imports are exactly once, whatever step they die at."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.store import Busy, CorpusStore
from lectern.streaming import imports

SCHEMA = "id string, n long"


class Crash(RuntimeError):
    pass


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def source(spark, tmp_path, files=4):
    folder = f"{tmp_path}/in"
    for k in range(files):
        # Ids overlap between files, so that a batch written twice or out of turn would show.
        spark.range(k * 10, k * 10 + 15).select(F.col("id").cast("string").alias("id"), F.lit(k).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, folder, store, tmp_path, job="j", **more):
    query = imports.import_files(spark, folder, schema(spark), store, job, f"{tmp_path}/state", files=1, **more)
    query.awaitTermination()


def content(store):
    return sorted((r.id, r.n) for r in store.read().collect())


#: (method of the store, call at which it dies, before or after its work)
STEPS = [(name, call, after) for name in ("_commit", "_point", "_sweep", "_renew") for call in (1, 3) for after in (False, True)]


@pytest.mark.parametrize(("name", "call", "after"), STEPS)
def test_killed_at_any_step(spark, tmp_path, monkeypatch, name, call, after):
    folder = source(spark, tmp_path)
    whole = CorpusStore(spark, f"{tmp_path}/whole", parts=2, keep=20)
    run(spark, folder, whole, tmp_path, "w")
    store = CorpusStore(spark, f"{tmp_path}/store", parts=2, keep=20)
    original, calls = getattr(CorpusStore, name), []

    def dying(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == call and not after:
            raise Crash("Crash")
        out = original(self, *args, **kwargs)
        if len(calls) == call:
            raise Crash("Crash")
        return out

    with monkeypatch.context() as m:
        m.setattr(CorpusStore, name, dying)
        with pytest.raises(Exception, match="Crash"):
            run(spark, folder, store, tmp_path)
    again = CorpusStore(spark, f"{tmp_path}/store", parts=2, keep=20)
    run(spark, folder, again, tmp_path)
    assert content(again) == content(whole)
    assert len(again.versions()) == len(whole.versions()) == 4
    assert imports.ledger(again, "j") | {"input": ""} == imports.ledger(whole, "w") | {"input": ""}


def test_later_files_and_other_inputs(spark, tmp_path):
    folder, store = source(spark, tmp_path, 2), CorpusStore(spark, f"{tmp_path}/store", parts=2)
    assert imports.ledger(store, "j") is None
    run(spark, folder, store, tmp_path, contract="c1")
    run(spark, folder, store, tmp_path, contract="c1")
    assert imports.ledger(store, "j")["written"] == 2
    source(spark, tmp_path, 3)
    run(spark, folder, store, tmp_path, contract="c1")
    assert imports.ledger(store, "j")["written"] == 5 and len(content(store)) == 35
    before = content(store)
    with pytest.raises(imports.OtherInput):
        run(spark, f"{tmp_path}/elsewhere", store, tmp_path, contract="c1")
    with pytest.raises(imports.OtherInput):
        run(spark, folder, store, tmp_path, contract="c2")
    with pytest.raises(ValueError, match="another embedding contract"):
        run(spark, folder, store, tmp_path, "k", contract="c2")
    assert content(store) == before


def test_made_rows(spark, tmp_path):
    folder, store = source(spark, tmp_path, 1), CorpusStore(spark, f"{tmp_path}/store", parts=2)
    run(spark, folder, store, tmp_path, make=lambda rows: rows.where("n = 0").withColumn("twice", F.col("id") * 2))
    assert {(r.id, r.twice) for r in store.read().collect()} == {(str(i), 2.0 * i) for i in range(15)}


def test_lost_lock(spark, tmp_path, monkeypatch):
    """A writer that was taken for dead makes no version, and the next writer's lock stays."""
    store, other = CorpusStore(spark, f"{tmp_path}/s"), CorpusStore(spark, f"{tmp_path}/s", stale=-1)
    rows = spark.createDataFrame([("a", 1)], SCHEMA)
    store.upsert(rows)
    held = other._locked()

    def meanwhile(old):
        held.__enter__()
        return rows.withColumn("n", F.lit(2).cast("long"))

    with pytest.raises(Busy, match="another writer"):
        store._commit(meanwhile)
    assert content(store) == [("a", 1)] and store._owner() is not None
    with pytest.raises(Busy):
        store.upsert(rows)
    held.__exit__(None, None, None)
    assert store._owner() is None and store.upsert(rows) == 1
