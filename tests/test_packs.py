"""Packs as a data source: round trips, partitions inside a pack, bounded memory, refusals, and resuming."""

import hashlib
import json
import struct
import tracemalloc
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import ids
from lectern.sources import packs

DIM = 3


def points(spark, n, slices=2):
    uid = F.concat(F.lit("en:A:"), F.col("id").cast("string"))
    payload = F.to_json(F.struct(F.lit("en").alias("lang"), F.concat(F.lit("B"), F.col("id") % 3).alias("book_code"), F.concat(F.lit("Straße \n"), F.col("id")).alias("raw_text")))
    vector = F.array(*[(F.col("id") * (k + 1) % 97).cast("float") for k in range(DIM)])
    return spark.range(0, n, 1, slices).select(uid.alias("uid"), ids.uuid5(uid).alias("id"), payload.alias("payload"), vector.alias("vector"))


def rows(df):
    return sorted((r.uid, r.id, r.payload, tuple(r.vector)) for r in df.select("uid", "id", "payload", "vector").collect())


def test_round_trip(spark, tmp_path):
    made = points(spark, 1000)
    packs.write_packs(made, str(tmp_path / "out"), blockRows="64")
    got = packs.read_packs(spark, str(tmp_path / "out"), blocksPerPartition="2", rows="50")
    assert rows(got) == rows(made)
    assert got.rdd.getNumPartitions() == 8  # two packs of eight blocks each
    numbers = got.groupBy("file").agg(F.count_distinct("n").alias("d"), F.max("n").alias("m")).collect()
    assert [(r.d, r.m) for r in numbers] == [(500, 499)] * 2
    files = sorted((tmp_path / "out").glob("*.pack"))
    assert len(files) == 2 and [p.name for p in (tmp_path / "out" / "_spool").iterdir()] == []
    # Any reader of ZIP files reads it, and the manifest says what is in it.
    with zipfile.ZipFile(files[0]) as z:
        assert z.testzip() is None and z.namelist() == [packs.MANIFEST, packs.POINTS, packs.VECTORS]
        manifest = json.loads(z.read(packs.MANIFEST))
        assert manifest["counts"] == {"points": 500, "books": 3, "dim": DIM, "points_bytes": len(z.read(packs.POINTS))}
        assert manifest["sha256"][packs.POINTS] == hashlib.sha256(z.read(packs.POINTS)).hexdigest()
        assert sum(b["points"] for b in manifest["books"]) == 500
    assert packs.pack_problems(spark, str(tmp_path / "out")).count() == 0


def test_same_rows_same_bytes(spark, tmp_path):
    for name in "ab":
        packs.write_packs(points(spark, 300), str(tmp_path / name), job="j", blockRows="100")
    assert [p.read_bytes() for p in sorted((tmp_path / "a").glob("*.pack"))] == [p.read_bytes() for p in sorted((tmp_path / "b").glob("*.pack"))]


def test_append_and_overwrite(spark, tmp_path):
    out = str(tmp_path / "out")
    packs.write_packs(points(spark, 10, 1), out)
    packs.write_packs(points(spark, 20, 1), out)
    assert packs.read_packs(spark, out).count() == 30
    packs.write_packs(points(spark, 5, 1), out, mode="overwrite")
    assert packs.read_packs(spark, out).count() == 5


class Stop(Exception):
    pass


def batches(n, start=0):
    for a in range(start, n, 10):
        own = range(a, min(n, a + 10))
        uids = [f"u{i}" for i in own]
        yield pa.record_batch({"uid": uids, "id": [str(uuid.uuid5(uuid.NAMESPACE_DNS, u)) for u in uids], "payload": ['{"lang": "en", "book_code": "A"}' for _ in own], "vector": [[float(i), 1.0] for i in own]})


def broken(n):
    for i, b in enumerate(batches(200)):
        if i == n:
            raise Stop
        yield b


@pytest.fixture
def task(monkeypatch):
    """A task without a cluster."""

    class Context:
        def partitionId(self):
            return 0

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: Context())


@pytest.mark.parametrize("stop", [0, 1, 5, 13, 19])
def test_resume(tmp_path, task, monkeypatch, stop):
    """A task that dies at any place is run again: finished blocks are not written twice, and the bytes are those of one run."""
    options = {"path": str(tmp_path / "out"), "job": "j", "blockrows": "32"}
    writer = packs.PackWriter(options, False)
    with pytest.raises(Stop):
        writer.write(broken(stop))
    writer.abort([None])
    assert packs.packs_at(options["path"]) == []
    puts = []
    original = packs.Spool.put
    monkeypatch.setattr(packs.Spool, "put", lambda self, name, data: (puts.append(name), original(self, name, data)))
    again = packs.PackWriter(options, False)
    again.commit([again.write(batches(200))])
    assert len([p for p in puts if p.endswith(".json")]) == 7 - stop * 10 // 32
    whole = packs.PackWriter({**options, "path": str(tmp_path / "whole")}, False)
    whole.commit([whole.write(batches(200))])
    (a,), (b,) = (packs.packs_at(str(tmp_path / x)) for x in ("out", "whole"))
    assert open(a, "rb").read() == open(b, "rb").read()


def test_other_rows_are_not_resumed(tmp_path, task):
    options = {"path": str(tmp_path / "out"), "job": "j", "blockrows": "32"}
    with pytest.raises(Stop):
        packs.PackWriter(options, False).write(broken(10))
    for other in (batches(200, 10), batches(40)):
        with pytest.raises(packs.PackError, match="another job"):
            packs.PackWriter(options, False).write(other)


def test_crash_in_the_commit(tmp_path, task):
    """Whatever the driver had renamed, a second run ends with the same packs."""
    options = {"path": str(tmp_path / "out"), "job": "j", "blockrows": "32"}
    writer = packs.PackWriter(options, False)
    message = writer.write(batches(100))
    packs.store_of(options["path"])[0].move(f"{message.folder}/whole", f"{tmp_path}/out/part-00000-j.pack")
    first = (tmp_path / "out" / "part-00000-j.pack").read_bytes()
    again = packs.PackWriter(options, False)
    again.commit([again.write(batches(100))])
    assert (tmp_path / "out" / "part-00000-j.pack").read_bytes() == first and not (tmp_path / "out" / "_spool" / "j").exists()


def foreign(path, lines, vectors, schema="pack/2", dim=2, count=None, digest=True, method=zipfile.ZIP_DEFLATED):
    """A pack of another writer: no list of blocks."""
    data, floats = "".join(f"{x}\n" for x in lines).encode(), struct.pack(f"<{len(vectors)}f", *vectors)
    manifest = {"schema": schema, "counts": {"points": len(lines) if count is None else count, "dim": dim}, "unknown": 1}
    if digest:
        manifest["sha256"] = {packs.POINTS: hashlib.sha256(data).hexdigest(), packs.VECTORS: hashlib.sha256(floats).hexdigest()}
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("manifest.json", json.dumps(manifest))
        z.writestr("points.jsonl", data)
        z.writestr("vectors.f32", floats, zipfile.ZIP_STORED if method == zipfile.ZIP_DEFLATED else zipfile.ZIP_DEFLATED)


def line(uid, id_=None):
    return json.dumps({"uid": uid, "id": id_ or str(uuid.uuid5(uuid.NAMESPACE_DNS, uid)), "payload": {"text": uid}})


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_foreign_packs(spark, tmp_path, method):
    n = 250
    foreign(tmp_path / "a.pack", [line(f"u{i}") for i in range(n)], np.arange(2.0 * n), method=method)
    got = packs.read_packs(spark, str(tmp_path / "a.pack"), rows="40").orderBy("n").collect()
    assert [(r.n, r.uid, r.vector) for r in got] == [(i, f"u{i}", [2.0 * i, 2.0 * i + 1]) for i in range(n)]


def test_refusals(spark, tmp_path):
    good = [line("a"), line("b")]
    cases = {
        "schema": dict(schema="pack/3", message="not known"),
        "short vectors": dict(vectors=[1, 2], message="bytes"),
        "missing lines": dict(lines=good[:1], count=2, message="1 points or more"),
        "more lines": dict(lines=[*good, line("c")], count=2, message="points or more"),
        "no digest": dict(digest=False, message="another digest"),
        "edited id": dict(lines=[good[0], line("b", "0")], message="not that of"),
        "no json": dict(lines=[good[0], "{"], message="not JSON"),
    }
    for name, case in cases.items():
        message = case.pop("message")
        path = tmp_path / f"{name}.pack"
        foreign(path, case.pop("lines", good), case.pop("vectors", [1, 2, 3, 4]), **case)
        with pytest.raises(Exception, match=message):
            packs.read_packs(spark, str(path)).collect()
    assert packs.read_packs(spark, str(tmp_path / "edited id.pack"), verifyIds="false").count() == 2
    with pytest.raises(Exception, match="needs uid"):
        packs.write_packs(points(spark, 3).withColumn("vector", F.expr("if(uid like '%1', null, vector)")), str(tmp_path / "null"))


@pytest.mark.parametrize("where", [0.3, 0.6, 0.9])
def test_damaged_and_torn(spark, tmp_path, where):
    packs.write_packs(points(spark, 2000, 1), str(tmp_path / "out"), blockRows="100")
    (path,) = packs.packs_at(str(tmp_path / "out"))
    data = bytearray(open(path, "rb").read())
    with zipfile.ZipFile(path) as z:
        first = z.getinfo(packs.POINTS).header_offset + 100
    at = first + int((len(data) - 3000 - first) * where)
    data[at] ^= 0xFF
    for name, content in (("damaged", bytes(data)), ("torn", bytes(data[: len(data) // 2]))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.pack").write_bytes(content)
        with pytest.raises(Exception, match="digest|damaged|not a readable|lines"):
            packs.read_packs(spark, str(tmp_path / name)).collect()
        assert packs.pack_problems(spark, str(tmp_path / name)).count() == 1


def test_bounded_memory(tmp_path, task):
    """A pack of 80 MB is written and read with a small part of that."""
    n, dim = 20_000, 1024

    def given():
        for a in range(0, n, 500):
            uids = [f"u{i}" for i in range(a, a + 500)]
            flat = pa.array(np.full(500 * dim, a, "<f4"))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(501, dtype=np.int32) * dim), flat)
            yield pa.record_batch({"uid": pa.array(uids), "id": pa.array([str(uuid.uuid5(uuid.NAMESPACE_DNS, u)) for u in uids]), "payload": pa.array(['{"lang":"en"}'] * 500), "vector": vectors})

    tracemalloc.start()
    before = pa.total_allocated_bytes()
    writer = packs.PackWriter({"path": str(tmp_path / "out"), "blockrows": "500"}, False)
    writer.commit([writer.write(given())])
    reader, seen, most = packs.PackReader({"path": str(tmp_path / "out")}), 0, 0
    for run in reader.partitions():
        for batch in reader.read(run):
            seen += batch.num_rows
            most = max(most, pa.total_allocated_bytes() - before)
    assert seen == n and tracemalloc.get_traced_memory()[1] + most < 30e6
    tracemalloc.stop()
