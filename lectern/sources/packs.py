"""Packs as a Spark data source: `spark.read.format("pack")` and `df.write.format("pack")`.

A pack is a ZIP of a manifest, the points as lines of JSON (deflated) and their vectors as float32 rows (stored).  The writer makes
one pack for each task and cuts its lines into blocks at whose ends the deflate stream is flushed, so that a reader can begin at
any of them; the manifest lists the blocks with the digest of each.  A read is dealt into runs of blocks inside a pack, each
block is checked before its rows are given out, and no task holds more than a block.  A pack without a list of blocks is
read by one task, in one pass that checks it and one that reads it.

Writing has two phases.  A task spools its blocks to `_spool/<job>/<task>`, assembles the pack beside them and reports it; the
driver renames all packs into place when every task has ended, and only then removes the spool.  A job that is run again under the
same name goes on after the blocks that were finished, once it has seen that the rows are the same; the bytes of a pack
depend on its rows and options alone.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST, POINTS, VECTORS = "manifest.json", "points.jsonl", "vectors.f32"
SCHEMA = "file string, n bigint, uid string, id string, payload string, vector array<float>"
#: Major versions of the schema that can be read.
KNOWN = ("1", "2")
STEP = 1 << 20


class PackError(ValueError):
    """A pack is damaged, torn, short or not what its manifest says."""


# ---------------------------------------------------------------- files


def store_of(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def packs_at(path: str) -> list[str]:
    """The packs of a folder by name, or the one file that the path is."""
    from pyarrow import fs

    store, at = store_of(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=False))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".pack"))


@dataclass
class Place:
    """Where the bytes of an entry stand in its file."""

    start: int
    size: int
    raw: int
    deflated: bool


class Pack:
    """A pack that is open: its manifest, and where its entries are."""

    def __init__(self, store, path: str):
        self.path, self.file = path, store.open_input_file(path)
        try:
            with zipfile.ZipFile(self.file) as z:
                entries = {i.filename: i for i in z.infolist()}
                if missing := [n for n in (MANIFEST, POINTS, VECTORS) if n not in entries]:
                    raise PackError(f"{path}: there is no {missing[0]}")
                self.manifest = json.loads(z.read(MANIFEST))
        except (zipfile.BadZipFile, zlib.error, json.JSONDecodeError, EOFError) as e:
            raise PackError(f"{path}: not a readable pack: {e}") from e
        self.places = {n: self._place(i) for n, i in entries.items()}
        self._facts()

    def _place(self, entry: zipfile.ZipInfo) -> Place:
        self.file.seek(entry.header_offset)
        head = self.file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise PackError(f"{self.path}: {entry.filename} has no header")
        name, extra = struct.unpack("<HH", head[26:30])
        return Place(entry.header_offset + 30 + name + extra, entry.compress_size, entry.file_size, entry.compress_type == zipfile.ZIP_DEFLATED)

    def _facts(self) -> None:
        schema = str(self.manifest.get("schema"))
        if schema.partition("/")[2].partition(".")[0] not in KNOWN:
            raise PackError(f"{self.path}: schema {schema} is not known")
        try:
            counts = self.manifest["counts"]
            self.count, self.dim = int(counts["points"]), int(counts["dim"])
        except (KeyError, TypeError, ValueError) as e:
            raise PackError(f"{self.path}: the manifest has no counts") from e
        want = self.count * self.dim * 4
        if self.places[VECTORS].raw != want:
            raise PackError(f"{self.path}: {VECTORS} has {self.places[VECTORS].raw} bytes, {want} for {self.count} x {self.dim}")
        self.blocks = self.manifest.get("blocks") or []
        if self.blocks and sum(b["rows"] for b in self.blocks) != self.count:
            raise PackError(f"{self.path}: the blocks do not add up to {self.count} points")

    def raw(self, name: str, start: int = 0, size: int | None = None) -> Iterator[bytes]:
        """Bytes of an entry as they are stored, a step at a time."""
        place = self.places[name]
        left = place.size - start if size is None else size
        self.file.seek(place.start + start)
        while left > 0:
            data = self.file.read(min(STEP, left))
            if not data:
                raise PackError(f"{self.path}: {name} is cut off")
            left -= len(data)
            yield data

    def plain(self, name: str, start: int = 0, size: int | None = None) -> Iterator[bytes]:
        """The same, inflated."""
        if not self.places[name].deflated:
            yield from self.raw(name, start, size)
            return
        inflate = zlib.decompressobj(-15)
        try:
            for data in self.raw(name, start, size):
                while data:
                    yield inflate.decompress(data, STEP)
                    data = inflate.unconsumed_tail
            yield inflate.flush()
        except zlib.error as e:
            raise PackError(f"{self.path}: {name} is damaged: {e}") from e

    def problems(self) -> list[str]:
        """Entries whose digest differs from the manifest's, or that it does not name; read once, a step at a time."""
        found = []
        for name in (POINTS, VECTORS):
            want = (self.manifest.get("sha256") or {}).get(name)
            digest = hashlib.sha256()
            try:
                for data in self.plain(name):
                    digest.update(data)
            except PackError as e:
                found.append(str(e))
                continue
            if want != digest.hexdigest():
                found.append(f"{self.path}: {name} has another digest than the manifest")
        return found


def lines_of(parts: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        yield from whole
    if rest:
        yield rest


# ---------------------------------------------------------------- reading


@dataclass
class Run(InputPartition):
    """Blocks first .. last - 1 of a pack; the whole pack if it has no list of blocks."""

    address: str
    path: str
    first: int
    last: int

    def __init__(self, address: str, path: str, first: int, last: int):
        self.address, self.path, self.first, self.last = address, path, first, last


def batch_of(path: str, at: int, lines: list[bytes], vectors: bytes, dim: int, check_ids: bool) -> pa.RecordBatch:
    try:
        points = [json.loads(x) for x in lines]
    except json.JSONDecodeError as e:
        raise PackError(f"{path}: a line after {at} is not JSON: {e}") from e
    if check_ids:
        for k, p in enumerate(points):
            if p.get("id") != str(uuid.uuid5(uuid.NAMESPACE_DNS, str(p.get("uid")))):
                raise PackError(f"{path}: the id of line {at + k + 1} is not that of {p.get('uid')!r}")
    # The payload as it was written, not as Python would write it.
    flat = pa.array(np.frombuffer(vectors, "<f4"))
    offsets = pa.array(np.arange(len(lines) + 1, dtype=np.int32) * dim)
    payloads = [json.dumps(p.get("payload"), ensure_ascii=False, separators=(",", ":")) for p in points]
    columns = [pa.array([path] * len(points)), pa.array(range(at, at + len(points)), pa.int64()), *[pa.array([p.get(k) for p in points], pa.string()) for k in ("uid", "id")], pa.array(payloads), pa.ListArray.from_arrays(offsets, flat)]
    return pa.RecordBatch.from_arrays(columns, names=["file", "n", "uid", "id", "payload", "vector"])


class PackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.address, self.rows = options["path"], int(options.get("rows", 1000))
        self.run = int(options.get("blocksperpartition", 8))
        self.check_ids = str(options.get("verifyids", "true")).lower() == "true"

    def partitions(self) -> list[Run]:
        store, _ = store_of(self.address)
        runs = []
        for path in packs_at(self.address):
            blocks = len(Pack(store, path).blocks)
            runs += [Run(self.address, path, a, min(a + self.run, blocks)) for a in range(0, blocks, self.run)] or [Run(self.address, path, 0, 0)]
        return runs

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(run.address)
        pack = Pack(store, run.path)
        yield from self._blocks(pack, run) if pack.blocks else self._whole(pack)

    def _blocks(self, pack: Pack, run: Run) -> Iterator[pa.RecordBatch]:
        for k in range(run.first, run.last):
            block = pack.blocks[k]
            lines = b"".join(pack.plain(POINTS, block["at"], block["size"]))
            width = 4 * pack.dim
            vectors = b"".join(pack.plain(VECTORS, block["row"] * width, block["rows"] * width))
            if hashlib.sha256(lines + vectors).hexdigest() != block["sha256"]:
                raise PackError(f"{pack.path}: block {k} has another digest than the manifest")
            each = lines.split(b"\n")[:-1]
            if len(each) != block["rows"]:
                raise PackError(f"{pack.path}: block {k} has {len(each)} lines for {block['rows']} points")
            for a in range(0, len(each), self.rows):
                own = each[a : a + self.rows]
                yield batch_of(pack.path, block["row"] + a, own, vectors[a * width : (a + len(own)) * width], pack.dim, self.check_ids)

    def _whole(self, pack: Pack) -> Iterator[pa.RecordBatch]:
        if found := pack.problems():
            raise PackError("; ".join(found))
        at, held, width = 0, [], 4 * pack.dim

        def given() -> pa.RecordBatch:
            vectors = b"".join(pack.plain(VECTORS, at * width, len(held) * width)) if not pack.places[VECTORS].deflated else self._deflated(pack, at * width, len(held) * width)
            return batch_of(pack.path, at, held, vectors, pack.dim, self.check_ids)

        with zipfile.ZipFile(self._again(pack)) as z, z.open(POINTS) as points:
            for line in lines_of(iter(lambda: points.read(STEP), b"")):
                if line.strip():
                    held.append(line)
                if len(held) == self.rows:
                    if at + len(held) > pack.count:
                        break
                    yield given()
                    at, held = at + len(held), []
        if at + len(held) != pack.count:
            raise PackError(f"{pack.path}: {at + len(held)} points or more, the manifest says {pack.count}")
        if held:
            yield given()

    def _again(self, pack: Pack):
        return store_of(self.address)[0].open_input_file(pack.path)

    def _deflated(self, pack: Pack, start: int, size: int) -> bytes:
        """A range of a deflated entry: the stream is kept open, as ranges follow each other."""
        if not hasattr(self, "_stream"):
            self._stream = zipfile.ZipFile(self._again(pack)).open(VECTORS)
        return self._stream.read(size)


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    folder: str
    task: int
    rows: int

    def __init__(self, folder: str, task: int, rows: int):
        self.folder, self.task, self.rows = folder, task, rows


@dataclass
class Spool:
    """Blocks of one task that are finished: two files and a line of the state each."""

    store: object
    folder: str
    blocks: list[dict] = field(default_factory=list)
    crc: list[int] = field(default_factory=lambda: [0, 0])
    raw: int = 0
    books: dict = field(default_factory=dict)
    dim: int = 0

    def load(self) -> None:
        """What an earlier try of this task finished."""
        from pyarrow import fs

        k = 0
        while self.store.get_file_info(f"{self.folder}/{k:08}.json").type == fs.FileType.File:
            with self.store.open_input_file(f"{self.folder}/{k:08}.json") as f:
                self.blocks.append(json.loads(f.read()))
            k += 1

    def put(self, name: str, data: bytes) -> None:
        """Written aside, then named: what has its name is whole."""
        aside = f"{self.folder}/{name}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(aside) as f:
            f.write(data)
        self.store.move(aside, f"{self.folder}/{name}")

    def add(self, k: int, lines: bytes, vectors: bytes, rows: int, books: dict) -> None:
        """Finish block k, or see that it was finished with the same rows."""
        digest = hashlib.sha256(lines + vectors).hexdigest()
        if k < len(self.blocks):
            if self.blocks[k]["sha256"] != digest:
                raise PackError(f"{self.folder} holds other rows than these: this is another job")
        else:
            deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = deflate.compress(lines) + deflate.flush(zlib.Z_FULL_FLUSH)
            self.put(f"{k:08}.points", data)
            self.put(f"{k:08}.vectors", vectors)
            self.blocks.append({"rows": rows, "size": len(data), "sha256": digest})
            self.put(f"{k:08}.json", json.dumps(self.blocks[k]).encode())
        self.crc = [zlib.crc32(lines, self.crc[0]), zlib.crc32(vectors, self.crc[1])]
        self.raw += len(lines)
        for book, n in books.items():
            self.books[book] = self.books.get(book, 0) + n

    def parts(self, kind: str) -> Iterator[bytes]:
        for k in range(len(self.blocks)):
            with self.store.open_input_stream(f"{self.folder}/{k:08}.{kind}") as f:
                while data := f.read(STEP):
                    yield data

    def digest(self, kind: str) -> str:
        digest, inflate = hashlib.sha256(), zlib.decompressobj(-15)
        for data in self.parts(kind):
            digest.update(inflate.decompress(data) if kind == "points" else data)
        return digest.hexdigest()


class ZipOut:
    """A ZIP file whose entries come ready made, so that a deflate stream keeps its flushes.  Times are fixed: the same rows, the same bytes."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def entry(self, name: str, parts: Iterator[bytes], method: int, crc: int, size: int, raw: int) -> None:
        encoded, began = name.encode(), self.at
        wide = struct.pack("<HHQQ", 1, 16, raw, size)
        self.write(struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0x800, method, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(encoded), len(wide)) + encoded + wide)
        start = self.at
        for data in parts:
            self.write(data)
        if self.at - start != size:
            raise PackError(f"{name}: {self.at - start} bytes where {size} were to be")
        self.entries.append((encoded, method, crc, size, raw, began))

    def close(self) -> None:
        began = self.at
        for encoded, method, crc, size, raw, at in self.entries:
            wide = struct.pack("<HHQQQ", 1, 24, raw, size, at)
            self.write(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0x800, method, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(encoded), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + encoded + wide)
        size, n = self.at - began, len(self.entries)
        end = self.at
        self.write(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, began))
        self.write(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
        self.write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class PackWriter(DataSourceArrowWriter):
    """Options: path, job (the name under which it can be resumed), blockRows, and profile, id_rule, embedding and target (JSON) for the manifest."""

    def __init__(self, options: dict, overwrite: bool):
        self.address, self.overwrite = options["path"], overwrite
        self.job = options.get("job") or uuid.uuid4().hex
        self.rows = int(options.get("blockrows", 4096))
        self.facts = {"profile": options.get("profile", "sop"), "id_rule": options.get("id_rule", "sop/seq")}
        self.facts |= {k: json.loads(options[k]) for k in ("embedding", "target") if k in options}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, root = store_of(self.address)
        folder = posixpath.join(root, "_spool", self.job, f"{task:05}")
        store.create_dir(folder, recursive=True)
        spool = Spool(store, folder)
        spool.load()
        k = rows = 0
        for lines, vectors, n, books in self._cut(iterator, spool):
            spool.add(k, lines, vectors, n, books)
            k, rows = k + 1, rows + n
        if k < len(spool.blocks):
            raise PackError(f"{folder} holds more rows than these: this is another job")
        if rows:
            self._assemble(spool, rows)
        return Written(folder, task, rows)

    def _cut(self, batches: Iterator[pa.RecordBatch], spool: Spool) -> Iterator[tuple[bytes, bytes, int, dict]]:
        """Blocks of so many rows, however the batches come."""
        lines, vectors, books = io.BytesIO(), io.BytesIO(), {}
        n = 0
        for batch in batches:
            columns = {k.lower(): batch.column(i) for i, k in enumerate(batch.schema.names)}
            if missing := {"uid", "id", "payload", "vector"} - set(columns):
                raise PackError(f"a pack needs the column {min(missing)}")
            for uid, id_, payload, vector in zip(*[columns[c].to_pylist() if c != "vector" else columns[c] for c in ("uid", "id", "payload", "vector")], strict=True):
                values = np.asarray(vector.values if vector.is_valid else [], "<f4")
                spool.dim = spool.dim or len(values)
                if not len(values) or len(values) != spool.dim or uid is None or id_ is None or payload is None:
                    raise PackError(f"{uid}: every point needs uid, id, payload and a vector of {spool.dim} numbers")
                known = json.loads(payload)
                book = (str(known.get("lang")), str(known.get("book_code") or known.get("bible")))
                books[book] = books.get(book, 0) + 1
                lines.write(json.dumps({"uid": uid, "id": id_, "payload": known}, ensure_ascii=False).encode() + b"\n")
                vectors.write(values.tobytes())
                n += 1
                if n == self.rows:
                    yield lines.getvalue(), vectors.getvalue(), n, books
                    lines, vectors, books, n = io.BytesIO(), io.BytesIO(), {}, 0
        if n:
            yield lines.getvalue(), vectors.getvalue(), n, books

    def _assemble(self, spool: Spool, rows: int) -> None:
        index, at, row = [], 0, 0
        for b in spool.blocks:
            index.append({"row": row, "rows": b["rows"], "at": at, "size": b["size"], "sha256": b["sha256"]})
            at, row = at + b["size"], row + b["rows"]
        books = [{"lang": lang, "book_code": code, "points": n} for (lang, code), n in sorted(spool.books.items())]
        manifest = {"schema": "pack/2", **self.facts, "counts": {"points": rows, "books": len(books), "dim": spool.dim, "points_bytes": spool.raw}}
        manifest |= {"sha256": {POINTS: spool.digest("points"), VECTORS: spool.digest("vectors")}, "books": books, "blocks": index}
        text = json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=1).encode()
        aside = f"{spool.folder}/pack.{uuid.uuid4().hex}"
        with spool.store.open_output_stream(aside) as out:
            z = ZipOut(out)
            z.entry(MANIFEST, iter([text]), 0, zlib.crc32(text), len(text), len(text))
            z.entry(POINTS, self._ended(spool), 8, spool.crc[0], at + 2, spool.raw)
            z.entry(VECTORS, spool.parts("vectors"), 0, spool.crc[1], 4 * rows * spool.dim, 4 * rows * spool.dim)
            z.close()
        spool.store.move(aside, f"{spool.folder}/whole")

    def _ended(self, spool: Spool) -> Iterator[bytes]:
        """The flushes leave the deflate stream open; an empty last block ends it."""
        yield from spool.parts("points")
        yield b"\x03\x00"

    def commit(self, messages: list[Written | None]) -> None:
        """All tasks have ended: their packs get their names, then the spool goes."""
        store, root = store_of(self.address)
        names = set()
        for m in messages:
            if m is not None and m.rows:
                name = f"part-{m.task:05}-{self.job}.pack"
                store.move(f"{m.folder}/whole", posixpath.join(root, name))
                names.add(name)
        if self.overwrite:
            for old in packs_at(self.address):
                if posixpath.basename(old) not in names:
                    store.delete_file(old)
        spool = posixpath.join(root, "_spool", self.job)
        if any(m is not None for m in messages):
            store.delete_dir(spool)

    def abort(self, messages: list[Written | None]) -> None:
        """The spool stays, so that the job can be resumed under its name; nothing of it is seen by readers."""


class PackSource(DataSource):
    """Points in packs: file, n (place in the file), uid, id, payload (JSON) and vector."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackReader:
        return PackReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(dict(self.options), overwrite)


def read_packs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The points of a pack or of a folder of packs.  Options: rows of a batch, blocksPerPartition, verifyIds."""
    spark.dataSource.register(PackSource)
    reader = spark.read.format("pack")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def write_packs(points: DataFrame, path: str, job: str | None = None, mode: str = "append", **options: str) -> None:
    """Write uid, id, payload and vector as one pack for each partition.  A run under the name of one that failed goes on where it ended."""
    points.sparkSession.dataSource.register(PackSource)
    writer = points.select("uid", "id", "payload", "vector").write.format("pack").mode(mode)
    for k, v in ({"job": job} if job else {}).items() | options.items():
        writer = writer.option(k, v)
    writer.save(path)


def pack_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) for everything wrong with the packs of a folder; each is read once by one task, a step at a time."""
    files = [(f,) for f in packs_at(path)]
    store = "file string, problem string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                try:
                    found = Pack(store_of(path)[0], file).problems()
                except PackError as e:
                    found = [str(e)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array(found, pa.string())], names=["file", "problem"])

    return spark.createDataFrame(files, "file string").repartition(max(1, len(files))).mapInArrow(task, store)
