"""Versioned tables: every change is a new version, and a numbered pointer says which versions count.

A version is written whole before its pointer is made, and pointers are made anew under the next number, never
replaced: the highest one that can be read counts.  A crash at any step leaves the pointer before, and with it
all data; the version before is the undo.  One writer at a time: a lock file, made atomically by the file system,
refuses the second until it is older than `stale` seconds, after which its writer counts as dead.  The lock holds its owner's
name: a writer that was taken for dead makes no pointer and takes nobody else's lock away.

Rows are dealt into parts by a hash of their key or, with `by`, by a hash of these columns and, inside each of its groups of `spread` parts, of
the key: a language and book then has a few parts of its own, which is all that read_only() opens, and a hot one is still in several.
A key must always come with the same values of `by`.  A change writes the parts it touches; a version is a list of part folders,
old ones and new.  Inside a part rows are ordered by the columns `order`, so that filters on these skip row groups.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Busy(RuntimeError):
    """Another writer holds the table."""


class CorpusStore:
    """A table of points under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", keep: int = 5, parts: int = 64, order: tuple[str, ...] = (), stale: float = 24 * 3600, by: tuple[str, ...] = (), spread: int = 8):
        self.spark, self.path, self.key, self.keep, self.parts, self.order, self.stale = spark, path.rstrip("/"), key, keep, parts, order, stale
        self.by, self.spread = tuple(by), min(spread, parts) if by else parts
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ---- pointers

    def _pointers(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[8:-5]) for n in names if n.startswith("pointer-") and n.endswith(".json"))

    def _read_pointer(self, number: int) -> dict | None:
        try:
            stream = self._fs.open(self._path(f"pointer-{number}.json"))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        except Exception:  # a torn or vanished pointer does not count
            return None

    def _state(self) -> dict:
        for number in reversed(self._pointers()):
            state = self._read_pointer(number)
            if state is not None:
                return state
        return {"number": -1, "versions": [], "next": 0, "fingerprint": None, "width": self.parts, "by": list(self.by), "spread": self.spread, "schema": None}

    def _point(self, state: dict) -> None:
        """Make the next pointer: written aside, then renamed to a name that is free.  Then old pointers go."""
        number = max([state["number"], *self._pointers()]) + 1
        fresh = self._path(f"fresh-{uuid.uuid4().hex}")
        stream = self._fs.create(fresh, True)
        stream.write(json.dumps(state | {"number": number}).encode())
        stream.close()
        if not self._fs.rename(fresh, self._path(f"pointer-{number}.json")):
            raise OSError(f"cannot make pointer {number} of {self.path}")
        for old in self._pointers()[:-3]:
            self._fs.delete(self._path(f"pointer-{old}.json"), False)

    # ---- lock

    @contextmanager
    def _locked(self) -> Iterator[str]:
        """Hold the lock; gives the owner's name."""
        lock, owner = self._path("LOCK"), uuid.uuid4().hex
        self._fs.mkdirs(self._path(""))
        try:
            age = time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000
            if age > self.stale:  # its writer died; what it wrote is in no pointer
                self._fs.delete(lock, False)
        except Exception:  # there is none
            pass
        try:
            stream = self._fs.create(lock, False)
        except Exception as e:
            raise Busy(self.path) from e
        stream.write(owner.encode())
        stream.close()
        try:
            yield owner
        finally:
            if self._owner() == owner:
                self._fs.delete(lock, True)

    def _owner(self) -> str | None:
        try:
            stream = self._fs.open(self._path("LOCK"))
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        except Exception:  # nobody
            return None

    def _renew(self, owner: str) -> None:
        """Before what cannot be taken back: the lock must still be ours, and is young again."""
        if self._owner() != owner:
            raise Busy(f"{self.path}: the lock was taken by another writer")
        self._fs.setTimes(self._path("LOCK"), int(time.time() * 1000), -1)

    def break_lock(self) -> None:
        """Take away the lock of a writer that is known to be dead."""
        self._fs.delete(self._path("LOCK"), False)

    # ---- reading

    def versions(self) -> list[int]:
        return [v["number"] for v in self._state()["versions"]]

    def _table(self, state: dict, parts: list[int] | None = None) -> DataFrame | None:
        if not state["versions"]:
            return None
        folders = {int(k): v for k, v in state["versions"][-1]["parts"].items()}
        chosen = sorted({v for k, v in folders.items() if parts is None or k in parts})
        schema = StructType.fromJson(state["schema"])
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/{v}") for v in chosen]
        if not frames:
            return self.spark.createDataFrame([], schema)
        # A folder may hold parts that newer folders have replaced.
        made = None
        for folder, frame in zip(chosen, frames, strict=True):
            own = [k for k, v in folders.items() if v == folder and (parts is None or k in parts)]
            frame = frame.where(F.col("_part").isin(own))
            made = frame if made is None else made.unionByName(frame)
        return made

    def read(self) -> DataFrame | None:
        """The current points; None before the first write."""
        table = self._table(self._state())
        return None if table is None else table.drop("_part")

    def read_only(self, **values) -> DataFrame | None:
        """The current points with these values in the columns `by`, from the parts that can hold them; null matches nothing."""
        if set(values) != set(self.by) or not values:
            raise ValueError(f"a value is needed for each of {list(self.by)}")
        state = self._state()
        group = self.spark.range(1).select(self._group(state, *[F.lit(values[c]) for c in self.by])).first()[0]
        table = self._table(state, list(range(group * state["spread"], (group + 1) * state["spread"])))
        if table is None:
            return None
        for c in self.by:
            table = table.where(F.col(c) == F.lit(values[c]))
        return table.drop("_part")

    # ---- writing

    def _part(self, state: dict) -> Column:
        width, by, spread = state["width"], state.get("by") or [], state.get("spread") or state["width"]
        if by != list(self.by):
            raise ValueError(f"{self.path} is dealt by {by or [self.key]}")
        own = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(spread if by else width))
        return (self._group(state, *[F.col(c) for c in by]) * spread + own).cast("int") if by else own.cast("int")

    def _group(self, state: dict, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*[v.cast("string") for v in values]), F.lit(max(1, state["width"] // state["spread"])))

    def _commit(self, make: Callable[[DataFrame | None], DataFrame], touched: DataFrame | None = None, note: Callable[[dict], dict | None] = lambda state: {}) -> int | None:
        """Write a version: all parts, or those of the keys in `touched`.  `note` sees the state under the lock and gives what else the
        new pointer says, or None if there is nothing to do."""
        with self._locked() as owner:
            state = self._state()
            said = note(state)
            if said is None:
                return None
            version, part = state["next"], self._part(state)
            parts = None
            if touched is not None and state["versions"]:
                parts = sorted(r[0] for r in touched.select(part).distinct().collect())  # no more than the table has
            old = self._table(state, parts)
            folder = f"v{version}-{uuid.uuid4().hex[:8]}"
            made = make(None if old is None else old.drop("_part"))
            rows = made.withColumn("_part", part).repartition("_part").sortWithinPartitions("_part", *self.order)
            rows.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
            before = state["versions"][-1]["parts"] if state["versions"] and parts is not None else {}
            filled = [int(s.getPath().getName()[6:]) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("_part=")]
            current = {k: v for k, v in before.items() if int(k) not in (parts or [])} | {str(k): folder for k in filled}
            versions = [*state["versions"], {"number": version, "parts": current}][-self.keep :]
            self._renew(owner)
            self._point(state | said | {"versions": versions, "next": version + 1, "schema": rows.schema.jsonValue()})
            self._sweep(state, versions)
            return version

    def _sweep(self, state: dict, versions: list[dict]) -> None:
        """Delete folders that the version dropped last has alone; readers keep `keep` versions of time."""
        used = {folder for v in versions for folder in v["parts"].values()}
        for folder in {f for v in state["versions"] for f in v["parts"].values()} - used:
            self._fs.delete(self._path(folder), True)

    def upsert(self, rows: DataFrame, note: Callable[[dict], dict | None] = lambda state: {}) -> int | None:
        """Rows replace those of the same key; of repeated keys in `rows` the last by all columns stays.  Returns the new version."""
        rows = one_of_each(rows, self.key)
        return self._commit(lambda old: rows if old is None else merged(old, rows, self.key), rows, note)

    def note(self, note: Callable[[dict], dict | None]) -> None:
        """Add to what the pointer says, without a new version."""
        with self._locked() as owner:
            state = self._state()
            said = note(state)
            if said:
                self._renew(owner)
                self._point(state | said)

    def told(self, key: str) -> dict:
        """What was noted under a key."""
        return self._state().get(key) or {}

    def delete(self, where: Column) -> int:
        """Delete what matches; a condition that is null does not match."""
        return self._commit(lambda old: old.where(~F.coalesce(where, F.lit(False))))

    def delete_ids(self, ids: DataFrame) -> int:
        return self._commit(lambda old: old.join(ids.select(self.key), self.key, "left_anti"), None if self.by else ids)

    def rollback(self) -> int:
        """Back to the version before; returns it."""
        with self._locked():
            state = self._state()
            if len(state["versions"]) < 2:
                raise ValueError("there is no version to go back to")
            versions = state["versions"][:-1]
            self._point(state | {"versions": versions})
            self._sweep(state, versions)
            return versions[-1]["number"]

    def dry_run(self, rows: DataFrame) -> dict[str, int]:
        """What an upsert would do, counted on a scratch version that always goes again."""
        scratch = f"dryrun-{uuid.uuid4().hex}"
        try:
            old = self.read()
            rows = one_of_each(rows, self.key)
            (rows if old is None else merged(old, rows, self.key)).write.parquet(f"{self.path}/{scratch}")
            after, new = self.spark.read.parquet(f"{self.path}/{scratch}").count(), rows.count()
            before = 0 if old is None else old.count()
            return {"new": after - before, "overwritten": new - (after - before), "total": after}
        finally:
            self._fs.delete(self._path(scratch), True)

    def check_fingerprint(self, fingerprint: str) -> None:
        """Remember the embedding contract at first; later refuse another."""

        def first(state: dict) -> dict:
            if state["fingerprint"] not in (None, fingerprint):
                raise ValueError("these vectors come from another embedding contract")
            return {} if state["fingerprint"] else {"fingerprint": fingerprint}

        self.note(first)


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: the largest by the other columns, so that the choice does not depend on partitions."""
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    return rows.groupBy(key).agg(F.max(F.struct(*others)).alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.`{c}`") for c in rows.columns])


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
