"""Imports that can be resumed: files as a stream into a store, each batch exactly once.

The ledger of a job, its input and the last batch that went in, is part of the pointer that makes a version count.  A batch and its
entry thus become visible together or not at all: a crash before the pointer leaves neither, and one after it leaves a
batch that the stream gives again and that is then passed over.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.store import CorpusStore


class OtherInput(ValueError):
    """A job is resumed with another input than it began with."""


def fingerprint_of(folder: str, schema: StructType, contract: str = "") -> str:
    """What makes an input the same: where it is, what its rows are like, and the embedding contract of its vectors."""
    return hashlib.sha256(json.dumps([folder.rstrip("/"), schema.jsonValue(), contract], sort_keys=True).encode()).hexdigest()


def ledger(store: CorpusStore, job: str) -> dict | None:
    """The job's input, last batch and number of batches with rows; None if it never began."""
    return store.told("imports").get(job)


def begin(store: CorpusStore, job: str, fingerprint: str) -> None:
    """Enter the job, or see that it was entered with the same input."""

    def entered(state: dict) -> dict:
        jobs = state.get("imports") or {}
        known = jobs.get(job)
        if known is None:
            return {"imports": jobs | {job: {"input": fingerprint, "batch": -1, "written": 0}}}
        if known["input"] != fingerprint:
            raise OtherInput(f"job {job} began with another input")
        return {}

    store.note(entered)


def write_batch(store: CorpusStore, job: str, fingerprint: str, rows: DataFrame, batch: int) -> bool:
    """Put a batch in once, whoever asks how often; tells whether it was put in now."""

    def counted(state: dict) -> dict | None:
        jobs = state.get("imports") or {}
        known = jobs.get(job)
        if known is None or known["input"] != fingerprint:
            raise OtherInput(f"job {job} began with another input")
        if batch <= known["batch"]:
            return None
        return {"imports": jobs | {job: {"input": fingerprint, "batch": batch, "written": known["written"] + 1}}}

    return store.upsert(rows, counted) is not None


def import_files(
    spark: SparkSession, folder: str, schema: StructType, store: CorpusStore, job: str, checkpoint: str, contract: str = "", make: Callable[[DataFrame], DataFrame] = lambda rows: rows, files: int | None = None
) -> StreamingQuery:
    """Import what stands in a folder of Parquet files and has not been imported by this job yet, then stop.

    The same call goes on after a crash at any place, and later takes files that came since.  `make` turns the rows of a batch into points;
    `files` bounds the files of one batch.  An input other than the job's first is refused before anything is read.
    """
    fingerprint = fingerprint_of(folder, schema, contract)
    begin(store, job, fingerprint)
    if contract:
        store.check_fingerprint(contract)
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)

    def put(rows: DataFrame, batch: int) -> None:
        write_batch(store, job, fingerprint, make(rows), batch)

    return reader.parquet(folder).writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{job}").trigger(availableNow=True).start()
