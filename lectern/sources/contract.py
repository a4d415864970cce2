"""Contracts, payloads and sidecar files: small things that the driver reads."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: Payload keys by profile: those that must be there (null or not), and those that may.
REQUIRED = {"sop": ("lang", "book_code", "book_pair", "page", "para", "para_key", "raw_text", "aligned"), "bible": ("bible", "osis", "text")}
OPTIONAL = {"sop": ("corpus", "author", "title", "year", "slug", "page_kind", "chunk", "chunks", "bible_refs"), "bible": ("canonical_osis", "versification_offset")}
TEXT = {"sop": "raw_text", "bible": "text"}
#: Options that each kind of source needs and may have.
NEEDED_OPTIONS = {"text": {"book_code", "lang", "title"}, "markdown": {"book_code", "lang", "title"}, "epub": {"lang"}, "sop_json": set(), "bible_json": {"bible", "lang"}}
EMBEDDING_KEYS = ("model", "dim", "distance", "normalized", "pooling", "passage_prefix", "query_prefix")


@dataclass(frozen=True)
class Contract:
    """An embedding space and what texts must be like to enter it."""

    name: str
    embedding: dict
    limits: T.Limits
    pack_min_cosine: float
    probe_min_cosine: float

    @property
    def fingerprint(self) -> str:
        """Digest of the embedding block, keys sorted: two contracts agree if it does."""
        return hashlib.sha256(json.dumps(self.embedding, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load_contract(path: str | Path) -> Contract:
    raw = tomllib.loads(Path(path).read_text())
    chunker, calibration = raw.get("chunker", {}), raw.get("calibration", {})
    known = {f: chunker[f] for f in ("max_words", "target_words", "min_words") if f in chunker}
    return Contract(raw.get("contract", {}).get("id", Path(path).parent.name), raw.get("embedding", {}), T.Limits(**known), calibration.get("pack_min_cosine", 0.9999), calibration.get("probe_min_cosine", 0.95))


def embedding_differences(ours: dict, theirs: dict, keys: tuple[str, ...] = EMBEDDING_KEYS) -> list[str]:
    return [f"{k}: {theirs.get(k)!r} is not {ours.get(k)!r}" for k in keys if ours.get(k) != theirs.get(k)]


def payload_problems(profile: str, present: Column, payload_text: Column) -> Column:
    """Missing keys, unknown keys and an empty text, as a list of problems."""
    required, known = REQUIRED[profile], REQUIRED[profile] + OPTIONAL[profile]
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), present), lambda k: F.concat(F.lit("missing "), k))
    unknown = F.transform(F.array_except(present, F.array(*map(F.lit, known))), lambda k: F.concat(F.lit("unknown "), k))
    blank = F.when(F.coalesce(T.stripped(payload_text), F.lit("")) == "", F.array(F.lit("empty text"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.concat(missing, unknown, blank))


def payload(profile: str, columns: list[str]) -> Column:
    """A block as the JSON text of its payload, from columns named as the profile's keys.

    Required keys stand there even if null or no column; optional ones only where they have a value, and the place of a
    piece only where its paragraph has several.
    """
    several = F.col("chunks") > 1 if "chunks" in columns else F.lit(False)
    there = lambda k: F.when(several, F.col(k)) if k in ("chunk", "chunks") else F.col(k)
    required = F.struct(*[(F.col(k) if k in columns else F.lit(None).cast("string")).alias(k) for k in REQUIRED[profile]])
    made = F.to_json(required, {"ignoreNullFields": "false"})
    known = [k for k in OPTIONAL[profile] if k in columns]
    if not known:
        return made
    rest = F.to_json(F.struct(*[there(k).alias(k) for k in known]), {"ignoreNullFields": "true"})
    return F.when(rest == "{}", made).otherwise(F.concat(F.substr(made, F.lit(1), F.length(made) - 1), F.lit(","), F.substr(rest, F.lit(2))))


def sidecar(source: str | Path) -> dict:
    """Options from '<source>.meta.toml', if it is there."""
    path = Path(f"{source}.meta.toml")
    return tomllib.loads(path.read_text()) if path.exists() else {}


def merged_options(explicit: dict, from_file: dict) -> dict:
    """Both together; an option that both give differently is an error."""
    for k in explicit.keys() & from_file.keys():
        if explicit[k] != from_file[k]:
            raise ValueError(f"{k}: {explicit[k]!r} was asked for, the file beside the source says {from_file[k]!r}")
    return from_file | explicit


def missing_options(kind: str, options: dict) -> list[str]:
    return sorted(NEEDED_OPTIONS[kind] - {k for k, v in options.items() if v not in (None, "")})
