"""A folder of sources as one table of blocks and one of problems.

The folder is listed once.  Each file goes to the parser of its kind, all files of a kind together, and the parsers' tables have
one schema.  What stands beside a source, `<source>.meta.toml`, is joined to it; whatever is wrong with a file or its sidecar
is a row, and the other files are read all the same.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import books, texts

SIDECAR = ".meta.toml"
#: What a sidecar or a caller may say of a book (fixed values); those in NEEDED a book must have in the end.
FIELDS = ("book_code", "lang", "title", "author", "year", "corpus", "slug", "book_pair", "acquired_from", "rights")
NEEDED = ("book_code", "lang", "title")
PLACES = ("pos", "para_key", "page", "para", "seq", "chunk", "chunks", "text", "words")


def _toml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sidecars (file, text) as maps of their values as text; one that is no TOML has the key '!' alone."""

    def one(t: str | None) -> list[tuple[str, str]]:
        try:
            return [(k, str(v)) for k, v in tomllib.loads(t or "").items()]
        except tomllib.TOMLDecodeError as e:
            return [("!", str(e))]

    for batch in batches:
        said = pa.array([one(t) for t in batch.column(1).to_pylist()], pa.map_(pa.string(), pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), said], names=["file", "said"])


def listing(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files of a folder by the kind that their names tell: text, markdown, json, epub and sidecar.  Names only; nothing is opened."""
    found: dict[str, list[str]] = {k: [] for k in ("text", "markdown", "json", "epub", "sidecar")}
    kind = texts.kind_of(F.col("path"), F.array().cast("array<string>"))
    named = spark.read.format("binaryFile").load(path).select("path", F.when(F.col("path").endswith(SIDECAR), "sidecar").when(kind == "sop_json", "json").otherwise(kind).alias("kind"))
    for row in named.orderBy("path").toLocalIterator():
        found[row.kind].append(row.path)
    return found


def _whole(spark: SparkSession, files: list[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], "file string, text string")
    return spark.read.text([f.replace("file:///", "/") if f.startswith("file:///") else f for f in files], wholetext=True).select(_name(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def _name(path: Column) -> Column:
    """One spelling of a file's address: without escapes, and without the slashes of an empty host."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, "\\+", "%2B")), "^file:/+", "file:/")


def _ours(df: DataFrame, kind: str, **fields: Column) -> DataFrame:
    """The common columns of a parser's table; fields that the source itself gives, and null for the others."""
    own = [fields.get(f, F.lit(None)).cast("bigint" if f == "year" else "string").alias(f) for f in FIELDS]
    places = [F.col(c).cast("string" if c in ("para_key", "text") else "bigint").alias(c) for c in PLACES]
    return df.select("file", fields.get("kind", F.lit(kind)).alias("kind"), *own, fields.get("page_kind", F.lit(None)).cast("string").alias("page_kind"), *places)


def _paragraphs(found: DataFrame, kind: str, limits: T.Limits) -> DataFrame:
    return _ours(texts.book_blocks(texts.gated(found, limits), "file", limits), kind, page_kind=F.lit("chapter"))


def _epub(spark: SparkSession, files: list[str], limits: T.Limits) -> tuple[DataFrame, DataFrame]:
    pages = texts.read_epub(spark, files, strict=False).withColumn("file", _name(F.col("file")))
    made, pieces, _ = books.epub_books(pages.where("problem is null"), limits)
    rows = pieces.join(made.select("file", "book_code", "title", "author", "year", "rights", "page_kind"), "file")
    bad = pages.where("problem is not null").select("file", F.lit("damaged").alias("problem"), F.col("problem").alias("detail"))
    of = {c: F.col(c) for c in ("book_code", "title", "author", "year", "rights", "page_kind")}
    return _ours(rows, "epub", **of, lang=F.lit("en")), bad


def _json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = F.map_keys(F.from_json("text", "MAP<STRING,STRING>"))
    known = files.withColumn("kind", F.when(keys.isNotNull(), texts.kind_of(F.col("file"), keys)))
    keyed = texts.sop_json_blocks(known.where("kind = 'sop_json'").select("file", "text"))
    order = F.row_number().over(Window.partitionBy("file").orderBy("page", "para", "para_key"))
    one = {"seq": F.lit(0), "chunk": F.lit(0), "chunks": F.lit(1)}
    keyed = keyed.withColumns({"pos": order, "text": F.col("raw_text"), "words": T.word_count(F.col("raw_text")), **one})
    rows = _ours(keyed, "sop_json", **{c: F.col(c) for c in ("lang", "book_code", "title", "year")}, book_pair=F.col("en_code"), page_kind=F.lit("print"))
    verses = texts.bible_json_verses(known.where("kind = 'bible_json'").select("file", "text"))
    chapter, verse = (F.regexp_extract("osis", r"\.(\d+)\.(\d+)", i).cast("bigint") for i in (1, 2))
    verses = verses.withColumns({"para_key": F.col("osis"), "page": chapter, "para": verse, "words": T.word_count(F.col("text")), **one})
    empty = known.where("kind is not null").select("file").join(rows.select("file").union(verses.select("file")).distinct(), "file", "left_anti")
    bad = known.where("kind is null").select("file", F.lit("damaged").alias("problem"), F.lit("not a JSON object").alias("detail"))
    return rows.unionByName(_ours(verses, "bible_json")), bad.unionByName(empty.select("file", F.lit("empty").alias("problem"), F.lit("").alias("detail")))


def read_folder(spark: SparkSession, path: str, limits: T.Limits = T.Limits(), **explicit: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, problems) of all sources of a folder.

    Blocks have the file, its kind, the fields of its book (what the caller says, else the sidecar, else the source itself) and the columns
    of its pieces.  Problems are (file, problem, detail): 'stale' (a sidecar whose source is gone), 'no TOML', 'unknown option', 'conflict' (the
    caller and the sidecar say different things of a field), 'damaged' (no EPUB, no JSON), 'empty' (JSON without paragraphs), and
    'missing' (a field of NEEDED that nobody gives).  A file with one of the problems of its options gives no blocks, as they would stand
    under a wrong name; blocks of a file that lacks a field come, so that they can be reviewed.
    """
    if unknown := set(explicit) - set(FIELDS):
        raise ValueError(f"no such option: {min(unknown)}")
    found = listing(spark, path)
    plain = _whole(spark, found["text"]), _whole(spark, found["markdown"])
    tables = [_paragraphs(texts.text_blocks(plain[0]), "text", limits), _paragraphs(texts.markdown_blocks(plain[1]), "markdown", limits)]
    wrong = []
    for made, bad in ([_epub(spark, found["epub"], limits)] if found["epub"] else []) + ([_json(_whole(spark, found["json"]))] if found["json"] else []):
        tables.append(made)
        wrong.append(bad)
    blocks = tables[0]
    for t in tables[1:]:
        blocks = blocks.unionByName(t)
    # The names of the sources: as many as the listing has, which the driver holds anyway.
    sources = spark.createDataFrame([(f,) for k in ("text", "markdown", "json", "epub") for f in found[k]], "file string").select(_name(F.col("file")).alias("file"))
    sidecars = _whole(spark, found["sidecar"]).select(F.regexp_replace("file", r"\.meta\.toml$", "").alias("file"), "text").mapInArrow(_toml, "file string, said map<string,string>")
    beside = sources.join(sidecars, "file", "left").withColumn("said", F.coalesce("said", F.create_map().cast("map<string,string>")))
    told = beside.select("file", *[F.col("said")[f].alias(f) for f in FIELDS], F.map_keys("said").alias("keys"), F.col("said")["!"].alias("bad"))
    stale = sidecars.join(sources, "file", "left_anti").select("file", F.lit("stale").alias("problem"), F.lit("").alias("detail"))
    toml = told.where("bad is not null").select("file", F.lit("no TOML").alias("problem"), F.col("bad").alias("detail"))
    odd = told.where("bad is null").select("file", F.lit("unknown option").alias("problem"), F.explode(F.array_except("keys", F.array(*map(F.lit, FIELDS)))).alias("detail"))
    differ = F.array_compact(F.array(*[F.when(F.col(f) != F.lit(str(v)), F.lit(f)) for f, v in explicit.items()])) if explicit else F.array().cast("array<string>")
    conflict = told.select("file", F.lit("conflict").alias("problem"), F.explode(differ).alias("detail"))
    refused = toml.unionByName(odd).unionByName(conflict)
    given = told.select("file", *[F.coalesce(F.lit(explicit.get(f)).cast("string"), F.col(f)).alias(f"_{f}") for f in FIELDS])
    named = blocks.join(given, "file").join(refused.select("file").distinct(), "file", "left_anti")
    named = named.withColumns({f: F.coalesce(F.col(f"_{f}").try_cast("bigint") if f == "year" else F.col(f"_{f}"), F.col(f)) for f in FIELDS}).drop(*[f"_{f}" for f in FIELDS])
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(T.stripped(F.col(f)), F.lit("")) == "", f) for f in NEEDED]))
    heads = named.groupBy("file").agg(*[F.max(f).alias(f) for f in NEEDED])
    problems = refused.unionByName(stale).unionByName(heads.select("file", F.lit("missing").alias("problem"), F.explode(lacking).alias("detail")))
    for bad in wrong:
        problems = problems.unionByName(bad)
    return named, problems
