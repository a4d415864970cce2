"""Books: composed from the pages of an EPUB, and the reviewable JSON file of a book, read and written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus
from . import texts

#: Keys that a book file and each of its blocks must have, in the order in which they are written (fixed values).
TOP = ("schema", "profile", "source", "book", "id_rule", "stats", "blocks")
WRITTEN = ("schema", "profile", "source", "book", "id_rule", "alignment", "stats", "blocks")
BLOCK = ("para_key", "page", "para", "seq", "chunks", "text", "words")
WRITTEN_BLOCK = ("para_key", "page", "para", "seq", "chunk", "chunks", "text", "words")
PROFILES = ("sop", "bible")
BLOCKS = "array<struct<para_key:string,page:bigint,para:bigint,seq:bigint,chunk:bigint,chunks:bigint,text:string,words:bigint>>"
_BLOCK = pa.struct([(k, pa.string() if k in ("para_key", "text") else pa.int64()) for k in WRITTEN_BLOCK])
_BOOK = pa.schema([*((k, pa.string()) for k in ("file", "schema", "profile", "id_rule", "source", "book", "alignment", "stats")), ("blocks", pa.list_(_BLOCK)), ("problems", pa.list_(pa.string()))])
BOOK = f"file string, schema string, profile string, id_rule string, source string, book string, alignment string, stats string, blocks {BLOCKS}, problems array<string>"


# ------------------------------------------------------------------ EPUB


def keyed_pages(blocks: DataFrame, file: str = "file", least: float = 0.4) -> DataFrame:
    """Text blocks of books with the key of each paragraph: page, para, and coded (its key is a printed citation).

    blocks: file, doc_no, pos and text, in the order of doc_no and pos.  A block that is only '[n]' sets the page for all that follows and
    goes.  Where at least the share `least` of the blocks of a book end in a citation of its most frequent code, such a
    citation is cut off and gives page and para.  Any other paragraph is counted on its page, which is the last mark's or, before
    the first mark, the number of its document.  The windows are by book; a book is what one task sorts.
    """
    order = Window.partitionBy(file).orderBy("doc_no", "pos")
    code, cited_page, cited_para, before = T.citation(F.col("text"))
    rows = blocks.withColumn("_at", F.struct("doc_no", "pos"))
    inline = corpus.citation_mode(rows, [file], "_at", least).select(file, F.col("code").alias("inline_code"))
    rows = rows.join(inline, file, "left").withColumns({"_mark": T.page_mark(F.col("text")), "_code": code})
    rows = rows.withColumns({"_marks": F.count("_mark").over(order), "_page": F.last("_mark", ignorenulls=True).over(order), "saw_mark": F.max(F.col("_mark").isNotNull()).over(Window.partitionBy(file))})
    rows = rows.where("_mark is null").withColumn("coded", F.coalesce(F.col("_code") == F.col("inline_code"), F.lit(False)))
    # Before the first mark each document is a page of its own; cited paragraphs take no number there.
    page = Window.partitionBy(file, "_marks", F.when(F.col("_marks") == 0, F.col("doc_no"))).orderBy("doc_no", "pos")
    count = F.sum((~F.col("coded")).cast("int")).over(page)
    made = rows.withColumns(
        {
            "page": F.when(F.col("coded"), cited_page).otherwise(F.coalesce("_page", "doc_no")).cast("int"),
            "para": F.when(F.col("coded"), cited_para).otherwise(count).cast("int"),
            "text": F.when(F.col("coded"), T.stripped(before)).otherwise(F.col("text")),
        }
    )
    return made.drop("_at", "_mark", "_marks", "_page", "_code")


def epub_books(pages: DataFrame, limits: T.Limits = T.Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books from the pages of EPUB files (see texts.read_epub): one row for each book, its pieces, and what the gate dropped.

    Books: file, book_code (the inline code, if there is one), title, author, year, rights, page_kind ('print' if marks or citations
    number the pages, else 'chapter') and the counts of texts.book_stats.  Pieces: file, pos, para_key, page, para, seq, chunk, chunks,
    text, words; a key that a cited and a counted paragraph share goes on counting in seq.
    """
    raw = texts.html_blocks(pages.select("file", "doc_no", "html"))
    keyed = keyed_pages(raw).withColumn("pos", F.col("doc_no").cast("long") * (1 << 32) + F.col("pos"))
    gated = texts.gated(keyed.select("file", "pos", "page", "para", "text"), limits)
    pieces = texts.book_blocks(gated, "file", limits)
    header = pages.groupBy("file").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("title", "creator", "date", "rights")])
    kinds = keyed.groupBy("file").agg(F.first("inline_code", ignorenulls=True).alias("book_code"), F.max("saw_mark").alias("marked"))
    books = header.join(kinds, "file", "left").join(texts.book_stats(gated, pieces, "file"), "file", "left")
    printed = F.coalesce("marked", F.lit(False)) | F.col("book_code").isNotNull()
    books = books.select("file", "book_code", "title", F.col("creator").alias("author"), T.year_of(F.col("date")).alias("year"), "rights", F.when(printed, "print").otherwise("chapter").alias("page_kind"), "blocks_in", "blocks_out", "dropped", "words", "damage")
    return books, pieces, texts.dropped_detail(gated)


# ------------------------------------------------------------------ the file of a book


def _whole(value) -> int:
    """A number as a block has it; a truth value or a fraction is none."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ValueError(value)
    return int(value)


def _block(number: int, b, problems: list[str]) -> dict | None:
    if not isinstance(b, dict):
        problems.append(f"blocks[{number}] is not an object")
        return None
    if missing := [k for k in BLOCK if k not in b]:
        problems.append(f"blocks[{number}] missing key(s): {', '.join(missing)}")
        return None
    try:
        made = {k: _whole(b[k]) for k in ("page", "para", "seq", "chunks", "words")}
        chunk = b.get("chunk")
        return made | {"para_key": str(b["para_key"]), "text": str(b["text"]), "chunk": made["seq"] if chunk is None else _whole(chunk)}
    except ValueError as e:
        problems.append(f"blocks[{number}] has a badly typed field: {e}")
        return None


def parsed(file: str, content: str) -> dict:
    """One book file as a row; what is wrong with it is listed, and what can be read is there."""
    row, problems = dict.fromkeys(("schema", "profile", "id_rule", "source", "book", "alignment", "stats", "blocks")), []
    try:
        data = json.loads(content)
        if not isinstance(data, dict):
            problems, data = ["top level must be a JSON object"], None
    except json.JSONDecodeError as e:
        problems, data = [f"not valid JSON: {e}"], None
    if data is not None:
        if missing := [k for k in TOP if k not in data]:
            problems.append(f"missing required key(s): {', '.join(missing)}")
        schema = data.get("schema")
        if "schema" in data and not (isinstance(schema, str) and schema.endswith(".book/1")):
            problems.append(f"unsupported schema {schema!r}")
        for k in ("source", "book", "stats"):
            if k in data and not isinstance(data[k], dict):
                problems.append(f"'{k}' must be an object")
        if "profile" in data and data["profile"] not in PROFILES:
            problems.append(f"unknown profile {data['profile']!r}")
        if "id_rule" in data and not (isinstance(data["id_rule"], str) and data["id_rule"]):
            problems.append("'id_rule' must be a non-empty string")
        if not isinstance(data.get("alignment"), (dict, type(None))):
            problems.append("'alignment' must be an object or null")
        row |= {k: data[k] if isinstance(data.get(k), str) else None for k in ("schema", "profile", "id_rule")}
        row |= {k: json.dumps(data[k], ensure_ascii=False) if isinstance(data.get(k), dict) else None for k in ("source", "book", "alignment", "stats")}
        if "blocks" in data and not isinstance(data["blocks"], list):
            problems.append("'blocks' must be a list")
        elif "blocks" in data:
            row["blocks"] = [m for i, b in enumerate(data["blocks"]) if (m := _block(i, b, problems))]
    return {"file": file} | row | {"problems": problems}


def load_books(files: DataFrame) -> DataFrame:
    """Book files (file, text) as rows: their parts as JSON text in the order of the file, blocks, and problems.

    A file that is damaged or lacks keys is a row with problems, not a failed job; it still gives the blocks that can be read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([parsed(file, content or "")], schema=_BOOK)

    return files.select("file", "text").mapInArrow(task, BOOK)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return load_books(texts.read_whole(spark, path))


def blocks_of(books: DataFrame) -> DataFrame:
    return books.select("file", F.inline("blocks"))


def dump_books(books: DataFrame) -> DataFrame:
    """(file, text): the same rows as book files, keys in a fixed order, two spaces of indent; load_books gives the rows back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = {k: row[k] if k in ("schema", "profile", "id_rule") else None if row[k] is None else json.loads(row[k]) for k in WRITTEN if k != "blocks"}
                blocks = [{k: b[k] if k in ("para_key", "text") else int(b[k]) for k in WRITTEN_BLOCK} for b in (row["blocks"] if row["blocks"] is not None else [])]
                text = json.dumps(made | {"blocks": blocks}, ensure_ascii=False, indent=2) + "\n"
                yield pa.RecordBatch.from_pydict({"file": [row["file"]], "text": [text]})

    return books.select("file", *WRITTEN).mapInArrow(task, "file string, text string")
