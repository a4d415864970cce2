"""Plain text, Markdown, HTML and keyed JSON as paragraph and verse tables."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import osis
from ..functions import text as T
from ..operators.corpus import chunks_of

BLANK = "\\n\\s*\\n+"
# The markup that is looked at.
SCRIPT = "(?is)<(script|style)\\b.*?</\\1>"
BODY = "(?s)<body[^>]*>(.*)</body>"
BLOCK = "(?is)<(p|h[1-6]|li|blockquote)\\b[^>]*>(.*?)</\\1>"
BREAK = "(?i)<br\\s*/?>"
TAG = "<[^>]+>"


def kind_of(path: Column, keys: Column) -> Column:
    """Source kind by extension; a JSON file is scripture if it has keys and all are verses."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    scripture = (F.size(keys) > 0) & F.forall(keys, osis.is_verse)
    return F.when(ext == "epub", "epub").when(ext.isin("md", "markdown"), "markdown").when((ext == "json") & scripture, "bible_json").when(ext == "json", "sop_json").otherwise("text")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row for each file of a folder or glob."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def text_blocks(files: DataFrame, separator: str = BLANK) -> DataFrame:
    """Paragraphs of plain text: file, page 1, para from 1 (counted before any gate), text."""
    parts = F.filter(F.transform(F.split("text", separator), lambda p: F.regexp_replace(T.stripped(p), "[ \\t]+", " ")), lambda p: p != "")
    rows = files.select(*[c for c in files.columns if c != "text"], F.posexplode(parts).alias("pos", "text"))
    return rows.withColumns({"page": F.lit(1), "para": F.col("pos") + 1, "heading": F.lit(False)})


def markdown_blocks(files: DataFrame, key: str = "file") -> DataFrame:
    """Paragraphs of Markdown: a heading starts a page (the first one page 2), fenced blocks are left out and not counted."""
    parts = F.filter(F.transform(F.split("text", BLANK), T.stripped), lambda p: (p != "") & ~p.startswith("```"))
    rows = files.select(*[c for c in files.columns if c != "text"], F.posexplode(parts).alias("pos", "text"))
    rows = rows.withColumn("heading", F.col("text").rlike("^#{1,6}\\s+"))
    rows = rows.withColumn("page", 1 + F.sum(F.col("heading").cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    para = F.sum((~F.col("heading")).cast("int")).over(Window.partitionBy(key, "page").orderBy("pos"))
    text = F.when(F.col("heading"), T.stripped(F.regexp_replace("text", "^#{1,6}\\s+", ""))).otherwise(F.regexp_replace("text", "[ \\t]+", " "))
    return rows.withColumns({"para": F.when(F.col("heading"), 0).otherwise(para), "text": text})


def carried_pages(blocks: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Page numbers from '[n]' marks: a mark sets the page for what follows and restarts the paragraphs; marks go."""
    w = Window.partitionBy(key).orderBy(order)
    mark = T.page_mark(F.col("text"))
    rows = blocks.withColumn("_mark", mark).withColumn("_group", F.count("_mark").over(w)).withColumn("page", F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.lit(0)))
    rows = rows.where("_mark is null")
    return rows.withColumn("para", F.row_number().over(Window.partitionBy(key, "_group").orderBy(order))).drop("_mark", "_group")


def gated(blocks: DataFrame, limits: T.Limits = T.Limits()) -> DataFrame:
    """Add `reason`: why a paragraph is dropped, in the order heading, boilerplate, numbers, quality; null if it is kept."""
    text = F.col("text")
    reason = F.when(F.col("heading"), "heading") if "heading" in blocks.columns else F.when(F.lit(False), "")
    reason = reason.when(T.is_boilerplate(text), "boilerplate").when(T.is_numeric_line(text), "numeric/TOC line").otherwise(T.gate_message(text, limits))
    return blocks.withColumn("reason", reason)


def dropped_detail(blocks: DataFrame) -> DataFrame:
    """(para_key, reason, preview of 80 characters) of what the gate dropped."""
    return blocks.where("reason is not null").select(*[c for c in blocks.columns if c not in ("reason", "text", "page", "para", "heading", "pos")], F.concat_ws(".", "page", "para").alias("para_key"), "reason", F.substring("text", 1, 80).alias("text"))


def book_blocks(blocks: DataFrame, key: str, limits: T.Limits = T.Limits()) -> DataFrame:
    """Pieces of the kept paragraphs with para_key, chunk, chunks, seq and words."""
    kept = blocks.where("reason is null").withColumn("para_key", F.concat_ws(".", "page", "para")).drop("reason", "heading")
    return chunks_of(kept, [key, "para_key"], ["pos"], limits)


def book_stats(blocks: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """blocks_in, dropped, blocks_out, words and damage of each book; damage from sums, so partial results add up."""
    before = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("blocks_in"), F.count("reason").alias("dropped"))
    bad, n = T.damage_parts(F.col("text"))
    after = pieces.groupBy(key).agg(F.count(F.lit(1)).alias("blocks_out"), F.sum("words").alias("words"), F.sum(bad).alias("_bad"), F.sum(n).alias("_n"))
    joined = before.join(after, key, "left")
    return joined.select(key, "blocks_in", F.coalesce("blocks_out", F.lit(0)).alias("blocks_out"), "dropped", F.coalesce("words", F.lit(0)).alias("words"), F.when(F.col("_n") > 0, F.round(F.col("_bad") / F.col("_n"), 6)).otherwise(F.when(F.col("_n").isNull(), 0.0).otherwise(1.0)).alias("damage"))


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def html_blocks(pages: DataFrame, column: str = "html") -> DataFrame:
    """Text blocks (paragraphs, headings, items, quotations) of HTML pages in order, without scripts and tags."""
    raw = F.regexp_replace(column, SCRIPT, " ")
    body = F.regexp_extract(raw, BODY, 1)
    inner = F.regexp_extract_all(F.when(raw.rlike(BODY), body).otherwise(raw), F.lit(BLOCK), F.lit(2))
    rows = pages.select(*[c for c in pages.columns if c != column], F.posexplode(inner).alias("pos", "text"))
    plain = F.regexp_replace(F.regexp_replace("text", BREAK, " "), TAG, "")
    text = F.trim(F.regexp_replace(decoded(plain), "[\\s\\u00a0]+", " "))
    return rows.withColumn("text", text).where("text <> ''")


EPUB = "file string, doc_no int, href string, html string, title string, creator string, date string, rights string, problem string"
_EPUB = pa.schema([(c, pa.int32() if c == "doc_no" else pa.string()) for c in ("file", "doc_no", "href", "html", "title", "creator", "date", "rights", "problem")])


def _attribute(tag: str, name: str) -> str | None:
    found = re.search(rf'\b{name}="([^"]+)"', tag)
    return found[1] if found else None


def _spine(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """The pages of an EPUB in reading order, and the metadata of its package file."""
    opf = _attribute(book.read("META-INF/container.xml").decode("utf-8", "replace"), "full-path")
    package = book.read(opf).decode("utf-8", "replace")
    items = {_attribute(t, "id"): _attribute(t, "href") for t in re.findall(r"<item\b[^>]*>", package)}
    names = set(book.namelist())
    pages = []
    for ref in re.findall(r"<itemref\b[^>]*>", package):
        href = items.get(_attribute(ref, "idref"))
        path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href)) if href else ""
        if path in names and re.search(r"(?i)\.x?html?$", path):
            pages.append((path, book.read(path).decode("utf-8", "replace")))
    meta: dict[str, str] = {}
    try:
        for element in ElementTree.fromstring(package.encode()).iter():
            name = str(element.tag).removeprefix("{http://purl.org/dc/elements/1.1/}")
            if name in ("title", "creator", "date", "rights") and (element.text or "").strip():
                meta.setdefault(name, element.text.strip())
    except ElementTree.ParseError:
        pass
    return pages, meta


def read_epub(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """(file, doc_no, href, html, title, creator, date, rights, problem) of the pages of EPUB files, in reading order.

    A file that is none fails the job or, if not `strict`, is one row with a problem and no page.  A book is opened by one task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as book:
                        pages, meta = _spine(book)
                except (zipfile.BadZipFile, KeyError, TypeError) as e:
                    if strict:
                        raise
                    yield pa.RecordBatch.from_pylist([{"file": file, "doc_no": 0, "problem": f"not an EPUB: {e}"}], schema=_EPUB)
                    continue
                facts = {k: meta.get(k) for k in ("title", "creator", "date", "rights")}
                yield pa.RecordBatch.from_pylist([{"file": file, "doc_no": i + 1, "href": href, "html": page} | facts for i, (href, page) in enumerate(pages)], schema=_EPUB)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(task, EPUB)


def sop_json_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs of keyed JSON {meta, <lang>: {key: {text}}, en_reverse}; the language is the folder's name."""
    lang = F.regexp_extract("file", "([^/]+)/[^/]+$", 1)
    stem = F.regexp_extract("file", "([^/]+)\\.[^./]+$", 1)
    parsed = F.from_json("text", "MAP<STRING,STRING>")
    rows = files.withColumns({"lang": lang, "_j": parsed}).withColumn("_meta", F.from_json(F.col("_j")["meta"], "MAP<STRING,STRING>"))
    code = F.coalesce(T.truthy(F.element_at("_meta", F.concat("lang", F.lit("_code")))), T.truthy(F.col("_meta")["en_code"]), stem)
    title = F.coalesce(T.truthy(F.element_at("_meta", F.concat("lang", F.lit("_title")))), T.truthy(F.col("_meta")["en_title"]))
    year = F.when(F.col("_meta")["year"].rlike("^[0-9]+$"), F.col("_meta")["year"].try_cast("long"))
    body = F.from_json(F.element_at("_j", F.col("lang")), "MAP<STRING,STRUCT<text:STRING>>")
    rows = rows.withColumns({"book_code": code, "title": title, "year": year, "en_code": F.col("_meta")["en_code"]})
    rows = rows.select("file", "lang", "book_code", "title", "year", "en_code", F.explode(body).alias("para_key", "v"))
    place = T.page_para(F.col("para_key"))
    return rows.select("*", place["page"].alias("page"), place["para"].alias("para"), F.col("v.text").alias("raw_text")).drop("v")


def alignment_of(files: DataFrame) -> DataFrame:
    """(file, en_key, own_keys) of the en_reverse map of keyed JSON: its keys are the English ones."""
    reverse = F.from_json(F.from_json("text", "MAP<STRING,STRING>")["en_reverse"], "MAP<STRING,ARRAY<STRING>>")
    return files.select("file", F.explode(reverse).alias("en_key", "own_keys"))


def bible_json_verses(files: DataFrame) -> DataFrame:
    """Verses of a flat {verse: text} file in canonical order; a key that is no verse fails the job, empty verses go."""
    rows = files.select("file", F.explode(F.from_json("text", "MAP<STRING,STRING>")).alias("osis", "text"))
    checked = F.when(osis.is_verse(F.col("osis")), F.col("osis")).otherwise(F.raise_error(F.concat(F.lit("not a verse: "), F.col("osis"))).cast("string"))
    rows = rows.withColumns({"osis": checked, "text": T.stripped(F.col("text"))}).where("text <> ''")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy(osis.canonical_order(F.col("osis")))))
