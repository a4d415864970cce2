"""Books from EPUB files and their JSON files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources import books, texts

PLAIN = "This is paragraph {} of readable plain prose with more than enough words to pass."


def epub(path, documents, meta=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="OEBPS/content.opf"/></container>')
        items = "".join(f'<item id="i{k}" href="d{k}.html"/>' for k in range(len(documents)))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(documents)))
        z.writestr("OEBPS/content.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{meta}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for k, blocks in enumerate(documents):
            z.writestr(f"OEBPS/d{k}.html", "<body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body>")
    path.write_bytes(out.getvalue())


def plain_keys(documents):
    """The keys by a plain loop over the blocks: the state is page, number of the paragraph and whether a mark was seen."""
    import re

    flat = [(d + 1, b) for d, blocks in enumerate(documents) for b in blocks]
    cited = [re.search(r"\s*([A-Z][A-Za-z0-9]{1,9})\s+(\d{1,4})\.(\d{1,3})\s*$", b) for _, b in flat]
    codes = [m[1] for m in cited if m]
    code = max(dict.fromkeys(codes), key=codes.count) if codes else None
    coded = code is not None and codes.count(code) >= 0.4 * len(flat)
    page, para, marked, out = 0, 0, False, []
    for (doc, text), m in zip(flat, cited, strict=True):
        if mark := re.fullmatch(r"\[(\d{1,4})\]", text):
            page, para, marked = int(mark[1]), 0, True
        elif coded and m and m[1] == code:
            out.append((int(m[2]), int(m[3]), text[: m.start()].strip()))
        else:
            if not marked and doc != page:
                page, para = doc, 0
            para += 1
            out.append((page, para, text))
    return out, code if coded else None, "print" if coded or marked else "chapter"


CASES = {
    "chapters": [[PLAIN.format(1), PLAIN.format(2)], ["short", PLAIN.format(3)], [], [PLAIN.format(4)]],
    "marks": [[PLAIN.format(1), "[7]", PLAIN.format(2), PLAIN.format(3)], [PLAIN.format(4), "[8]", PLAIN.format(5), "[8]", PLAIN.format(6)]],
    "cited": [[PLAIN.format(1) + " CHR 24.1", PLAIN.format(2) + " CHR 24.2", "A heading of its own which has eight words at least here"], [PLAIN.format(3) + " CHR 2.1", PLAIN.format(4) + " XYZ 9.9", PLAIN.format(5)]],
    "collision": [[PLAIN.format(1), PLAIN.format(2) + " AB1 1.1", PLAIN.format(3) + " AB1 1.1"], [PLAIN.format(4) + " AB1 2.1"]],
    "few citations": [[PLAIN.format(1) + " CHR 24.1", PLAIN.format(2), PLAIN.format(3)]],
    "cited with marks": [["[5]", PLAIN.format(1) + " CHR 24.1", PLAIN.format(2), "[6]"], [PLAIN.format(3) + " CHR 25.1", PLAIN.format(4)]],
}


def test_composed(spark, tmp_path):
    for name, documents in CASES.items():
        epub(tmp_path / f"{name}.epub", documents)
    pages = texts.read_epub(spark, str(tmp_path / "*.epub"))
    made, pieces, dropped = books.epub_books(pages)
    heads = {r.file.rsplit("/", 1)[1][:-5].replace("%20", " "): r for r in made.collect()}
    own = {}
    for r in pieces.orderBy("file", "pos", "chunk").collect():
        own.setdefault(r.file.rsplit("/", 1)[1][:-5].replace("%20", " "), []).append((r.page, r.para, r.text, r.seq))
    gone = dropped.count()
    for name, documents in CASES.items():
        keys, code, kind = plain_keys(documents)
        kept = [k for k in keys if len(k[2].split()) >= 8]
        gone -= len(keys) - len(kept)
        seen, want = {}, []
        for page, para, text in kept:
            want.append((page, para, text, seen.get((page, para), 0)))
            seen[page, para] = seen.get((page, para), 0) + 1
        assert own[name] == want, name
        assert (heads[name].book_code, heads[name].page_kind) == (code, kind), name
        assert (heads[name].blocks_in, heads[name].blocks_out) == (len(keys), len(kept)), name
    assert gone == 0


def test_two_chapters_equal_a_book_made_by_hand(spark, tmp_path):
    long = " ".join(f"Sentence number {i} of this paragraph has exactly ten words." for i in range(40))
    meta = "<dc:title>A Book</dc:title><dc:creator>An Author</dc:creator><dc:date>c1888</dc:date><dc:rights>free</dc:rights>"
    epub(tmp_path / "b.epub", [[PLAIN.format(1), long], ["[2]", PLAIN.format(2)]], meta)
    made, pieces, _ = books.epub_books(texts.read_epub(spark, str(tmp_path / "b.epub")))
    head = made.first()
    assert (head.title, head.author, head.year, head.rights, head.page_kind) == ("A Book", "An Author", 1888, "free", "print")
    block = lambda page, para, seq, chunks, text: {"para_key": f"{page}.{para}", "page": page, "para": para, "seq": seq, "chunk": seq, "chunks": chunks, "text": text, "words": len(text.split())}
    parts = long.split(". ")
    halves = [". ".join(parts[:22]) + ".", ". ".join(parts[22:])]
    want = [block(1, 1, 0, 1, PLAIN.format(1)), block(1, 2, 0, 2, halves[0]), block(1, 2, 1, 2, halves[1]), block(2, 1, 0, 1, PLAIN.format(2))]
    got = [r.asDict() for r in pieces.orderBy("pos", "chunk").select(*books.WRITTEN_BLOCK).collect()]
    assert got == want


GOLDEN = """{
  "schema": "x.book/1",
  "profile": "sop",
  "source": {
    "kind": "text",
    "file": "Straße.txt",
    "sha256": null
  },
  "book": {
    "title": "A",
    "book_code": "B",
    "year": 1888
  },
  "id_rule": "sop/seq",
  "alignment": null,
  "stats": {
    "blocks_in": 2,
    "damage": 0.0,
    "dropped_detail": []
  },
  "blocks": [
    {
      "para_key": "1.1",
      "page": 1,
      "para": 1,
      "seq": 0,
      "chunk": 0,
      "chunks": 1,
      "text": "Zeile\\n„zwei“",
      "words": 2
    }
  ]
}
"""


def test_book_file(spark):
    files = spark.createDataFrame([("a", GOLDEN)], "file string, text string")
    loaded = books.load_books(files)
    assert books.dump_books(loaded).first().text == GOLDEN
    again = books.load_books(books.dump_books(loaded))
    assert again.collect() == loaded.collect() and loaded.first().problems == []
    assert [tuple(r) for r in books.blocks_of(loaded).collect()] == [("a", "1.1", 1, 1, 0, 0, 1, "Zeile\n„zwei“", 2)]


def test_book_problems(spark):
    good = json.loads(GOLDEN)
    without = lambda *keys: json.dumps({k: v for k, v in good.items() if k not in keys})
    block = good["blocks"][0]
    cases = {
        "{": "not valid JSON",
        "[]": "top level must be",
        "": "not valid JSON",
        without("stats", "id_rule"): "missing required key(s): id_rule, stats",
        json.dumps(good | {"schema": "x.book/2"}): "unsupported schema",
        json.dumps(good | {"profile": "odd"}): "unknown profile",
        json.dumps(good | {"source": []}): "'source' must be an object",
        json.dumps(good | {"id_rule": ""}): "non-empty string",
        json.dumps(good | {"alignment": 3}): "'alignment' must be",
        json.dumps(good | {"blocks": {}}): "'blocks' must be a list",
        json.dumps(good | {"blocks": [block, 7]}): "blocks[1] is not an object",
        json.dumps(good | {"blocks": [{k: v for k, v in block.items() if k not in ("seq", "text")}, block]}): "blocks[0] missing key(s): seq, text",
        json.dumps(good | {"blocks": [block | {"page": True}]}): "badly typed",
        json.dumps(good | {"blocks": [block | {"page": "x"}]}): "badly typed",
    }
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(cases)] + [("null", None)], "file string, text string").repartition(3)
    got = {r.file: r for r in books.load_books(files).collect()}
    for i, problem in enumerate(cases.values()):
        assert len(got[str(i)].problems) == 1 and problem in got[str(i)].problems[0], problem
    assert len(got["11"].blocks) == 1 and got["null"].problems
    # A block without a piece number takes that of its sequence.
    old = json.dumps(good | {"blocks": [{k: v for k, v in block.items() if k != "chunk"} | {"seq": "4"}]})
    row = books.load_books(spark.createDataFrame([("o", old)], "file string, text string")).first()
    assert (row.blocks[0].seq, row.blocks[0].chunk, row.problems) == (4, 4, [])


def test_no_pages(spark):
    none = spark.createDataFrame([], texts.EPUB)
    made, pieces, dropped = books.epub_books(none, T.Limits())
    assert made.count() == pieces.count() == dropped.count() == 0


@pytest.mark.parametrize("least", [0.4, 0.9])
def test_share_of_citations(spark, least):
    rows = [("f", 1, i, PLAIN.format(i) + (" CHR 1.%d" % i if i % 2 else "")) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "file string, doc_no int, pos int, text string")
    got = books.keyed_pages(df, least=least).orderBy("pos").select("page", "para", "coded").collect()
    assert [r.coded for r in got] == [least == 0.4 and bool(i % 2) for i in range(1, 9)]
    assert [r.para for r in got if not r.coded] == ([1, 2, 3, 4] if least == 0.4 else list(range(1, 9)))
    assert books.keyed_pages(df).where(F.col("text").contains("CHR")).count() == 0
