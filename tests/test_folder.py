"""A folder of mixed sources as one table of blocks and one of problems."""

import json
from urllib.parse import unquote

import pytest

from lectern.sources import folder
from test_books import PLAIN, epub


def name(file):
    return unquote(file.rsplit("/", 1)[1])


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "de").mkdir()
    put = lambda n, t: (tmp_path / n).write_text(t)
    put("plain.txt", PLAIN.format(1) + "\n\n" + PLAIN.format(2))
    put("plain.txt.meta.toml", 'book_code = "P"\nlang = "en"\ntitle = "Plain"\nyear = 1901\n')
    put("notes + more.md", "# One\n\n" + PLAIN.format(3))
    put("notes + more.md.meta.toml", 'book_code = "N"\nlang = "de"\ntitle = "Notes"\n')
    epub(tmp_path / "book.epub", [[PLAIN.format(4)]], "<dc:title>From the book</dc:title>")
    put("book.epub.meta.toml", 'book_code = "E"\n')
    (tmp_path / "broken.epub").write_bytes(b"PK no zip")
    put("verses.json", json.dumps({"Gen.1.1": "In the beginning", "Gen.1.2": "And the earth"}))
    put("verses.json.meta.toml", 'book_code = "kjv"\nlang = "en"\ntitle = "KJV"\n')
    folder_name = tmp_path.name
    put("keyed.json", json.dumps({"meta": {f"{folder_name}_code": "K", "en_title": "Keyed"}, folder_name: {"3.1": {"text": "one two"}, "3.2": {"text": "three"}}}))
    put("odd.json", "[1, 2]")
    put("other.json", json.dumps({"meta": {}, "xx": {"1.1": {"text": "in another language"}}}))
    put("bare.txt", PLAIN.format(5))
    put("gone.txt.meta.toml", 'lang = "en"\n')
    put("bad.txt", PLAIN.format(6))
    put("bad.txt.meta.toml", "lang = ")
    put("typo.txt", PLAIN.format(7))
    put("typo.txt.meta.toml", 'book_code = "T"\nlang = "en"\ntitle = "T"\nauthr = "x"\n')
    return tmp_path


def test_mixed_folder(spark, sources):
    blocks, problems = folder.read_folder(spark, str(sources))
    got = {}
    for r in blocks.orderBy("file", "pos", "chunk").collect():
        got.setdefault((name(r.file), r.kind), []).append((r.book_code, r.lang, r.title, r.year, r.page_kind, r.para_key, r.seq, r.chunks, r.words))
    assert got == {
        ("plain.txt", "text"): [("P", "en", "Plain", 1901, "chapter", f"1.{i}", 0, 1, 15) for i in (1, 2)],
        ("notes + more.md", "markdown"): [("N", "de", "Notes", None, "chapter", "2.1", 0, 1, 15)],
        ("book.epub", "epub"): [("E", "en", "From the book", None, "chapter", "1.1", 0, 1, 15)],
        ("verses.json", "bible_json"): [("kjv", "en", "KJV", None, None, k, 0, 1, n) for k, n in (("Gen.1.1", 3), ("Gen.1.2", 3))],
        ("keyed.json", "sop_json"): [("K", sources.name, "Keyed", None, "print", k, 0, 1, n) for k, n in (("3.1", 2), ("3.2", 1))],
        ("bare.txt", "text"): [(None, None, None, None, "chapter", "1.1", 0, 1, 15)],
    }
    wrong = sorted((name(r.file), r.problem, r.detail if r.problem in ("missing", "unknown option") else "") for r in problems.collect())
    assert wrong == [
        ("bad.txt", "no TOML", ""), ("bare.txt", "missing", "book_code"), ("bare.txt", "missing", "lang"), ("bare.txt", "missing", "title"),
        ("broken.epub", "damaged", ""), ("gone.txt", "stale", ""), ("odd.json", "damaged", ""), ("other.json", "empty", ""), ("typo.txt", "unknown option", "authr"),
    ]


def test_explicit_options(spark, sources):
    blocks, problems = folder.read_folder(spark, str(sources), lang="en", year="1901")
    files = {name(r.file) for r in blocks.collect()}
    assert "notes + more.md" not in files and {"plain.txt", "bare.txt", "book.epub"} <= files
    assert [(name(r.file), r.detail) for r in problems.where("problem = 'conflict'").collect()] == [("notes + more.md", "lang")]
    assert {(r.lang, r.year) for r in blocks.where("kind = 'text'").collect()} == {("en", 1901)}
    with pytest.raises(ValueError, match="no such option"):
        folder.read_folder(spark, str(sources), colour="red")


def test_one_kind_only(spark, tmp_path):
    (tmp_path / "a.txt").write_text(PLAIN.format(1))
    blocks, problems = folder.read_folder(spark, str(tmp_path), book_code="A", lang="en", title="A")
    assert [(r.kind, r.book_code) for r in blocks.collect()] == [("text", "A")] and problems.count() == 0
