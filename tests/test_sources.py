import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.plans import versification
from lectern.sources import bundle, contract, texts

LONG = "This is paragraph {} of readable plain prose with more than enough words to pass."


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(LONG.format(1) + "\n\nshort one\n \n" + LONG.format(2) + "\n")
    blocks = texts.gated(texts.text_blocks(texts.read_whole(spark, str(tmp_path / "a.txt"))))
    pieces = texts.book_blocks(blocks, "file").orderBy("para").collect()
    assert [(p.para_key, p.chunk, p.seq, p.chunks) for p in pieces] == [("1.1", 0, 0, 1), ("1.3", 0, 0, 1)]
    dropped = texts.dropped_detail(blocks).collect()
    assert [(d.para_key, d.reason) for d in dropped] == [("1.2", "too short (2 word(s) < 8)")]
    stats = texts.book_stats(blocks, texts.book_blocks(blocks, "file"), "file").first()
    assert (stats.blocks_in, stats.blocks_out, stats.dropped, stats.damage) == (3, 2, 1, 0.0)


def test_markdown(spark):
    text = f"# One\n\n{LONG.format(1)}\n\n{LONG.format(2)}\n\n```\ncode\n```\n\n# Two\nglued\n\n{LONG.format(3)}"
    blocks = texts.gated(texts.markdown_blocks(spark.createDataFrame([("f", text)], "file string, text string")))
    kept = texts.book_blocks(blocks, "file").orderBy("pos").collect()
    assert [k.para_key for k in kept] == ["2.1", "2.2", "3.1"]
    assert sorted(d.para_key for d in texts.dropped_detail(blocks).collect()) == ["2.0", "3.0"]


def test_marks(spark):
    rows = [("f", i, t) for i, t in enumerate(["a", "[7]", "b", "c", "[9]", "d"])]
    got = texts.carried_pages(spark.createDataFrame(rows, "file string, pos int, text string"), "file").orderBy("pos").collect()
    assert [(r.text, r.page, r.para) for r in got] == [("a", 0, 1), ("b", 7, 1), ("c", 7, 2), ("d", 9, 1)]


PAGE = "<html><head><style>p{}</style></head><body><script>var x='<p>no</p>'</script><h1>Head &amp; tail</h1><p class='a'>One<br/>two &nbsp; <b>three</b></p><div><li>item</li></div><p> </p></body></html>"


def test_html(spark):
    got = texts.html_blocks(spark.createDataFrame([(1, PAGE)], "page_id int, html string")).orderBy("pos").collect()
    assert [r.text for r in got] == ["Head & tail", "One two three", "item"]


def test_epub(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="OEBPS/content.opf"/></container>')
        opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A Book</dc:title><dc:date>1888-01-01</dc:date></metadata><manifest><item id="b" href="two.xhtml"/><item href="one.html" id="a"/><item id="c" href="x.css"/></manifest><spine><itemref idref="a"/><itemref idref="c"/><itemref idref="b"/></spine></package>'
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/one.html", "<body><p>first</p></body>")
        z.writestr("OEBPS/two.xhtml", "<body><p>second</p></body>")
    (tmp_path / "b.epub").write_bytes(out.getvalue())
    pages = texts.read_epub(spark, str(tmp_path / "b.epub"))
    assert [(p.doc_no, p.href, p.title, p.date) for p in pages.orderBy("doc_no").collect()] == [(1, "OEBPS/one.html", "A Book", "1888-01-01"), (2, "OEBPS/two.xhtml", "A Book", "1888-01-01")]
    assert [b.text for b in texts.html_blocks(pages).orderBy("doc_no").collect()] == ["first", "second"]


def test_keyed_json_and_alignment(spark):
    data = {"meta": {"de_code": "XDE", "en_code": "X", "year": "1973"}, "de": {"5.1": {"text": "eins"}, "5.2": {"text": "zwei"}, "odd": {"text": "drei"}}, "en_reverse": {"0.1": ["5.1"], "0.2": ["5.1", "5.2"]}}
    files = spark.createDataFrame([("/x/de/XDE.json", json.dumps(data))], "file string, text string")
    got = {r.para_key: (r.lang, r.book_code, r.year, r.page, r.para, r.raw_text) for r in texts.sop_json_blocks(files).collect()}
    assert got["5.2"] == ("de", "XDE", 1973, 5, 2, "zwei") and got["odd"][3:5] == (0, 0)
    from lectern.operators.corpus import inverted

    pairs = inverted(texts.alignment_of(files), "en_key", "own_keys")
    assert {r.own_key: r.aligned for r in pairs.collect()} == {"5.1": ["0.1", "0.2"], "5.2": ["0.2"]}


def test_scripture_json(spark):
    files = spark.createDataFrame([("b.json", json.dumps({"Exod.1.1": "b", "Gen.1.2": "a2", "Gen.1.1": "a1", "Gen.1.3": " "}))], "file string, text string")
    assert [r.osis for r in texts.bible_json_verses(files).orderBy("pos").collect()] == ["Gen.1.1", "Gen.1.2", "Exod.1.1"]
    bad = spark.createDataFrame([("b.json", '{"Gen.0.1": "x"}')], "file string, text string")
    with pytest.raises(Exception, match="not a verse"):
        texts.bible_json_verses(bad).collect()


def test_kinds(spark):
    rows = [("a.epub", []), ("b.MD", []), ("c.json", ["Gen.1.1"]), ("d.json", ["meta"]), ("e.json", []), ("f", [])]
    df = spark.createDataFrame(rows, "p string, k array<string>").select(texts.kind_of(F.col("p"), F.col("k")))
    assert [r[0] for r in df.collect()] == ["epub", "markdown", "bible_json", "sop_json", "sop_json", "text"]


def test_bundle_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("1", "en", "A", [1.0, 2.0]), ("2", "de", "A", [0.0, 1.0])], "id string, lang string, book_code string, vector array<float>")
    path = f"file://{tmp_path}/bundle"
    bundle.write_bundle(points, path, "sop", "sop/plain")
    assert sorted(map(tuple, bundle.read_bundle(spark, path).collect())) == sorted(map(tuple, points.collect()))
    points.limit(1).write.mode("append").parquet(f"{path}/points")
    with pytest.raises(ValueError, match="manifest"):
        bundle.read_bundle(spark, path)


def test_remap(spark):
    cases = {
        ("luther1912", "Ps.51.1"): "Ps.51.3",
        ("luther1912", "Gen.31.55"): "Gen.32.1",
        ("luther1912", "Acts.19.40"): "Acts.19.40",
        ("luther1912", "Acts.19.41"): "Acts.19.40",
        ("synodal", "Ps.115.1"): "Ps.113.9",
        ("synodal", "Rom.16.25"): "Rom.14.24",
        ("synodal", "Ps.10.1"): "Ps.9.22",
        ("ukrogienko", "Mal.4.1"): "Mal.4.1",
        ("kjv", "Ps.51.1"): "Ps.51.1",
        ("luther1912", "Ps.51.1a-Ps.51.2"): "Ps.51.3a-Ps.51.4",
        ("luther1912", "Eph.5.33.a"): "Eph.5.33.a",
        ("luther1912", "nonsense"): "nonsense",
    }
    refs = spark.createDataFrame(list(cases), "target string, ref string")
    got = {(r.target, r.ref): (r.remapped, r.moved) for r in versification.remap_refs(refs, versification.rule_table(spark)).collect()}
    assert got == {k: (v, v != k[1]) for k, v in cases.items()}


def test_way_back_is_the_later_key(spark):
    verses = spark.createDataFrame([("luther1912", "Acts", 19, 40, 0), ("luther1912", "Acts", 19, 41, 1)], "target string, book string, chapter int, verse int, key_pos int")
    back = versification.back_to_kjv(versification.remap(verses, versification.rule_table(spark))).collect()
    assert [(r.ed_verse, r.verse) for r in back] == [(40, 41)]


def test_contract(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[contract]\nid = "x"\n[embedding]\nmodel = "m"\ndim = 4\n[chunker]\nmax_words = 100\n')
    c = contract.load_contract(tmp_path / "c.toml")
    assert c.limits.max_words == 100 and len(c.fingerprint) == 64
    assert contract.embedding_differences(c.embedding, {"model": "m", "dim": 5}) == ["dim: 5 is not 4"]
    df = spark.createDataFrame([(["lang", "odd"], " ")], "k array<string>, t string")
    problems = df.select(contract.payload_problems("bible", F.col("k"), F.col("t"))).first()[0]
    assert problems == ["empty text", "missing bible", "missing osis", "missing text", "unknown lang", "unknown odd"]
    with pytest.raises(ValueError, match="year"):
        contract.merged_options({"year": 1900}, {"year": 1901})
    assert contract.missing_options("text", {"lang": "en"}) == ["book_code", "title"]
