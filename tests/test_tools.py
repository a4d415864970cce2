import pytest

from lectern.plans import tools

SOP = "id string, lang string, book_code string, book_pair string, page int, para int, para_key string, raw_text string, aligned array<string>, corpus string, author string, title string, page_kind string, chunk int, bible_refs array<string>, vector array<double>"


def point(id_, lang, code, page, para, vector=(1.0, 0.0), pair=None, aligned=None, refs=None, corpus="egw", title="T", chunk=None):
    return (id_, lang, code, pair, page, para, f"{page}.{para}", f"text {id_}", aligned, corpus, "", title, None, chunk, refs, list(vector))


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(
        [
            point("1", "en", "A", 1, 1, refs=["John.3.16"], title="Great Book"),
            point("2", "en", "A", 1, 2, title="Great Book"),
            point("3", "en", "A", 2, 1, (0.6, 0.8), corpus=None, title="Great Book"),
            point("4", "de", "ADE", 5, 1, (0.0, 1.0), "A", ["1.1", "1.2"], title="Großes Buch"),
            point("5", "de", "BDE", 5, 2, (0.8, 0.6), "B", title="Anderes"),
        ],
        SOP,
    )


@pytest.fixture(scope="module")
def verses(spark):
    rows = [("kjv", "Ps.51.1", "kjv a"), ("kjv", "Ps.51.2", "kjv b"), ("luther1912", "Ps.51.1", "title"), ("luther1912", "Ps.51.3", "lu a"), ("luther1912", "Ps.51.4", "lu b"), ("net", "Ps.51.1", "net a"), ("kjv", "Acts.19.40", "x"), ("kjv", "Acts.19.41", "y"), ("luther1912", "Acts.19.40", "xy")]
    return spark.createDataFrame([(f"{b}{o}", b, o, t, [1.0, 0.0] if o == "Ps.51.1" else [0.0, 1.0]) for b, o, t in rows], "id string, bible string, osis string, text string, vector array<double>")


def test_lookup_two_passes(points):
    got = tools.sop_lookup(points, [{"vector": [0.8, 0.6], "codes": ["ADE"]}, {"vector": [0.0, 1.0], "codes": ["ADE", "BDE"]}, [0.8, 0.6]], limit=2).collect()
    assert [(r.query_id, r["pass"], r.rank, r.book_code, r.score) for r in got] == [(0, 1, 1, "ADE", 0.6), (1, 1, 1, "ADE", 1.0), (1, 1, 2, "BDE", 0.6), (2, 1, 1, "BDE", 1.0), (2, 1, 2, "ADE", 0.6)]
    fallback = tools.sop_lookup(points, [{"vector": [0.8, 0.6], "codes": ["ADE"]}], min_score=0.9).collect()
    assert [(r["pass"], r.book_code) for r in fallback] == [(2, "BDE")]
    with pytest.raises(ValueError):
        tools.sop_lookup(points, [[1.0, 0.0]] * 51)


def test_paragraphs_and_context(points):
    got = tools.sop_book_paragraphs(points, "A", 1, lang="en").collect()
    assert [(r.para_key, r.author, r.next_page_from) for r in got] == [("1.1", None, None), ("1.2", None, None)]
    around = tools.sop_context(points, "A", "1.2", before=1, after=5).collect()
    assert [(r.para_key, r.is_target) for r in around] == [("1.1", False), ("1.2", True), ("2.1", False)]
    with pytest.raises(ValueError):
        tools.sop_context(points, "A", "nonsense")


def test_books(points):
    assert [tuple(r) for r in tools.sop_list_books(points).collect()] == [("de", 2), ("en", 3)]
    found = tools.sop_list_books(points, find="GREAT").collect()
    assert [(r.lang, r.book_code, r.en_title) for r in found] == [("de", "ADE", "Great Book"), ("en", "A", "Great Book")]
    assert [r.book_code for r in tools.sop_list_books(points, find="GROSSES").collect()] == ["ADE"]


def test_parallel(points):
    assert [r.text for r in tools.sop_parallel(points, "ADE", "5.1").collect()] == ["text 1", "text 2"]
    assert [r.t_key for r in tools.sop_parallel(points, "A", "1.2", "en", "de").collect()] == ["5.1"]
    with pytest.raises(ValueError):
        tools.sop_parallel(points, "A", "1.1", "en", "fr")


def test_by_reference(points):
    assert [r.para_key for r in tools.sop_by_bible_ref(points, "John.3.16").collect()] == ["1.1"]


def test_bible_lookup(verses):
    found, missing = tools.bible_lookup(verses, "Ps.51.1; Gen.1.1", ["net", "kjv"])
    assert [(r.bible, r.osis) for r in found.collect()] == [("net", "Ps.51.1"), ("kjv", "Ps.51.1")]
    assert [r.ref for r in missing.collect()] == ["Gen.1.1"]
    found, missing = tools.bible_lookup(verses, "Ps.51.1-2", numbering="kjv")
    assert [(r.bible, r.osis, r.kjv_osis) for r in found.collect()] == [("kjv", "Ps.51.1", "Ps.51.1"), ("luther1912", "Ps.51.3", "Ps.51.1"), ("net", "Ps.51.1", "Ps.51.1"), ("kjv", "Ps.51.2", "Ps.51.2"), ("luther1912", "Ps.51.4", "Ps.51.2")]
    assert missing.isEmpty()


def test_earlier_key_loses_its_way_back(verses):
    found, missing = tools.bible_lookup(verses, "Acts.19.40,Acts.19.41", "luther1912", "kjv")
    assert [(r.osis, r.kjv_osis) for r in found.collect()] == [("Acts.19.40", "Acts.19.41")]
    assert [r.ref for r in missing.collect()] == ["Acts.19.40"]


def test_bible_limits(verses):
    with pytest.raises(ValueError, match="more than"):
        tools.bible_lookup(verses, "Ps.1-Ps.12")
    with pytest.raises(ValueError, match="no reference"):
        tools.bible_lookup(verses, "John.3.18-16")
    with pytest.raises(ValueError):
        tools.bible_lookup(verses, "Gen.1.1", numbering="other")


def test_bible_search_and_list(verses):
    assert [(r.osis, r.bible) for r in tools.bible_search(verses, [1.0, 0.0], "net").collect()] == [("Ps.51.1", "net")]
    assert [tuple(r) for r in tools.bible_list_translations(verses).collect()] == [("kjv", 4, False), ("luther1912", 4, True), ("net", 1, False)]
