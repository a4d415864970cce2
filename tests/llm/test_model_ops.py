"""Search, scoring, formatting, packing and the pipeline."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import op3_nearest as op3
from lectern.llm import op7_chat_format as op7
from lectern.llm import op8_packing as op8
from lectern.llm.op3_nearest import Block, chi_square_cdf, chi_square_limit, nearest
from lectern.llm.op5_toxicity import score_toxicity, shift_to
from lectern.llm.op8_packing import ChunkIds, configurations, pack_documents, plan
from lectern.llm.op10_language_id import fit_ftrl, fit_temperature, identify_languages, ngrams, softmax
from lectern.llm.textblock import text_bytes

VECTORS = "vec_id long, embedding array<double>, rank int, block string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_chi_square():
    assert abs(chi_square_cdf(np.array([2.0]), 2)[0] - (1 - math.exp(-1))) < 1e-12
    assert abs(chi_square_cdf(np.array([15.507]), 8)[0] - 0.95) < 1e-4 and abs(chi_square_limit(0.95) - 26.296) < 1e-3  # 16 degrees


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:140] = x[7]  # a vector that many rows share
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(x)]
    rows += [(9000, None, 0, ""), (9020, [0.0] * 16, 0, ""), (9040, [1.0, None] * 8, 0, ""), (9060, [float("nan")] * 16, 0, ""), (9080, [1.0], 0, ""), (9100, [], 0, ""), (None, x[1].tolist(), 0, ""), (20, x[20].tolist(), 0, "")]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, found in got.items():
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(score, 12))) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found[:-1], found[1:], strict=True))
        hit += len({f[1] for f in found} & set(order))
    assert hit / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("rows", [8192, 256])
def test_clustered_vectors_are_pruned(spark, monkeypatch, rows):
    """At recall 0.9 at most a third of the points is verified, for vectors of unit length as the given ones are."""
    monkeypatch.setattr(op3, "CELL_ROWS", rows)
    rng = np.random.default_rng(2)
    n = 6000
    x = rng.normal(size=(60, 32))[rng.integers(0, 60, n)] + 0.2 * rng.normal(size=(n, 32))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], VECTORS).repartition(3)
    got = nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    score = x[::20] @ x.T
    score[np.arange(n // 20), np.arange(0, n, 20)] = -np.inf
    want = {(20 * i, j) for i, row in enumerate(score) for j in np.argsort(-row)[:20].tolist()}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want) and len(got) == n
    block = Block(np.arange(n), x, float(np.sqrt((x * x).sum(axis=1)).max()))
    block.search(np.arange(0, n, 20), x[::20], np.full(n // 20, -np.inf), 20, chi_square_limit(0.95))
    assert block.verified <= n * (n // 20) / 3


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [0.5, 0.5], 0, ""), (2, [1.0, 1.0], 0, "")], VECTORS)
    got = nearest(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (1, 0.5)]
    none = spark.createDataFrame([], VECTORS)
    assert nearest(none, none).count() == 0 and nearest(df, none).count() == 0


def test_repeated_rows_leave_room_for_equal_vectors(spark):
    same, k = [0.6, 0.8], 3
    df = spark.createDataFrame([(1, same, 0, "")] * (k + 3) + [(i, same, 0, "") for i in (2, 4, 5)] + [(0, [1.0, 0.0], 0, "")], VECTORS)
    got = nearest(df, df.where("vec_id = 0"), k).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 4]


def test_toxicity(spark):
    rng = random.Random(5)
    plain, rude = [f"word{i}" for i in range(200)], ["idiot", "scum", "stupid"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = rng.choices(plain, k=rng.randrange(20, 120)) + (rng.choices(rude, k=3) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w).title() + "."))
        if i < 300:
            labels.append((i, int(toxic or i % 3 == 0), int(toxic)))
    rows += [(500, None), (501, ""), (None, "Idiot!")]
    labels += [(5, None, 1), (999, 1, 1), (0, 1, 1)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, low int, toxic int"), ["low", "toxic"]).collect()}
    assert len(got) == len(rows) and all(got[i].p_toxic is not None for i in got)
    with pytest.raises(ValueError, match="fold"):
        score_toxicity(docs, spark.createDataFrame([], "doc_id long, fold int"), ["fold"])
    held = [(got[i].p_toxic >= 0.5) == (i % 4 == 0) for i in range(300, 400)]
    assert np.mean(held) >= 0.95 and got[501].p_toxic < 0.5
    without = score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), ["toxic"])
    assert without.where("p_toxic is null").count() == len(rows)


def test_repeated_ids_keep_the_sample_small(spark):
    """One labelled id with 20,001 rows is one row of the sample."""
    from lectern.llm import op5_toxicity as op5
    from lectern.llm import op10_language_id as op10

    docs = spark.range(20_001).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.range(100, 130).select(F.col("id").alias("doc_id"), F.lit("other words").alias("text")))
    labels = spark.createDataFrame([(7, 1)] + [(i, 0) for i in range(100, 130)], "doc_id long, toxic int")
    rows, y, _ = op5.sample_rows(docs, labels, ["toxic"], 100)
    assert len(rows) == 31 and y.sum() == 1
    seen = []
    original = op10.sparse_rows

    def counted(df):
        seen.append(df.count())
        return original(df)

    op10.sparse_rows = counted
    try:
        assert op10.train(docs.withColumn("lang", F.when(F.col("doc_id") == 7, "a").otherwise("b")), 100) is not None
    finally:
        op10.sparse_rows = original
    assert seen == [31]


def test_category_shares():
    """Rows that stand for more labelled documents count more: mean probabilities follow the labels' shares."""
    p, weight = np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1.0, 9.0, 9.0])
    odds = np.log(p / (1 - p)) + shift_to(p, weight, 0.1)
    assert abs(np.average(1 / (1 + np.exp(-odds)), weights=weight) - 0.1) < 1e-9


def test_preferences(spark, monkeypatch):
    schema = "pair_id long, turn long, role string, text string, split string"
    chosen = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "good", ""), (1, 2, "user", "more", ""), (2, 0, "user", "same", ""), (3, 0, "user", "alone", ""), (4, 0, "user", None, ""), (4, 0, "user", "b", ""), (4, 1, "assistant", "x", ""), (None, 0, "user", "y", "")]
    rejected = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "bad", ""), (2, 0, "user", "same", ""), (4, 0, "user", "", ""), (4, 2, "assistant", "z", ""), (5, None, "user", "y", "")]
    one = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    want = {
        1: (one("user", "hi"), one("assistant", "good") + one("user", "more"), one("assistant", "bad"), ["good<|im_end|>\n"], ["bad<|im_end|>\n"]),
        2: (one("user", "same"), "", "", [], []),
        3: ("", one("user", "alone"), "", [], []),
        4: (one("user", ""), one("assistant", "x"), one("assistant", "z"), ["x<|im_end|>\n"], ["z<|im_end|>\n"]),
    }
    sides = [spark.createDataFrame(x, schema) for x in (chosen, rejected)]
    made = op7.preference_pairs(*sides)
    learnt = lambda text, mask: [text[m["first"] : m["end"]] for m in mask]
    got = {r.pair_id: (r.prompt, r.chosen, r.rejected, learnt(r.chosen, r.chosen_mask), learnt(r.rejected, r.rejected_mask)) for r in made.collect()}
    assert got == want
    plan_ = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan_ and "Arrow" not in plan_
    # Rows of one turn each: the parts of a pair come together from its rows.
    monkeypatch.setattr(op7, "CHUNK_BITS", 0)
    parts = {}
    for r in sorted(op7.preference_pairs(*sides).collect(), key=lambda r: (r.pair_id, r.chunk)):
        old = parts.get(r.pair_id, ("", "", ""))
        parts[r.pair_id] = (old[0] + r.prompt, old[1] + r.chosen, old[2] + r.rejected)
    assert parts == {i: w[:3] for i, w in want.items()}
    none = spark.createDataFrame([], schema)
    assert op7.preference_pairs(none, none).count() == 0


def ids_of(cache, texts):
    raw, at = text_bytes(pa.array(texts, pa.string()))
    ids, ends = cache.of_block(raw, at)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_chunk_ids(monkeypatch):
    cache = ChunkIds(TOKENIZER)
    assert cache.apart
    texts = ["Plain words, here. It's x.y! don't", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "İstanbul é é ß Σσς ﬁ", "1234 a1b2", "no break   x", "\x01 \x1c a\x1cb", "", "語 텍스트 🙂🙂", " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(1500))]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abzAZ.,;:!?'\"<|>- \t\n é\u0301\x01\x1c0９ßΣς☃İ") for _ in range(rng.randrange(60))) for _ in range(500)]
    want = [e.ids for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(cache, texts) == want
    monkeypatch.setattr("lectern.llm.op8_packing.CACHED_CHUNKS", 100)
    small = ChunkIds(TOKENIZER)
    assert [ids_of(small, [t])[0] for t in texts] == want
    small.apart = False
    assert ids_of(small, texts) == want


def test_all_documents_are_tokenised_alike():
    """Every text of the largest test table, against the tokeniser itself."""
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    cache = ChunkIds(TOKENIZER)
    for i in range(0, len(texts), 500):
        assert ids_of(cache, texts[i : i + 500]) == [e.ids for e in cache.tokenizer.encode_batch_fast(texts[i : i + 500], add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 4097, 300), rng.integers(1, 300, 900), np.full(seed * 40, 2049), np.full(3, 4096)])
    histogram = {int(k): int((lengths == k).sum()) for k in np.unique(lengths)}
    rows, used, spans = plan(histogram, 4096), {}, {}
    for length, lo, hi, first, offset in rows:
        used.setdefault(length, []).append((lo, hi))
        for k in range(hi - lo):
            spans.setdefault(first + k, []).append((offset, offset + length))
    for length, n in histogram.items():
        edges = sorted(used[length])
        assert edges[0][0] == 0 and edges[-1][1] == n and all(a[1] == b[0] for a, b in zip(edges[:-1], edges[1:], strict=True))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(own[:-1], own[1:], strict=True))
    least = max(-(-int(lengths.sum()) // 4096), int((lengths > 2048).sum()))
    assert len(spans) <= 1.02 * least + 2


def test_configurations_are_feasible():
    made = configurations([4000, 2100, 1400, 900], [5, 7, 20, 31], 4096)
    assert made and all(sum(a * s for a, s in zip(c, [4000, 2100, 1400, 900], strict=True)) <= 4096 and n > 0 for c, n in made)


def test_packing(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "long " * 9000), (3, texts[3]), (None, "x")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int").repartition(4)
    got = pack_documents(docs, TOKENIZER).collect()
    tokenizer = ChunkIds(TOKENIZER).tokenizer
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(own[:-1], own[1:], strict=True))
    assert len(places) <= 1.05 * sum(r.length for r in got) / 4096 + 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_ftrl_and_temperature():
    rng = np.random.default_rng(7)
    rows = [(rng.choice(50, 8, replace=False), np.ones(8)) for _ in range(600)]
    target = np.array([int((f < 25).sum() > 4) for f, _ in rows])
    w = fit_ftrl(rows, target, 2, 60, alpha=0.5, l1=0.5, l2=0.01, epochs=5)
    right = np.mean([np.argmax(x @ w[f]) == y for (f, x), y in zip(rows, target, strict=True)])
    assert right > 0.95 and (w[50:] == 0).all()
    truth = rng.normal(size=(4000, 3))
    drawn = np.array([rng.choice(3, p=softmax(s)) for s in truth])
    assert 3.5 < fit_temperature(truth * 4, drawn) < 4.5


def test_language(spark):
    rng = random.Random(8)
    sounds = {"en": ["the", "ing", "wh", "ed", "tion"], "de": ["sch", "ung", "ein", "ßt", "ö"], "fr": ["eau", "ç", "ille", "oi", "é"]}
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(sounds))
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(rng.randrange(5, 60))), lang))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "thething whtion", None), (None, "schung", "de")]
    docs = spark.createDataFrame([(i, t, x, 0.0) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert len(got) == len(rows)
    held = [(i, x) for i, _, x in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1000, 1004))
    assert np.mean([got[i].lang_pred == x for i, x in held]) >= 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "en" and 0 <= got[1003].score <= 1
    nothing = identify_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_parts_of_a_long_text(monkeypatch, spark):
    """A text read in parts has the n-grams, hashes and pieces of the whole."""
    from lectern.llm import op10_language_id as op10
    from lectern.llm import textblock

    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    raw, at = text_bytes(pa.array([text]))
    whole, hashes = np.sort(ngrams(pa.array([text]))[0]), textblock.Words(raw, at).hashes()
    rows = [(1, text), (2, "x" * 5000 + " " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = sorted(map(tuple, op8.token_pieces(docs, TOKENIZER, 128).collect()))
    monkeypatch.setattr(op10, "PART", 1000)
    monkeypatch.setattr(textblock, "BLOCK_BYTES", 1000)
    assert np.array_equal(np.sort(np.concatenate([b for b, _ in op10.ngram_parts(pa.array([text]))])), whole)
    assert np.array_equal(textblock.Words(raw, at).hashes(), hashes)
    cuts = list(textblock.parts_of(raw, textblock.SPACE, 1000))
    assert len(cuts) > 5 and cuts[0][0] == 0 and cuts[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    cache = ChunkIds(TOKENIZER)
    apart = [ids_of(cache, [raw[a:b].tobytes().decode()])[0] for a, b in cuts]
    assert sum(apart, []) == ids_of(cache, [text])[0] and len(pieces) > 20


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from lectern.llm.op6_minhash import near_duplicates

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == docs.columns
            assert after.join(before, "doc_id", "left_anti").isEmpty()
        if name == "near_duplicates":
            groups = near_duplicates(before).where("kept").select("doc_id")
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in groups.collect()}
        before = after
    assert before.select("doc_id").distinct().count() == spark.read.parquet(f"{tmp_path}/decontamination").count()
    assert corpus_pipeline.run(spark, folder).count() == before.count()
