"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all documents that may be learnt from.  The model
is fitted on a bounded sample of them by follow-the-regularised-leader with an
elastic-net penalty, which leaves most weights at exactly zero; a second bounded sample
fixes the temperature of its probabilities.  Prediction is one gather and one sum over
the n-grams of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean_batches
from .textblock import BASES, Prefix, blocks, mix

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Term frequencies are shares of a text; this brings their products with the weights near one.
SCALE = 3.0
#: Characters of one part of a very long text.
PART = 1 << 19


def ngram_parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ngrams() of a block; of one very long text a part at a time."""
    if len(column) > 1 or column.nbytes <= 2 * PART:
        yield ngrams(column)
        return
    text, over = "\x02" + (column[0].as_py() or "").lower() + "\x03", max(ORDERS) - 1
    for a in range(0, len(text), PART):
        # The last n-grams of a part begin in it and end in the next.
        yield _ngrams([text[a : a + PART + over]], PART)


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of a block of texts, and the text of each; case is folded."""
    return _ngrams([("\x02" + (t or "").lower() + "\x03") for t in column.to_pylist()])


def _ngrams(texts: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of these texts, those that begin in the first `most` characters."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    p = Prefix(chars.astype(np.uint64) + np.uint64(1), BASES[0])
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    found, owners = [], []
    for n in ORDERS:
        h = mix(p.windows(n) + np.uint64(n))[:most]
        inside = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]
        found.append((h[inside] & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(found), np.concatenate(owners)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts: a fixed-size table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for block in blocks(batches, "text", 1 << 19):
            parts = [np.unique(text * BUCKETS + bucket) for bucket, text in ngram_parts(block.column(0))]
            df[:-1] += np.bincount(np.unique(np.concatenate(parts)) % BUCKETS if len(parts) > 1 else parts[0] % BUCKETS, minlength=BUCKETS)
            df[-1] += block.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["bucket", "n"])

    df = np.zeros(BUCKETS + 1, np.int64)
    table = docs.select("text").mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return df[:-1], int(df[-1])


def sparse_rows(docs: DataFrame) -> pa.Table:
    """(lang, fold, bucket list, count list) of a bounded sample, made by the tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 19):
            parts = [np.unique(text * BUCKETS + bucket, return_counts=True) for bucket, text in ngram_parts(block.column(0))]
            key, count = parts[0]
            if len(parts) > 1:
                key, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                count = np.bincount(which, np.concatenate([c for _, c in parts])).astype(np.int64)
            ends = np.searchsorted(key, np.arange(block.num_rows + 1) * BUCKETS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % BUCKETS, count)]
            yield pa.RecordBatch.from_arrays([block.column(1), block.column(2), *lists], names=["lang", "fold", "bucket", "count"])

    return docs.select("text", "lang", "fold").mapInArrow(task, "lang string, fold long, bucket array<int>, count array<int>").toArrow()


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # BUCKETS x languages, the inverse document frequency included
    bias: np.ndarray
    temperature: float

    def scores(self, column: pa.Array) -> np.ndarray:
        size, total = np.zeros(len(column), np.int64), np.zeros((len(self.languages), len(column)))
        for bucket, text in ngram_parts(column):
            size += np.bincount(text, minlength=len(column))
            for k in range(len(self.languages)):
                total[k] += np.bincount(text, self.weight[bucket, k], minlength=len(column))
        return (total * SCALE / size.clip(1) + self.bias[:, None]).T

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return softmax(self.scores(column) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, features: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 1e-4, epochs: int = 6) -> np.ndarray:
    """Weights (features x classes) of a multinomial logistic regression, fitted by FTRL-proximal with an elastic net.

    rows: (feature numbers, values) of each example; they are visited in a fixed shuffled order.
    """
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def current(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        shrunk = np.sign(zf) * np.maximum(np.abs(zf) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[f])) / alpha + l2)

    rng = np.random.default_rng(10)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x = rows[i]
            w = current(f)
            error = softmax(x @ w)
            error[target[i]] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    return current(np.arange(features))


def fit_temperature(scores: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(softmax(scores / np.exp(t))[np.arange(len(target)), target] + 1e-300).mean()
    lo, hi, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, per_language: int = 600) -> Model | None:
    """Fit on documents with text, lang and doc_id; about `per_language` of each language, spread by a hash of doc_id.

    Of rows that share language and doc_id one is learnt from, so the sample has its bound however often ids repeat.  A fifth of it only
    serves the calibration.  None if there is nothing to learn from.
    """
    ids = docs.select("lang", "doc_id").distinct()
    counts = {r.lang: r.n for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    if not counts:
        return None
    df, total = document_frequency(docs)
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = docs.where(draw < rate).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    table = sparse_rows(chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5))))
    languages = sorted(counts)
    idf = np.log((1 + total) / (1 + df)) + 1
    features, counts_ = ([np.asarray(x) for x in table.column(c).to_pylist()] for c in ("bucket", "count"))
    rows = [(np.append(f, BUCKETS), np.append(SCALE * c / c.sum() * idf[f], 1.0)) for f, c in zip(features, counts_, strict=True)]
    target = np.array([languages.index(x) for x in table.column("lang").to_pylist()], int)
    held = np.asarray(table.column("fold").to_pylist()) == 0
    if held.all() or not held.any():
        held = np.zeros(len(rows), bool)
    fit = [i for i in range(len(rows)) if not held[i]]
    # Rows in an order that does not depend on partitions.
    fit.sort(key=lambda i: (int(target[i]), len(rows[i][0]), rows[i][1].tobytes()))
    weight = fit_ftrl([rows[i] for i in fit], target[fit], len(languages), BUCKETS + 1)
    check = np.flatnonzero(held) if held.any() else np.array(fit, int)
    scores = np.array([rows[i][1] @ weight[rows[i][0]] for i in check]).reshape(len(check), len(languages))
    temperature = fit_temperature(scores, target[check]) if len(check) else 1.0
    return Model(languages, (weight[:-1] * idf[:, None]).astype(np.float64), weight[-1], temperature)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(others, lang_pred, score) for rows of (text, others); only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of BUCKETS rows and one column for each language
    letters_first = docs.select(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text", "others")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in blocks(batches, "text", 1 << 19):
            letters = np.asarray(block.column(0).to_pylist(), bool)
            if model is None:
                best, score = np.zeros(len(letters), int), np.zeros(len(letters))
                names = np.array([UNDETERMINED], object)
            else:
                p = model.probabilities(block.column(1))
                best, score, names = p.argmax(axis=1), p.max(axis=1), np.array([*model.languages, UNDETERMINED], object)
            best, score = np.where(letters, best, len(names) - 1), np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([block.column(2), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["others", "lang_pred", "score"])

    return letters_first.mapInArrow(task, f"others {docs.schema['others'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def identify_languages(docs: DataFrame, per_language: int = 600, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Language of every whole text: the columns `keep` (of the input), held_out, lang_pred and score.

    Learns only from text and non-null lang of documents that are not held out (crc32 of doc_id as text, modulo 4, is not
    2).  A null text, an empty one or one without a letter gets 'und' and score 0; so does all if nothing can be learnt.
    Rows without a doc_id count as not held out only for prediction: they are never learnt from.  Repeated rows are predicted
    each, and of those that share language and doc_id the smallest text is learnt from; the columns kept may have any names but those three.  A very long text is read in parts.  An empty table gives an empty table.
    """
    if clash := {"held_out", "lang_pred", "score"} & set(keep):
        raise ValueError(f"these columns are made here: {sorted(clash)}")
    lean_batches(docs.sparkSession)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    learn = docs.where("doc_id is not null and lang is not null and text is not null").where(~held).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(learn, per_language)
    others = F.struct(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept"), held.alias("held")).alias("others")
    found = predict(docs.select(F.col("text").cast("string").alias("text"), others), model)
    return found.select(*[F.col(f"others.kept.`{k}`") for k in keep], F.col("others.held").alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
