"""Toxicity by a classifier chain.

The categories are predicted one after another; each is a sparse logistic regression on
the words that a text contains, and each later one also sees the probabilities of the
earlier ones.  For training these come from models that did not see the row (out of
fold); for prediction from the model fitted on all rows of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op10_language_id import fit_ftrl
from .shared import document_columns, lean_batches
from .textblock import LOWER, MARKS, Words, blocks, text_bytes

BUCKETS = 1 << 18
FOLDS = 3


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of every word (A to Z lower-cased, punctuation apart) and its text's number."""
    raw, at = text_bytes(column)
    words = Words(LOWER[raw], at, MARKS)
    return (words.hashes() >> np.uint64(46)).astype(np.int64), np.repeat(np.arange(len(column)), words.counts())


@dataclass
class Chain:
    categories: list[str]
    words: list[np.ndarray]  # for each category one weight for each bucket
    extra: list[np.ndarray]  # bias, then a weight for each earlier category
    shift: list[float]  # for each category what brings its log odds from the sample's rows to those of all labels

    def probabilities(self, column: pa.Array) -> np.ndarray:
        bucket, text = word_buckets(column)
        heavy = np.zeros(BUCKETS, bool)
        for w in self.words:
            heavy |= w != 0
        used = heavy[bucket]
        pairs = np.unique(text[used] * BUCKETS + bucket[used])
        text, bucket = pairs // BUCKETS, pairs % BUCKETS
        p = np.zeros((len(column), len(self.categories)))
        for k, (w, extra) in enumerate(zip(self.words, self.extra, strict=True)):
            logit = np.bincount(text, w[bucket], minlength=len(column)) + extra[0] + p[:, :k] @ extra[1:]
            p[:, k] = 1 / (1 + np.exp(-logit))
        odds = np.log(np.clip(p, 1e-12, 1)) - np.log(np.clip(1 - p, 1e-12, 1)) + np.array(self.shift)
        return 1 / (1 + np.exp(-odds))


def _fit(rows: list[np.ndarray], dense: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word weights and the weights of bias and earlier probabilities, as differences of the two classes."""
    more = BUCKETS + np.arange(dense.shape[1])
    examples = [(np.concatenate([f, more]), np.concatenate([np.ones(len(f)), d])) for f, d in zip(rows, dense, strict=True)]
    w = fit_ftrl(examples, target, 2, BUCKETS + dense.shape[1], alpha=0.3, l1=1.0, l2=0.2, epochs=6)
    w = w[:, 1] - w[:, 0]
    return w[:BUCKETS], w[BUCKETS:]


def shift_to(p: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The shift of log odds after which the weighted mean of the probabilities is the given share."""
    odds = np.log(np.clip(p, 1e-12, 1)) - np.log(np.clip(1 - p, 1e-12, 1))
    lo, hi = -30.0, 30.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.average(1 / (1 + np.exp(-odds - mid)), weights=weight) < share else (lo, mid)
    return (lo + hi) / 2


def train_chain(rows: list[np.ndarray], labels: np.ndarray, categories: list[str], fold: np.ndarray, weight: np.ndarray | None = None) -> Chain:
    """rows: the distinct buckets of each text; labels: one 0/1 column for each category, in chain order.

    weight: for how many labelled documents each row stands.  The chain itself learns from the rows as they are; what it gives
    out is brought to the weighted shares, for every category.
    """
    chain, dense = Chain(categories, [], [], []), np.ones((len(rows), 1))
    weight = np.ones(len(rows)) if weight is None else weight
    for k in range(len(categories)):
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            fit, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            words, extra = _fit([rows[i] for i in fit], dense[fit], labels[fit, k])
            out[rest] = [1 / (1 + np.exp(-(words[rows[i]].sum() + dense[i] @ extra))) for i in rest]
        words, extra = _fit(rows, dense, labels[:, k])
        chain.words.append(words)
        chain.extra.append(extra)
        chain.shift.append(shift_to(out, weight, float(np.average(labels[:, k], weights=weight))))
        dense = np.column_stack([dense, out])
    return chain


def sample_rows(docs: DataFrame, labels: DataFrame, categories: list[str], per_class: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """Word buckets, labels and folds of about `per_class` labelled documents with the last category and as many without."""
    target = categories[-1]
    labels = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in categories])
    counts = {r[0]: r[1] for r in labels.groupBy(target).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return None
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(target) == value, min(1.0, per_class / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labels.where(draw < rate).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            bucket, text = word_buckets(block.column(1))
            pairs = np.unique(text * BUCKETS + bucket)
            ends = np.searchsorted(pairs, np.arange(block.num_rows + 1) * BUCKETS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs % BUCKETS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column(0), *block.columns[2:], lists], names=[*block.schema.names[:1], *block.schema.names[2:], "bucket"])

    # The sample has about 2 * per_class rows whatever the tables' size, so it may be broadcast; of rows that share a doc_id one is learnt from.
    own = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    joined = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "fold", *categories)
    table = joined.mapInArrow(task, "doc_id long, fold long, " + ", ".join(f"{c} int" for c in categories) + ", bucket array<int>").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return None
    rows = [np.asarray(x, np.int64) for x in table.column("bucket").to_pylist()]
    return rows, np.column_stack([table.column(c).to_numpy() for c in categories]).astype(int), table.column("fold").to_numpy()


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], per_class: int = 2500) -> DataFrame:
    """Probability of each category, in chain order, for every document: doc_id and one p_<category> column each.

    Reads doc_id and text of `docs`; `labels` holds doc_id and one 0/1 column for each category, the last being the one
    that matters.  Rows that miss a label are not learnt from; of repeated labels the largest counts.
    Of labelled rows that share a doc_id the smallest text is learnt from; each is scored.  Categories may have any names but doc_id, text,
    fold and bucket.  A very long text is one block of its task, with some 50 bytes for each word.  An empty table gives an empty table.  A null or empty text
    has no words and gets the probabilities of the bias alone; without any labelled document all probabilities are null.
    """
    if clash := {"doc_id", "text", "fold", "bucket"} & set(categories):
        raise ValueError(f"these names are used here: {sorted(clash)}")
    lean_batches(docs.sparkSession)
    docs = document_columns(docs)
    found = sample_rows(docs, labels, categories, per_class)
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories)
    if found is None:
        return docs.select("doc_id", *[F.lit(None).cast("double").alias(f"p_{c}") for c in categories])
    rows, y, fold = found
    # Rows are drawn by the last category: each stands for as many labelled documents as its class has for a row.
    whole = {r[0]: r[1] for r in labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(F.max(categories[-1]).cast("int").alias("c")).groupBy("c").agg(F.count(F.lit(1))).collect()}
    weight = np.array([whole[c] for c in y[:, -1].tolist()]) / np.bincount(y[:, -1], minlength=2)[y[:, -1]]
    shared = docs.sparkSession.sparkContext.broadcast(train_chain(rows, y, categories, fold, weight))  # BUCKETS weights for each category

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            p = shared.value.probabilities(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x) for x in p.T)], names=["doc_id", *(f"p_{c}" for c in categories)])

    return docs.mapInArrow(task, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents judged toxic, with the chain's probabilities.  The labels know one toxic category only; low quality, which is
    none, goes before it in the chain as a category that toxicity depends on."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    scored = score_toxicity(docs, labels, ["low_quality", "toxic"])
    return scored.where("p_toxic >= 0.5").select("doc_id", F.lit(True).alias("toxic"), F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"))
