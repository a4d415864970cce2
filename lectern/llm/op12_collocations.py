"""Phrase collocations by relational mining of occurrences (SETM).

An occurrence relation has a row (piece, pos, id) for each place where a frequent phrase of k words stands.  It is persisted in
buckets of pieces, sorted by piece and position.  To go from k to k + 1 words the relation is merge-joined with itself on piece and
adjacent position, the pairs of ids are counted, and only occurrences of frequent pairs are persisted as the next relation; a phrase
whose first or last k words are not frequent cannot be, so no frequent phrase is lost.  The joins need neither a shuffle nor a sort:
the files of a bucket are read in their order.

Equal pieces of a language are one piece with a multiplicity, so groups of copies and passages that many documents share are mined once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bucket_of, removed, saved, shared_folder

#: So many frequent groups at most are broadcast to the occurrences; beyond, both are shuffled.
BROADCAST_GROUPS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz "
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
#: A score is this often the share of a phrase's occurrences in those of its two parts.
SCALE = 2_000_000


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the session for a while; what the caller had comes back."""
    keys = {k: k.replace("__", ".") for k in conf}
    before = {k: spark.conf.get(key, None) for k, key in keys.items()}
    for k, v in conf.items():
        spark.conf.set(keys[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(keys[k]) if v is None else spark.conf.set(keys[k], v)


class Relation:
    """A table in buckets of pieces, each bucket one file in the order of `order`, and of `also`, which orders it alike."""

    def __init__(self, df: DataFrame, buckets: int, order: list[str], also: list[str] | None = None):
        self.spark, self.buckets, self.schema = df.sparkSession, buckets, df.schema
        self.path, self.names = f"{shared_folder(self.spark)}/relation-{uuid.uuid4().hex}", []
        self.order, self.also = order, also
        name = self._name()
        df.write.format("parquet").option("path", self.path).bucketBy(buckets, "piece").sortBy(*order).saveAsTable(name)

    def _name(self) -> str:
        self.names.append(f"relation_{uuid.uuid4().hex}")
        return self.names[-1]

    def read(self, other: bool = False) -> DataFrame:
        if other and len(self.names) == 1:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(f"CREATE TABLE {self._name()} ({columns}) USING parquet CLUSTERED BY (piece) SORTED BY ({', '.join(self.also)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self.spark.table(self.names[other])

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, self.path)


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words, m): the different pieces of each language and how often they occur; words are parted by one or more spaces."""
    plain = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    found = docs.where("text is not null").select(lang.alias("lang"), F.explode(F.split(plain, PIECE_ENDS)).alias("words"))
    return found.select("lang", F.trim("words").alias("words")).where("words <> ''").groupBy("lang", "words").agg(F.count(F.lit(1)).alias("m"))


def semi(rows: DataFrame, groups: DataFrame, on: list[str], buckets: int) -> DataFrame:
    """Rows whose group is among the frequent ones, with its id; still in buckets of pieces."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), on)
    return rows.join(groups.hint("shuffle_hash"), on).repartition(buckets, "piece")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Phrases that occur `least` times as (lang, phrase, k words, f), and how many words each language has as (lang, n)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Buckets are read in the order in which they were written, and pieces are what the joins are dealt by.
    sorted_buckets = dict(
        spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__requireAllClusterKeysForCoPartition="false", spark__sql__sources__bucketing__autoBucketedScan__enabled="false"
    )
    with settings(spark, **sorted_buckets):
        texts = Relation(pieces(docs).withColumn("piece", F.monotonically_increasing_id()).repartition(buckets, "piece"), buckets, ["piece"])
        occurrences = texts.read().select("piece", "lang", "m", F.posexplode(F.split("words", " +")).alias("pos", "word"))
        counted = saved(occurrences.groupBy("lang", "word").agg(F.sum("m").alias("f")), "counted")
        totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
        groups = saved(counted.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "groups")
        phrases = [groups.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f", "id", F.col("word").alias("last"))]
        found = semi(occurrences, groups.select("lang", "word", "id"), ["lang", "word"], buckets)
        for k in range(2, longest + 1):
            here = Relation(found.select("piece", "pos", (F.col("pos") - 1).alias("prev"), "id", "m"), buckets, ["piece", "pos"], ["piece", "prev"])
            if k == 2:
                texts.drop()
            else:
                before.drop()
            x = here.read().select("piece", "pos", F.col("id").alias("head"), "m")
            y = here.read(other=True).select("piece", F.col("prev").alias("pos"), F.col("id").alias("tail"))
            pairs = x.join(y.hint("merge"), ["piece", "pos"])
            groups = saved(pairs.groupBy("head", "tail").agg(F.sum("m").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "groups")
            head = phrases[-1].select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first"))
            tail = phrases[-1].select(F.col("id").alias("tail"), "last")
            longer = groups.join(head, "head").join(tail, "tail").select("lang", F.concat_ws(" ", "first", "last").alias("phrase"), F.lit(k).alias("k"), "f", "id", "last")
            phrases.append(saved(longer, "phrases"))
            found, before = semi(pairs, groups.select("head", "tail", "id"), ["head", "tail"], buckets), here
            if groups.isEmpty():
                break
        before.drop()
    every = phrases[0]
    for p in phrases[1:]:
        every = every.unionByName(p)
    return every.select("lang", "phrase", "k", "f"), totals


def exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, cover: int = 80) -> DataFrame:
    """The `most` best phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Reads lang and text.  Words are lower-cased (A-Z) and lie in pieces that end at . , ; : ! ? or a line break; phrases never cross
    pieces and are counted in their language.  A phrase of 2 to `longest` words that occurs a >= `least` times is scored at the cut where
    floor(2000000 * a / (l + r)) is lowest, l and r being how often its two parts occur; of equal scores the first cut counts.  One that lies
    inside a longer one with at least `cover` percent of its occurrences is dropped.  n is the number of words of the language.
    Products are decimals, so nothing overflows.  A null lang is 'und', a null or blank text has no words, repeated rows count each,
    doc_id and other columns are not looked at; a very long text is cut into its pieces by one task, one very long piece is held by
    one.  An empty table gives an empty table.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    every, totals = frequent_phrases(docs.select("lang", "text"), least, longest)
    longer = every.where("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = longer.select("lang", "phrase", "k", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(1, F.col("cut")).alias("one"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("two"))
    ones, twos = (every.select("lang", F.col("phrase").alias(c), F.col("f").alias(f)) for c, f in (("one", "l"), ("two", "r")))
    score = F.expr(f"(cast(a as decimal(19,0)) * cast({SCALE} as decimal(7,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    judged = cuts.join(ones, ["lang", "one"]).join(twos, ["lang", "two"]).withColumn("score", score)
    judged = judged.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    holders = longer.where("k > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = judged.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (exact(F.col("held")) * 100 < exact(F.col("a")) * cover))
    # A language may hold most candidates: the best of each of its parts come first, then the best of these.
    order = "order by worst.score desc, a desc, phrase"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = kept.withColumn("part", bucket_of(F.col("phrase"), parts)).withColumn("rank", F.expr(f"row_number() over (partition by lang, part {order})")).where(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.expr(f"row_number() over (partition by lang {order})").cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
