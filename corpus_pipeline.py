"""Training corpus from raw documents, in five stages over operators of ``patchframe.llm``.

A stage takes what its predecessor kept and returns the columns of ``documents``; the
last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchframe.llm import bpe, jaccard, mixing, queries, repeats, toxicity
from patchframe.llm.common import long_texts, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below the toxicity threshold of their language."""
    labels = long_texts(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model, cuts = toxicity.fit_toxicity(docs, labels, "text", id="doc_id")
    scored = toxicity.score_toxicity(docs, model, cuts, "doc_id", "text", "lang", keep=COLUMNS[1:])
    return scored.where("toxic = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar five-word shingles (0.8 or more), the one with the smallest id."""
    long_texts(spark)
    groups = jaccard.similar_texts(docs, 5, 0.8, id="doc_id", text="text")
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 bytes or more that an earlier one has; characters stay whole."""
    long_texts(spark)
    cut = repeats.remove_repeats(docs, 50, "doc_id", "text", whole_characters=True, keep=["lang", "source"])
    text = F.decode("kept", "UTF-8")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: each at least once, prose more often, until the class totals meet their targets."""
    rated = mixing.mix_to_targets(
        docs, queries.classes(spark, sf_dir).withColumnRenamed("id", "doc_id"), {"prose": 0.9, "junk": 0.07, "toxic": 0.03},
        id="doc_id", text="text", least=1.0, budget=1.1, keep=COLUMNS[1:],
    )
    part = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1_000_000)) / 1_000_000
    times = (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rated.where(times >= 1).withColumn("_time", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    long_texts(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    back = bpe.encode(docs, ranks, public_tokenizers.PATTERN, "doc_id", "text", decoded=True)
    return back.select("doc_id", "n_tokens", "ids", F.sha2("body", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("mixing", mix),
    ("byte_bpe", encode),
]

# SQL cannot express the classifier, so the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
