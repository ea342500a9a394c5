"""From documents to token ids: language, copies, near copies, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept, which is written
as Parquet and read again. All but the last return the columns of ``documents``. No stage's rows can be had in SQL
alone, so the pipeline has no SQL; ``tests/llm`` holds it against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import bpe, exact, langid, mixing, neardup
from millrace.llm.queries import SNAPSHOT_HALF
from millrace.llm.store import Scratch, fresh
from millrace.session import read_table

#: A text of which no language knows this share of n-grams is in none of them.
LEAST_LANGUAGE_SCORE = 0.2
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; texts without letters go as well.

    With no labelled row there is nothing to decide by, and all documents stay. Columns that are named as the prediction is keep
    their values.
    """
    model = langid.learn(docs.filter(langid.in_training(F.col("doc_id"))))
    if not model.languages:
        return docs
    aside = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    found = langid.identified(docs.withColumnsRenamed(aside), model)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    return exact.without_duplicates(docs, F.expr(SNAPSHOT_HALF))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return neardup.without_near_duplicates(docs, shingle=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, token_ids`` and the ``text`` decoded from them."""
    path = public_tokenizers.path(TOKENIZER)
    encoded = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), path, decode=True)
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "text")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixture),
    ("BPE", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        made = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
        before = docs = made
    return docs
