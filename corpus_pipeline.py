"""A corpus pipeline of five stages; each takes and gives the columns of documents, but for the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import materialize, unused
from lattica.llm.language import identify, learn_profiles
from lattica.llm.mixing import mixed_documents
from lattica.llm.packing import pack_documents
from lattica.llm.pii import replace_entities
from lattica.llm.queries import DEMO_KEY, vocabulary
from lattica.llm.simhash import keep_first

#: Cosine with the nearest prototype below which a text is in none of the languages.
LEAST_LIKE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter, or resemble no language of the corpus."""
    lang, score = unused(docs.columns, "lang_pred"), unused(docs.columns, "score")
    found = identify(docs, learn_profiles(docs), docs.columns, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LIKE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the least doc_id."""
    return keep_first(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets; n_chars follows the text."""
    out = replace_entities(docs, DEMO_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's target from its documents: a row for each pass over a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: a row for each piece."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("surrogates", surrogates),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages learn, tokenize and draw keyed values, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
