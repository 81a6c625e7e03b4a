"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import documents
from lattica.llm.dac import round_trip
from lattica.llm.forest import near_vectors
from lattica.llm.language import predict_languages
from lattica.llm.licenses import scan_licenses
from lattica.llm.mixing import mix
from lattica.llm.packing import pack_documents
from lattica.llm.pii import replace_entities
from lattica.llm.quality import apply_quality_rules
from lattica.llm.simhash import simhash_groups
from lattica.llm.warc import derive_pages

#: The key that surrogates are drawn from; a deployment sets its own.
DEMO_KEY = b"lattica demonstration key"


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_entities(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)
    return found.select("doc_id", "n_entities", "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op3_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda pieces: F.aggregate(pieces, F.lit(0).cast("long"), lambda a, x: a + x.n)
    shards = F.array_sort(F.array_distinct(F.transform("pieces", lambda x: x.shard)))
    by_shard = F.transform(shards, lambda s: F.concat_ws(":", s, words(F.filter("pieces", lambda x: x.shard == s))))
    place = F.array_min(F.transform("pieces", lambda x: F.struct(x.turn.alias("turn"), x.shard.alias("shard"))))
    mixed = mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", words(F.col("pieces")).alias("taken"), F.size("pieces").alias("n_pieces"), F.array_join(by_shard, ",").alias("shard_words"), place.alias("place"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "shard_words", "place.shard", "place.turn")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(documents(spark, sf_dir))


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_licenses": op2_licenses,
    "op3_vector_forest": op3_vector_forest,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_token_codes": op9_token_codes,
    "op10_warc": op10_warc,
}

# All pairs in double precision, and components as the least of what walks over links reach. Other queries draw, hash, learn or tokenize, which SQL can't express.
_VECTORS = """
WITH RECURSIVE u AS MATERIALIZED (
    SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), l AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), w AS (SELECT a AS s, a AS t FROM l UNION SELECT w.s, l.b FROM w JOIN l ON l.a = w.t),
c AS (SELECT s, min(t) AS least FROM w GROUP BY s)
SELECT CAST(e.vec_id AS BIGINT) AS vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, coalesce(c.least, CAST(e.vec_id AS BIGINT)) AS component_id, coalesce(c.least, CAST(e.vec_id AS BIGINT)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.s = e.vec_id
"""

ORACLES: dict[str, str] = {"op3_vector_forest": _VECTORS}
