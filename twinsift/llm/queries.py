"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import chunks, clustering, decontaminate, fingerprints, jaccard_join, packing, pii, quality, resampling, secrets, sharding, token_files, urls
from twinsift.llm._util import Queries, read


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file; never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, over all documents and items."""
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict, and what the model makes of it."""
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of over 50 words that several documents have, by document, with its first holder."""
    return chunks.repeated_passages(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score and prediction; labels are learned from rows that are not held out."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from the token files: start, number of ids and their crc32."""
    folder = token_files.new_folder(spark)
    manifest = token_files.write_token_files(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folder)
    return token_files.token_digest(token_files.read_token_files(manifest, folder))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2,048 ids."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, pseudonymised, with how many values of each kind were replaced."""
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key="twinsift")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 3-word shingles and the smallest id that links at 90 % reach."""
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with counts and spans of secrets, the base patterns' and the field's."""
    return secrets.scan_digest(secrets.scan(read(spark, sf_dir, "documents")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and how alike it is to that and to the next document."""
    return fingerprints.edit_digest(read(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight and score towards the benchmark's words, and its rank if it is drawn."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot; shards have near equal bytes."""
    return sharding.shard(read(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster and distance."""
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


_QUERIES = [
    op1_decontamination, op2_url_filter, op3_substring_dedup, op4_quality, op5_token_files, op6_packing, op7_pseudonyms, op8_ngram_join, op9_secret_scan, op10_fingerprints, op11_resampling, op12_sharding,
    op13_clustering,
]


def queries() -> Queries:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_ngram_join": jaccard_join.oracle(), "op10_fingerprints": fingerprints.oracle(), "op11_resampling": resampling.oracle(), "op12_sharding": sharding.oracle(), "op13_clustering": clustering.oracle()}
