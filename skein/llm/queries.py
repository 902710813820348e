"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, cross_polytope, fill_in_middle, html_labeller, language, licenses, mixing, phrase_prints, quality, sentencepiece_codec, sharding, simhash_index, toxicity
from .common import table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    return cross_polytope.nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_labeller.extract_pages(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-mixed order of the documents: as even as a repetition limit of 1.25 allows, as
    many tokens as there are."""
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.Target(repetition=1.25))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, links of at most 2 bits."""
    return simhash_index.simhash_components(table(spark, sf_dir, "documents"), k=3, radius=2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected quality grade of every document and whether it is selected."""
    return quality.quality_grades(table(spark, sf_dir, "documents"), quality.grade_table(table(spark, sf_dir, "labels")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families of all paragraphs that may be a license notice."""
    return licenses.license_paragraphs(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and whether they decode to its text."""
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return phrase_prints.document_prints(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings around 8 centroids after 10 rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, seed=3)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in a tree of 40 shards, and its shard in one of 41."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.Tree.even(40))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of every document's rearranged text."""
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_neighbours, op2_html, op3_mixing, op4_simhash, op5_toxicity, op6_quality, op7_licenses, op8_sentencepiece, op9_fingerprints, op10_language,
    op11_centroids, op12_sharding, op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op11_centroids": centroids.CLUSTER_SQL, "op12_sharding": sharding.SHARD_SQL, "op13_fill_in_middle": fill_in_middle.DIGEST_SQL}
