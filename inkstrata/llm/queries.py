"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstrata.llm import ball_tree, decontamination, divergence, html_text, language_model, license_scan, matroska, near_dedup, packing, quality, secret_scan, toxicity, url_filter
from inkstrata.llm.common import read_table


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html is empty, repeated rows each get their row (see ``html_text.extract``)."""
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op2_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; null and empty texts have none, repeated rows each get their row (see ``secret_scan.secrets``)."""
    return secret_scan.secrets(read_table(spark, sf_dir, "documents"))


def op3_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every url; null urls have an empty host and path (see ``url_filter.judge``)."""
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; null and empty texts are copies of each other, a null id has no class (see ``near_dedup.near_duplicates``)."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; a null or empty text is its end token alone (see ``language_model.score``)."""
    return language_model.score(read_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence; a null or empty text is its end id alone (see ``packing.pack``)."""
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as media and read back; null counts as empty, equal texts have equal values (see ``matroska.media_columns``)."""
    return matroska.media_columns(read_table(spark, sf_dir, "documents"))


def op8_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; empty texts have the score of the bias (see ``toxicity.score``)."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items; null and empty texts hold none (see ``decontamination.contaminated``)."""
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; texts without tokens have the score of the bias (see ``quality.score``)."""
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every whole vector; others give no row (see ``ball_tree.cluster``)."""
    return ball_tree.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document; null and empty texts have none (see ``license_scan.licenses``)."""
    return license_scan.licenses(read_table(spark, sf_dir, "documents")).drop("links")


def op13_group_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and by which terms; nulls are empty texts (see ``divergence.divergence``)."""
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_site_templates,
        op2_randomness_battery,
        op3_path_templates,
        op4_dart_minhash,
        op5_elias_fano_trie,
        op6_linear_grouping,
        op7_matroska,
        op8_factorization_machine,
        op9_bm25_wand,
        op10_subword_embeddings,
        op11_ball_tree,
        op12_set_join,
        op13_group_tiles,
    )
}

#: SQL for the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {"op3_path_templates": url_filter.oracle_sql(), "op11_ball_tree": ball_tree.oracle_sql(), "op12_set_join": license_scan.oracle_sql(), "op13_group_tiles": divergence.oracle_sql()}
