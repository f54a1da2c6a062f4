"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc, covertree, ensemble, linededup, mixture, piecefst, spotsigs, tokencount, toxicity, warc
from .common import table
from .sql import SQL  # noqa: F401


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.page_responses(table(spark, sf_dir, "pages")), keep=("page_id",))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_entropy_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixture.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_study(table(spark, sf_dir, "documents"))


def op3_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piecefst.encode(docs, piecefst.load(tokenizer_path("piece_bpe_32k.model")), round_trip=True)
    return coded.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_sentences", "worst_start", "worst_end", "worst_score")


def op5_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.report(table(spark, sf_dir, "documents"))


def op6_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"))


def op7_containment_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.near_duplicates(table(spark, sf_dir, "documents"), copy_ratio=ensemble.NEAR)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def spotsigs_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity join of op2's fingerprints over all documents."""
    return spotsigs.near_classes(table(spark, sf_dir, "documents"))


def line_index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of op8, reached by a first batch, an insertion of the others,
    a deletion of the first batch and its insertion anew."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    odd = F.pmod("doc_id", F.lit(2)) == 1
    first, rest = docs.filter(odd), docs.filter(~odd)
    index = linededup.LineIndex.of(first).insert(rest).delete(first).insert(first)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_spotsigs, op3_piece_transducer, op4_toxicity_mil, op5_content_chunks, op6_dual_tree, op7_containment_ensemble, op8_line_dedup, op9_token_counts, op10_entropy_mixture, line_index_incremental, spotsigs_near_classes)}
