"""From documents to token ids, in five stages.

Each stage takes all rows the one before kept and returns the columns of
documents (the last one ids); between stages the rows are a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm import ensemble, linededup, mixture, piecefst, toxicity
from quire.llm.common import hash128, stored, table
from quire.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
COLLECTION = 2.0
ORACLE_SQL = None  # fitting, hashing sketches and the tokeniser have no SQL form


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op4 rejects go. It learns from the
    labels of documents that aren't held out; null and empty texts stay, as do
    null and repeated ids, each row by its own text. Extra columns are left
    out; an empty table gives an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only; no document goes, though one
    may end empty. n_chars follows the text. Rows are documents, null ids the
    smallest; null texts stay null. Extra columns are left out; an empty table
    gives an empty one."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept"))
    n_chars = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("kept").cast("long"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies stays: the one with the
    smallest doc_id, null ones first, of several such the text with the
    smallest digest. Null and empty texts are copies of each other. Rows are
    told apart by doc_id and text, so repeated or null doc_ids of different
    texts stay apart. A text more than COLLECTION times as large as one it
    quotes is a collection, not a copy: by rule of this stage both stay. Extra
    columns are left out; an empty table gives an empty one."""
    _, classes = ensemble.near_classes(docs, max_ratio=COLLECTION)
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("text_class").alias("key"), "t1", "t2")).alias("k")).select("k.*")
    text = F.coalesce("text", F.lit(""))
    t1, t2 = hash128(text)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(ensemble.LOW)).alias("key"), t1.alias("t1"), t2.alias("t2"), *COLUMNS)
    one = keyed.join(kept, ["key", "t1", "t2"], "left_semi").groupBy("key", "t1", "t2").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return one.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mixture takes copies. Rows are
    documents, also with null or repeated ids; a null source is a source, and
    documents without words get no copy. Extra columns are left out; an empty
    table gives an empty one."""
    mixed = mixture.mix(docs, keep=("text", "lang", "n_chars"))
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, row by row; null and empty texts have none. An
    empty table gives an empty one."""
    coded = piecefst.encode(docs.select("doc_id", "source", "text"), piecefst.load(tokenizer_path("piece_bpe_32k.model")))
    return coded.select("doc_id", "source", "ids", F.size("ids").alias("n_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("piece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
