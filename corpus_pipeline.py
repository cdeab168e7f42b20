"""The corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes the documents that the one before kept and returns documents (doc_id, text, lang, source, n_chars);
the last returns pieces and their places in training sequences. For all stages: an empty table gives an empty one,
repeated rows are documents of their own but for near-duplicates, very long texts are taken whole, and columns beside
those five are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironlift.llm.classifier import fit
from ironlift.llm.common import read_table, saved
from ironlift.llm.decontaminate import decontaminate
from ironlift.llm.neardup import drop_near_duplicates
from ironlift.llm.packing import cut_documents, pack
from ironlift.llm.pii import redact_pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score less are rejected.
LEAST_SCORE = 0.5
TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on the labels and drops the documents that it rejects. A null text scores as an empty one; a score at the limit stays."""
    docs = docs.select(*COLUMNS)
    return fit(docs, read_table(spark, sf_dir, "labels")).score(docs, name="score").where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of near-duplicates, of equal ids the text of least digest; null texts are no class's copies and stay."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs; null texts have none."""
    return decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark")).where(F.col("match")["n_hit"] == 0).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and counts the characters again; documents all stay."""
    return redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into pieces and packs those into sequences of at most 1024 ids; a null text is its end id alone."""
    pieces = cut_documents(docs, TOKENIZER, end_id=0)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", hide_personal_data),
    ("packing", pack_sequences),
]
#: A trained classifier and signatures are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
