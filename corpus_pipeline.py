"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes the documents that the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemodex.llm import language, quality
from mnemodex.llm.common import cut, id_remainder, shared_folder, table, vocabulary
from mnemodex.llm.packing import pack_documents
from mnemodex.llm.passages import remove_passages, repeated_passages
from mnemodex.llm.simhash import keep_one
from mnemodex.session import ship

#: A document is rejected if no language accounts for so large a share of its n-grams.
LEAST_LANGUAGE = 0.2
#: ... or if its quality score is lower.
LEAST_QUALITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language. Null texts, texts without a letter and those of no learned language go."""
    model = language.train(docs, id_remainder(F.col("doc_id"), 4) != 2)
    plain, text = _plain(docs)
    judged = language.identify(plain, model, text_col=text, keep=plain.columns)
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*plain.columns).toDF(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough. Without labels to learn from, all stay."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"), "quality", id_remainder(F.col("doc_id"), 3) != 1)
    plain, text = _plain(docs)
    judged = quality.score(plain, weights, text_col=text, keep=plain.columns)
    return judged.filter(F.col("score") >= LEAST_QUALITY).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates: texts whose five-word shingles have a similarity of 0.8 or more."""
    return keep_one(docs, similarity=0.8, size=5).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller id has too; ``n_chars`` follows the text.

    A document of which nothing is left goes. One that was empty or null before stays.
    """
    empty = "_" * (1 + max(map(len, docs.columns)))  # no column has this name
    marked = docs.withColumn(empty, F.coalesce(F.length("text") == 0, F.lit(True)))
    cleaned = remove_passages(marked, cut(repeated_passages(docs, least=50, similar=0.8))).filter(F.col(empty) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequences that hold them; an empty or null text is the end id alone."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with numbered columns, so that no extra column's name can clash with a result's, and the text's name."""
    return docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))), f"_{docs.columns.index('text')}"


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: Learned models, alignment, packing and tokenizers can't be written in SQL; tests/llm compares the operators and the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. Each stage's documents are written to the shared folder and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    sc, folder = spark.sparkContext, shared_folder(spark)
    for at, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            place = f"{folder.rstrip('/')}/corpus-{sc.applicationId}-{zlib.crc32(sf_dir.encode()):08x}-{at}-{name}"
            out.write.mode("overwrite").parquet(place)
            out = spark.read.parquet(place)
        docs = out
    return docs
