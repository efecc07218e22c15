"""Documents to training tokens in five stages, each by one operator of gridloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, pieces, pii, simhash, toxicity
from gridloom.llm.common import shared_dir, table, tokenizer_file

#: Documents of which more than this share of the words stands in benchmark passages go altogether.
MOST_HIT = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the table of labels; null and empty texts stay, as ordinary ones do."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of texts linked at a likeness of 0.8 in five-word shingles."""
    return simhash.drop_near(docs)


def _held(docs: DataFrame) -> DataFrame:
    """text beside all columns as one, so that no operator's own columns replace any."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")


def _back(held: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents with the text as it is now, and its length."""
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return held.select(*[made[c].alias(c) if c in made else F.col(f"doc.`{c}`") for c in columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go. Null texts stay null."""
    found = decontaminate.find(_held(docs), table(spark, sf_dir, "benchmark"))
    left = found.where(F.size("hit") <= MOST_HIT * F.col("n_words"))
    return _back(decontaminate.remove_spans(left), docs.columns)


def without_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in the place of each span of personal data."""
    return _back(pii.redact(_held(docs)), docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids in the place of its text, and digests of these and of the text decoded from them."""
    return pieces.tokenize(docs, tokenizer_file(pieces.MODEL), texts=True).drop("decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("personal data", without_personal),
    ("tokens", as_tokens),
]
#: A fitted compression distance and SentencePiece's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = shared_dir(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
