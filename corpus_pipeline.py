"""A training-corpus pipeline over the operators of tokenecho.llm.

Each stage takes the documents that its predecessor kept, reread from Parquet, and
returns documents with the same columns; the last returns their encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenecho.llm import bpe, crf, minhash, mixing, pii
from tokenecho.llm.common import Scratch, documents
from tokenecho.llm.queries import tokenizer_path

#: A document is rejected if its words' own languages are less certain than this on the mean (whichever
#: language each word has, so text that switches between languages stays), or if it has no letter.
LEAST_CERTAINTY = 0.4
#: Near duplicates are judged on shingles of so many words, at a similarity of 0.8.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which is filled in where it was null. Null texts and texts without a letter go."""
    found = crf.identify(docs, crf.fit_on(docs), out="language_found__")
    found = found.where(F.col("language_found__.lang_pred") != "und").where(F.col("language_found__.certainty") >= LEAST_CERTAINTY)
    lang = F.coalesce(F.col("lang"), F.col("language_found__.lang_pred")).alias("lang")
    return found.select(*[lang if c == "lang" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows with a null id stay; rows that repeat an id stay or go together."""
    dropped = minhash.near_duplicates(docs, shingle=SHINGLE).where("NOT kept").select(F.col("doc_id").alias("dropped__")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("dropped__"), "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced in their texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text, for each document of the mix."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mix", mix), ("encode", encode)]

#: The field of the first stage is fitted and the mix is a flow, which SQL cannot express; tests run every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
