"""Queries of problem 7."""

from pyspark.sql import functions as F

from lumenframe.functions.runtime import materialize, read_table
from lumenframe.llm.tokens import decode_corpus, encode_corpus


def p7_ids(spark, sf_dir):
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p7_roundtrip(spark, sf_dir):
    """Number of tokens of each document and whether its ids give back its text."""
    documents = read_table(spark, sf_dir, "documents")
    encoded = materialize(encode_corpus(documents))
    decoded = decode_corpus(encoded).withColumnRenamed("text", "decoded")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    same = texts.join(encoded, "doc_id").join(decoded, "doc_id")
    return same.select("doc_id", F.size("ids").alias("n_tokens"), (F.col("text") == F.col("decoded")).alias("same"))


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}

SQL: dict = {}
