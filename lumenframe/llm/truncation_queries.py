"""Queries of problem 9."""

from lumenframe.functions.runtime import read_table
from lumenframe.llm.truncation import score_truncation, truncation_rates


def p9_found(spark, sf_dir):
    return score_truncation(read_table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p9_scores(spark, sf_dir):
    return score_truncation(read_table(spark, sf_dir, "documents"))


def p9_rates(spark, sf_dir):
    return truncation_rates(read_table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}

SQL: dict = {}
