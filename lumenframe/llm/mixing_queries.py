"""Queries of problem 8."""

from lumenframe.functions.runtime import read_table
from lumenframe.llm.mixing import mix_to_shares


def p8_mix(spark, sf_dir):
    return mix_to_shares(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir):
    return mix_to_shares(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}

SQL: dict = {}
