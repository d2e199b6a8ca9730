"""Queries of problem 6."""

from lumenframe.functions.runtime import read_table
from lumenframe.llm.personal import personal_fields, redact_personal


def p6_found(spark, sf_dir):
    return personal_fields(read_table(spark, sf_dir, "frames"), read_table(spark, sf_dir, "name_parts"))


def p6_redacted(spark, sf_dir):
    return redact_personal(read_table(spark, sf_dir, "frames"), read_table(spark, sf_dir, "name_parts"))


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}

SQL: dict = {}
