"""Queries of problem 2."""

from lumenframe.functions.runtime import read_table
from lumenframe.llm.scans import repair_scans, scan_noise


def p2_found(spark, sf_dir):
    return scan_noise(read_table(spark, sf_dir, "frames"))


def p2_repaired(spark, sf_dir):
    return repair_scans(read_table(spark, sf_dir, "frames"))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}

SQL: dict = {}
